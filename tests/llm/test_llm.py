"""The training-data operators against brute force, on small tables with the odd cases in them."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from checks.compare import connect  # noqa: E402
from tidemark.llm import (  # noqa: E402
    attention,
    blocks,
    languages,
    mixture,
    near,
    neighbours,
    packing,
    private,
    repeats,
    rules,
    scoring,
)
from tidemark.llm.oracles import ORACLE_SQL  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402
from tidemark.llm.tokens import WordEndTokenizer, encode  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASHING = ("size", "taken", "mix", "row", "name", "n", "label", "private", "_text", "score", "part", "key", "kept")

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def texts(seed=0, n=60):
    """Random texts with exact and near copies, nulls, empty ones, one very long one."""
    pick = random.Random(seed)
    out = [" ".join(pick.choices(WORDS, k=pick.randint(1, 120))) for _ in range(n)]
    out += [out[3], out[3].upper(), out[5], out[5], out[7] + " more", None, "", " \t\n", "Ä ä é"]
    passage = " ".join(pick.choices(WORDS, k=40))
    out += [f"{pick.random()} {passage} {pick.random()}" for _ in range(4)]
    out += [" ".join(pick.choices(WORDS, k=30_000))]
    long = " ".join(str(pick.randint(0, 99)) for _ in range(100)).split()
    for i in range(3):
        edited = list(long)
        edited[i * 20] = "edited"
        out.append(" ".join(edited))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, t, [None, "en", "de"][i % 3], [None, "a", "b", "c"][i % 4], i) for i, t in enumerate(texts())
    ]
    rows += [rows[3], (None, "no id", None, "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ours = QUERIES[name](spark, SF).toArrow()
    con = connect(SF)
    con.register("ours", ours)
    columns = ", ".join(f'"{c}"' for c in ours.column_names)
    theirs = f"SELECT {columns} FROM ({ORACLE_SQL[name]})"
    assert con.execute(f"SELECT {columns} FROM ours EXCEPT ALL {theirs}").fetchall() == []
    assert con.execute(f"{theirs} EXCEPT ALL SELECT {columns} FROM ours").fetchall() == []


# ---- mixture ----------------------------------------------------------------------------------


def test_mixture(docs, plain, empty):
    got = mixture.mixture_digest(docs).toPandas()
    assert len(got) == len(plain)
    sizes = defaultdict(int)
    for _, text, source in plain:
        sizes[source] += len(words(text))
    total, open_ = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(open_)}
    target, left = {}, total
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    full = mixture.mix(docs).select("source", "size", "mix.*").toDF("source", "clash", "size", "source_size", "target", "passes", "taken").toPandas()
    for s, rows in full.groupby("source", dropna=False):
        s = None if s != s else s
        assert rows["source_size"].iloc[0] == sizes[s]
        assert rows["target"].iloc[0] == pytest.approx(target[s])
        assert rows["taken"].sum() == int(target[s] + 1e-9)
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixture.mixture_digest(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    np.testing.assert_array_equal(got[key].sort_values(key), again[key].sort_values(key))
    assert mixture.mixture_digest(empty).count() == 0


def test_mixed_documents_keep_columns(docs):
    mixed = mixture.mixed_documents(docs)
    assert mixed.dtypes == docs.dtypes
    assert mixed.filter("taken != 'clash'").isEmpty()


# ---- scoring ----------------------------------------------------------------------------------


def test_attention_gradients():
    pick = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in attention.initial(9, np.arange(9) % attention.MIXTURES).items()}
    starts = np.array([0, 5, 40])
    ids = pick.integers(0, 9, 40)
    begin, first, last = attention.windows(starts)
    inputs, there, place, wanted = attention.gather(ids, begin, first, last, 2)
    shares = pick.dirichlet(np.ones(9), attention.MIXTURES).T

    def loss():
        p = (attention.forward(w, inputs, there)["share"] * shares[ids[place]]).sum(-1)
        return -np.log(p[wanted]).sum()

    f = attention.forward(w, inputs, there)
    part = f["share"] * shares[ids[place]]
    part /= part.sum(-1, keepdims=True)
    g = attention.gradients(w, inputs, f, (f["share"] - part) * wanted[..., None])
    for name, x in w.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), x.shape)
        old, step = x[at], 1e-4
        x[at] = old + step
        up = loss()
        x[at] = old - step
        assert (up - loss()) / (2 * step) == pytest.approx(g[name][at], rel=0.02), name
        x[at] = old


def test_reader_gives_what_the_forward_pass_gives():
    pick = np.random.default_rng(3)
    w = {k: v * 2 for k, v in attention.initial(30, np.arange(30) % attention.MIXTURES).items()}
    starts = np.array([0, 5, 5, 40, 41])
    ids = pick.integers(0, 30, 41)
    shares = pick.dirichlet(np.ones(30), attention.MIXTURES).T.astype(np.float32)
    inputs, there, place, wanted = attention.gather(ids, *attention.windows(starts), 2)
    share = attention.forward(w, inputs, there)["share"]
    together = shares[:7].sum(axis=0)
    here = ids[place].ravel()
    more = shares[here][:, -2:], np.tile(together[-2:], (len(here), 1))
    own, some = attention.Reader(w, shares[:, :-2], together[:-2])(inputs, there, here, *more)
    wanted = wanted.ravel()
    np.testing.assert_allclose(own[wanted], (share * shares[ids[place]]).sum(-1).ravel()[wanted], rtol=1e-4)
    np.testing.assert_allclose(some[wanted], (share @ shares[:7].sum(axis=0)).ravel()[wanted], rtol=1e-4)


def test_attention_is_causal():
    w = attention.initial(9, np.arange(9) % attention.MIXTURES)
    ids = np.random.default_rng(2).integers(0, 9, 40)
    shares = []
    for changed in (False, True):
        own = ids.copy()
        own[25] = (own[25] + changed) % 9
        begin, first, last = attention.windows(np.array([0, 40]))
        inputs, there, place, wanted = attention.gather(own, begin, first, last, 2)
        out = np.zeros((40, attention.MIXTURES))
        out[place[wanted]] = attention.forward(w, inputs, there)["share"][wanted]
        shares.append(out)
    same = np.isclose(shares[0], shares[1]).all(axis=1)
    assert same[:26].all() and not same[26]


def test_every_training_document_teaches_the_scores(spark, monkeypatch):
    """However large the corpus: topics in every round, attention in one of them where there are many shards."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    wanted = sorted(r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10)
    for chars in (1000, 10**9):
        got = scoring._training(docs, chars).collect()
        assert sorted(r["doc_id"] for r in got) == wanted and all(r["text"] is not None for r in got)
    seen, summed = [], scoring._summed

    def spy(training, step):
        seen.append(sorted(r["shard"] for r in training.select("shard").collect()))
        return summed(training, step)

    monkeypatch.setattr(scoring, "_summed", spy)
    monkeypatch.setattr(scoring, "SHARD_CHARS", 5000)
    assert scoring.score(docs, RANKS, public_tokenizers.PATTERN).count() == docs.count()
    topics, attention = seen[: scoring.TOPIC_ROUNDS], seen[scoring.TOPIC_ROUNDS :]
    assert all(len(x) == len(wanted) for x in topics)
    assert sorted(sum(attention, [])) == topics[0] and len(attention) == scoring.ROUNDS and len(set(topics[0])) > 8


def test_scores_leave_only_their_result_on_disk(spark):
    """Not the files of shuffles, which stayed until the driver collected garbage, nor what was staged on the way."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    shared, setting = Path(spark.conf.get("spark.checkpoint.dir")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    had, there, before = shuffled(), set(shared.iterdir()), spark.conf.get(setting, None)
    got = scoring.score(docs, RANKS, public_tokenizers.PATTERN)
    for _ in range(40):  # they go in the background
        if not (left := shuffled() - had):
            break
        time.sleep(0.25)
    assert not left
    assert [x.name.split("-")[1] for x in set(shared.iterdir()) - there if x.name.startswith("tidemark-")] == ["weighed"]
    assert spark.conf.get(setting, None) == before
    assert got.count() == docs.count()


def test_the_first_round_gives_each_id_to_the_distribution_of_the_one_before():
    pick = np.random.default_rng(4)
    lists = [[*pick.integers(3, 9, n).tolist(), 2] for n in (0, 1, 30, 5, 0, 17)]
    own, want = pick.integers(0, scoring.LEARNED, 9), np.zeros((9, scoring.LEARNED))
    for x in lists:
        for before, i in zip([2, *x], x, strict=False):
            want[i, own[before]] += 1
    starts = np.cumsum([0, *map(len, lists)])
    assert (scoring.first_given(np.concatenate(lists).astype(np.int32), starts, own, 9) == want).all()


def test_row_wise_sums_need_no_shards(spark):
    rows = spark.range(1000).repartition(7)
    step = scoring.RowWise(lambda t: np.bincount(t["id"].to_numpy() % 100, minlength=100).astype(float))
    assert (scoring._summed(rows, step) == 10).all()
    assert len(scoring._summed(rows.filter("id < 0"), step)) == 0


def test_scores(docs, plain, empty):
    got = scoring.score(docs, RANKS, public_tokenizers.PATTERN).toPandas()
    train = [t for i, t, _ in plain if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in train for w in words(t))
    ends, n = len(train), sum(counts.values()) + len(train)
    scale = n + 0.1 * (len(counts) + 2)
    assert (got["train_tokens"] == n).all()
    by_id = {i: t for i, t, _ in plain}
    for r in got.itertuples():
        own = words(by_id[None if r.doc_id != r.doc_id else int(r.doc_id)])
        base = sum(np.log10((counts[w] + 0.1) / scale) for w in own) + np.log10((ends + 0.1) / scale)
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(w in counts for w in own) + 1)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    assert got["score"].sum() > got["base_score"].sum()
    assert scoring.score(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_scores_of_the_query_lower_only_ascii_capitals(spark, tmp_path):
    own = ["The the THE \u00c4 \u00e4 Zoo"] * 5 + ["the zoo \u00c4B \u00c4b", "\u00c4 Unseen", None] * 5
    spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_scores"](spark, str(tmp_path)).toPandas()
    capitals = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [words((t or "").translate(capitals)) for t in own]
    train = [w for i, w in enumerate(own) if zlib.crc32(str(i).encode()) % 10]
    assert 0 < len(train) < len(own)
    counts = Counter(w for t in train for w in t)
    n = sum(counts.values()) + len(train)
    scale = n + 0.1 * (len(counts) + 2)
    assert len(got) == len(own) and (got["train_tokens"] == n).all()
    for r in got.itertuples():
        base = sum(np.log10((counts[w] + 0.1) / scale) for w in own[r.doc_id]) + np.log10((len(train) + 0.1) / scale)
        assert (r.n_tokens, r.n_known) == (len(own[r.doc_id]) + 1, sum(w in counts for w in own[r.doc_id]) + 1)
        assert r.base_score == pytest.approx(base)


def test_each_id_is_scored_once():
    begin, first, last = attention.windows(np.array([0, 1, 1, 17, 50]))
    ids = np.arange(50)
    _, _, place, wanted = attention.gather(ids, begin, first, last, 2)
    assert sorted(place[wanted].tolist()) == list(range(50))


# ---- packing ----------------------------------------------------------------------------------


@pytest.mark.parametrize("alphabet", [" \taAéÉ'sSİΣß<|startoftext|>09$中́\x1c\x85", "aAbé'stTßÿ×÷09-., \n", "e'sllre've9 ²"])
def test_ids_are_those_of_whole_texts(alphabet):
    pick = random.Random(1)
    own = ["".join(pick.choices(alphabet, k=pick.randint(0, 60))) for _ in range(500)] + [None, "<|startoftext|> x"]
    tokenizer = WordEndTokenizer(WORD_BPE)
    ids, starts = encode(pa.array(own), tokenizer, 0)
    for i, text in enumerate(own):
        expected = tokenizer.model.encode(text or "", add_special_tokens=False).ids + [0]
        assert ids[starts[i] : starts[i + 1]].tolist() == expected


def test_packing(docs, plain, empty):
    got = packing.pack(docs, WORD_BPE, group_rows=40).toPandas()
    placed = got.sort_values(["sequence_id", "offset"])
    ahead = placed.groupby("sequence_id")["length"].cumsum() - placed["length"]
    assert (ahead == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 2048
    model = WordEndTokenizer(WORD_BPE).model
    expected = []
    for i, text, _ in plain:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[at : at + 2048], "<u4")
            expected.append((-1 if i is None else i, piece, at, len(cut), zlib.crc32(cut.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].fillna(-1).astype(int).values.tolist())) == sorted(expected)
    sizes = got["length"].to_numpy()
    assert got["sequence_id"].nunique() <= packing.lower_bound(sizes) + 1
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    pick = np.random.default_rng(0)
    for _ in range(50):
        sizes = pick.integers(1, pick.integers(2, 2049), pick.integers(1, 200))
        sequence, offset = packing.best_fit_decreasing(sizes)
        used = np.bincount(sequence, weights=sizes)
        assert used.max() <= 2048 and packing.lower_bound(sizes) <= len(used)
        assert len(used) <= packing.lower_bound(sizes) * 11 / 9 + 1
    assert packing.lower_bound(np.array([1025] * 7)) == 7
    assert packing.lower_bound(np.array([700] * 9)) == 5


# ---- personal data ----------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if (
                (kind == "ip" and max(map(int, m[0].split("."))) > 255)
                or (kind == "card" and not (12 <= len(digits) <= 19 and luhn % 10 == 0))
                or (kind == "phone" and not 9 <= len(digits) <= 15)
            ):
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_private(spark, docs, empty):
    pick = random.Random(3)
    alphabet = "a@.b+-_%0123456789 ()[at]é\U0001f600\n"
    own = ["".join(pick.choices(alphabet, k=pick.randint(0, 80))) for _ in range(500)]
    own += [None, "", "1.2.3.4.5.6.7.8 a@b.c_d@e.fg +1 (416) 555-2113 4539-5787 6362 1486", "x" * 20_000]
    own += ["1 " * 9000, "a@b.co " * 300, "4" * 9000, "\U0001f600a@b.com"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(3)
    for r in private.private_digest(df).collect():
        spans = base_spans(own[r.doc_id] or "")
        listed = [f"{kind}:{a}:{e}" for a, _, e, kind in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in spans) for k in KINDS]
        assert set(listed) <= set(r.spans.split(","))
    assert private.private_digest(docs).count() == docs.count()
    assert private.private_digest(empty).count() == 0


def test_private_adds_forms_that_look_alike(spark):
    own = [f"call me +1 (416) 555-{i:04d} now" for i in range(400)] + ["call me 1 (416) 555-9999 now"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    last = private.private_digest(df).filter("doc_id = 400").first()
    assert last.n_phone == 0 and last.spans == "phone:8:24"
    assert private.redacted(df).filter("doc_id = 400").first().text == "call me [phone] now"
    assert "PythonUDF" not in private.private_digest(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("text, kind", [("+33 1 23 45 67 89", "phone"), ("378 282 246 310 005", "card")])
def test_private_finds_base_forms_without_long_runs_of_digits(spark, text, kind):
    df = spark.createDataFrame([(1, f"at {text}.")], "doc_id bigint, text string")
    got, span = private.private_digest(df).first(), f"{kind}:3:{3 + len(text)}"
    assert [f"{k}:{a}:{e}" for a, _, e, k in base_spans(f"at {text}.")] == [span]
    assert got[f"n_{kind}"] == 1 and span in got.spans.split(",")
    assert got.base_sha256 == hashlib.sha256(span.encode()).hexdigest()


# ---- near-duplicates --------------------------------------------------------------------------


def shingles(text):
    own = words(text)
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def near_labels(rows):
    """Least doc_id of each document's class, by comparing all pairs."""
    bags, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in bags:
        for j in bags:
            if i < j and (jaccard(bags[i], bags[j]) >= 0.8 or not (bags[i] or bags[j])):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in bags}


def test_near_duplicates(docs, plain, empty):
    got = near.near_duplicates(docs).toPandas()
    assert len(got) == len(plain)
    expected = near_labels([(i, t) for i, t, _ in {r[0]: r for r in plain}.values() if i is not None])
    for r in got.dropna(subset="doc_id").itertuples():
        assert r.class_id == expected[r.doc_id]
    assert got.groupby(got["class_id"].fillna(-1))["kept"].sum().eq(1).all()
    stay = near.without_near_copies(docs)
    assert stay.dtypes == docs.dtypes and stay.count() == got["kept"].sum()
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_along_a_chain(spark):
    """Documents that are linked only through others, in one large bucket with a hub."""
    pick = random.Random(5)
    hub = [str(pick.randint(0, 10**6)) for _ in range(200)]
    rows = [" ".join(hub)]
    for _ in range(40):
        edited = list(hub)
        for at in pick.sample(range(0, 200, 10), pick.randint(1, 6)):
            edited[at] = str(pick.random())
        rows.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(2)
    expected = near_labels(list(enumerate(rows)))
    assert {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()} == expected


def test_a_pair_comes_from_the_first_band_that_it_really_shares(spark):
    """The sketches agree in all bands, by chance in the first one, whose buckets differ."""
    rows = [(x, [x, *range(100, 99 + near.BANDS)]) for x in (1, 2)]
    schema = "band int, bucket bigint, row bigint, n bigint, label bigint, size bigint, sketch binary, bands array<bigint>"

    def given(band):
        sketch = bytes(near.BANDS * near.BAND_ROWS)
        made = [(band, bands[band], row, 50, row, 2, sketch, bands) for row, bands in rows]
        return near._agreeing(spark.createDataFrame(made, schema), spark.createDataFrame(made[1:], schema)).collect()

    assert [tuple(r) for r in given(1)] == [(1, 2, 1, 2)]
    assert given(2) == []


def test_signatures_estimate_weighted_jaccard():
    pick = np.random.default_rng(0)
    element = pick.integers(0, 1 << 48, 200).astype(np.uint64)
    errors = []
    for _ in range(20):
        one = pick.integers(1, 9, 200)
        two = np.where(pick.random(200) < 0.6, one, pick.integers(1, 20, 200))
        pair = near.signatures(
            np.array([0, 1]), np.repeat([0, 1], 200), np.tile(element, 2), np.append(one, two), 512
        )
        alone = near.signatures(np.array([0]), np.zeros(200, int), element, one, 512)
        assert (alone[0] == pair[0]).all()
        truth = np.minimum(one, two).sum() / np.maximum(one, two).sum()
        errors.append((pair[0] == pair[1]).mean() - truth)
        element = element ^ np.uint64(pick.integers(1, 1 << 40))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


# ---- neighbours -------------------------------------------------------------------------------


def test_neighbours(spark):
    pick = np.random.default_rng(4)
    x = pick.standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) * pick.uniform(0.8, 1.2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[7] = (7, None)
    rows[8] = (8, [0.0] * 24)
    rows[9] = (9, [float("nan")] * 24)
    rows[20] = (20, [1.0, None] + [0.0] * 22)
    rows[11] = (11, [1.0])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = neighbours.nearest(df).toPandas()
    fine = np.array([i not in (7, 8, 9, 20, 11) for i in range(3000)])
    found = 0
    queries = [i for i in range(0, 3000, 20) if fine[i]]
    assert sorted(set(got["query_id"])) == queries
    for q in queries:
        score = x.astype(float) @ x[q].astype(float)
        score[~fine] = score[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -score))[:20])
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert own["score"].tolist() == pytest.approx(score[own["vec_id"]].tolist(), abs=1e-12)
        assert own["score"].is_monotonic_decreasing
        found += len(best & set(own["vec_id"]))
    assert found / (20 * len(queries)) >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 5 OR vec_id = 40")).toPandas()
    assert few.groupby("query_id")["rank"].max().to_dict() == {0: 5, 40: 5}
    assert neighbours.nearest(df.filter("vec_id = 7")).count() == 0


def test_hilbert_curve_visits_neighbouring_cells():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# ---- exact dedup ------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"block": 7, "route": lambda c: F.length(c) % 3}])
def test_exact_copies(docs, plain, options):
    got = blocks.exact_copies(docs, **options).toPandas()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, text, _ in plain:
        groups[(text or "").translate(lower)].append(-1 if i is None else i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(plain)
    for sha, rows in got.groupby("text_sha256"):
        assert sorted(rows["doc_id"].fillna(-1)) == sorted(by_sha[sha])
        assert rows["keep_id"].fillna(-1).eq(max(by_sha[sha])).all()
        assert rows["group_size"].eq(len(rows)).all() and rows["kept"].sum() == 1
        assert rows[rows["kept"]]["doc_id"].fillna(-1).eq(max(by_sha[sha])).all()


def test_without_copies_keeps_columns(docs, empty):
    stay = blocks.without_copies(docs)
    assert stay.dtypes == docs.dtypes
    assert stay.count() == blocks.exact_copies(docs).filter("kept").count()
    assert blocks.exact_copies(empty).count() == 0


# ---- repeats ----------------------------------------------------------------------------------


def test_repeats(docs, plain, empty, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_SUFFIXES", 500)  # so that prefixes become longer
    got = repeats.without_repeats(docs).toPandas()
    first = {}
    key = lambda i: 2**63 if i is None else i
    for i, text, _ in plain:
        own = words(text)
        for at in range(len(own) - 12):
            window = tuple(own[at : at + 13])
            first[window] = min(first.get(window, 2**63), key(i))
    expected = []
    for i, text, _ in plain:
        own, gone = words(text), set()
        for at in range(len(own) - 12):
            if first[tuple(own[at : at + 13])] < key(i):
                gone |= set(range(at, at + 13))
        kept = b" ".join(w for at, w in enumerate(own) if at not in gone).decode()
        expected.append((key(i), len(own), len(gone), kept))
    got = got.assign(doc_id=[key(None) if x != x else int(x) for x in got["doc_id"]])
    assert sorted(map(tuple, got[["doc_id", "n_words", "n_removed", "kept_text"]].values)) == sorted(expected)
    assert sum(row[2] for row in expected) > 100
    assert repeats.repeats_digest(empty).count() == 0


# ---- classifiers ------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert held["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()


def test_quality_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (10**6, 0)], "doc_id bigint, quality int")
    assert rules.quality(docs, labels).filter("score IS NULL").isEmpty()
    assert rules.quality(docs, labels.limit(0)).filter("score != 0.5").isEmpty()
    assert rules.good_documents(docs, labels).dtypes == docs.dtypes
    assert rules.quality(empty, labels).count() == 0


def test_rules_as_expressions_agree_with_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = rules.learn_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    stats = [c.alias(n) for n, c in rules.text_statistics(F.col("text")).items()]
    rows = rules.scored(docs, model).select("score", *stats).toPandas()
    assert rows["score"].tolist() == pytest.approx(model.predict(rows[list(rules.STATISTICS)].to_numpy(float)).tolist())
    assert 0 < len(model.rules) and all(w for w in model.weights)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.languages(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_languages_odd_cases(docs, plain, empty):
    got = {r.doc_id: r for r in languages.languages(docs).collect()}
    for i, text, _ in plain:
        assert (got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", text or ""))
    assert languages.languages(empty).count() == 0
    none = languages.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("lang_pred != 'und'").isEmpty()


def test_codewords_lie_apart():
    code = languages.codewords(12)
    near_ = min((code[i] != code[j]).sum() for i in range(12) for j in range(i))
    assert near_ >= 10 and set(np.unique(code)) == {-1, 1}


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    good, exact, close, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    one = good(spark, docs, SF).cache()
    kept = rules.quality(docs, labels).filter("score >= 0.3")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in kept.collect()}
    two = exact(spark, one, SF).cache()
    latest = {}
    for r in one.collect():
        key = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        latest[key] = max(latest.get(key, -1), r.doc_id)
    assert {r.doc_id for r in two.collect()} == set(latest.values())
    three = close(spark, two, SF).cache()
    classes = near_labels([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id for r in three.collect()} == set(classes.values())
    four = mixed(spark, three, SF).cache()
    taken = {r.doc_id: (r["size"], r.taken) for r in mixture.mixture_digest(three).collect()}
    times = Counter(r.doc_id for r in four.collect())
    assert times == {i: int(t / s + 0.5) if s else 1 for i, (s, t) in taken.items() if not s or t / s >= 0.5}
    pieces = packed(spark, four, SF).groupBy("doc_id", "piece").count().collect()
    assert all(r["count"] == times[r.doc_id] for r in pieces) and {r.doc_id for r in pieces} == set(times)
    for stage in (one, two, three, four):
        assert stage.dtypes == docs.dtypes


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()
