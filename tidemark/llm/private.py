"""Personal data: generators propose spans and boosted trees choose among them, in SQL functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive repeats and the marks before them match the same spans, without the
#: deep recursion and the second tries that long runs would cost. \G lets a match begin where one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns: forms that the base ones leave out, besides their own.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?"
    r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._-]?[0-9]{4}){2}[\x20._-]?[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]))\+?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
#: Words before a span that speak for each kind, and those that speak for none.
WORDS = {
    "email": r"mail|contact|write\s+to|reach",
    "ip": r"host|server|\bip\b|address|node",
    "card": r"card|visa|credit|charge|paid",
    "phone": r"phone|\btel|call|fax|mobile",
}
OTHER_WORDS = r"order|invoice|serial|\bref|\bid\b|number|version|item"
#: What any match of a pattern holds, so that a text must have it somewhere for the pattern to be tried.
NEEDS = {
    "base_email": r"@",
    "base_ip": r"[0-9]",
    "base_card": r"[0-9][\x20-]?[0-9]",
    "base_phone": r"\+[0-9]",
    "wide_email": r"@|\(at\)|\[at\]",
    "wide_ip": r"[0-9]",
    "wide_card": r"[0-9]{4}",
    "wide_phone": r"[0-9]{3}",
}
FEATURES = ("kind", "digits", "marks", "spaces", "left", "right", "word")
#: Share of right spans that a threshold must reach on the documents set apart for calibration.
PRECISION = 0.95
ROUNDS, RATE = 30, 0.3

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum up to a multiple of ten."""
    size = F.length(digits)

    def value(at: Column) -> Column:
        digit = F.substring(digits, size - at, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(at % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.sequence(F.lit(0), size - 1), value)
    total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(False)


def passes(kind: str, span: Column) -> Column:
    """Whether a match of the base pattern of ``kind`` counts."""
    if kind == "ip":
        return span.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _running_sum(values: str, heads: str) -> Column:
    """Sums up to each element; ``heads`` are the sums before every 64th."""

    def upto(_: Column, i: Column) -> Column:
        begin = F.floor(i / 64).cast("int")
        part = F.slice(values, begin * 64 + 1, i - begin * 64 + 1)
        return F.get(heads, begin) + F.aggregate(part, F.lit(0), lambda a, b: a + b)

    return F.transform(values, upto)


def _heads(values: str) -> Column:
    """The sums before every 64th element."""
    chunks = F.ceil(F.size(values) / 64).cast("int")

    def total(chunk: Column) -> Column:
        return F.aggregate(F.slice(values, chunk * 64 + 1, F.lit(64)), F.lit(0), lambda a, b: a + b)

    def add(sums: Column, chunk: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + total(chunk)))

    return F.when(
        F.size(values) > 0, F.aggregate(F.sequence(F.lit(0), chunks - 1), F.array(F.lit(0)), add)
    )


def _spans(docs: DataFrame) -> DataFrame:
    """Adds base_<kind> and wide_<kind>: arrays of start, end, span, left and right context.

    The text between the matches gives their places, so that only one pass over it is needed.
    """
    patterns = {f"base_{k}": p for k, p in BASE.items()} | {f"wide_{k}": p for k, p in WIDE.items()}
    none = F.array().cast("array<string>")

    def found(name: str, pattern: str) -> Column:
        matches = F.regexp_extract_all("_text", F.lit(pattern), 0)
        return F.when(F.col("_text").rlike(NEEDS[name]), matches).otherwise(none)

    def between(name: str, pattern: str) -> Column:
        parts = F.transform(
            F.split("_text", pattern, -1),
            lambda x: F.struct(
                F.length(x).alias("size"), F.substring(x, 1, 1).alias("head"), F.right(x, F.lit(24)).alias("tail")
            ),
        )
        return F.when(F.size(name) > 0, parts)

    def steps(name: str) -> Column:
        return F.transform(name, lambda x, i: F.get(f"{name}_b", i)["size"] + F.length(x))

    def span(name: str) -> Column:
        def build(x: Column, i: Column) -> Column:
            end = F.get(f"{name}_e", i)
            return F.struct(
                (end - F.length(x)).alias("start"),
                end.alias("end"),
                x.alias("span"),
                F.get(f"{name}_b", i)["tail"].alias("left"),
                F.get(f"{name}_b", i + 1)["head"].alias("right"),
            )

        return F.transform(name, build)

    rows = docs.withColumns({n: found(n, p) for n, p in patterns.items()})
    rows = rows.withColumns({f"{n}_b": between(n, p) for n, p in patterns.items()})
    rows = rows.withColumns({f"{n}_s": steps(n) for n in patterns})
    rows = rows.withColumns({f"{n}_h": _heads(f"{n}_s") for n in patterns})
    rows = rows.withColumns({f"{n}_e": _running_sum(f"{n}_s", f"{n}_h") for n in patterns})
    rows = rows.withColumns({n: span(n) for n in patterns})
    def right(kind: str) -> Column:
        return F.filter(f"base_{kind}", lambda x: passes(kind, x["span"]))

    base = {f"base_{k}": right(k) for k in KINDS}
    drop = [f"{n}_{x}" for n in patterns for x in "bshe"]
    return rows.withColumns(base).drop("_text", *drop)


def _known(kind: str, span: Column) -> Column:
    """Whether the base finds something in a candidate."""
    inside = F.regexp_extract_all(span, F.lit(BASE[kind]), 0)
    return F.exists(inside, lambda x: passes(kind, x))


def _features(kind: str, candidate: Column) -> list[Column]:
    """Format and context of a candidate as small numbers, in the order of ``FEATURES``.

    They leave out what sets the wide forms apart from the base ones, and what the base ones are checked by, so
    that the trees have to tell right candidates by how they look and by the words before them. ``word`` is 2 after
    a word that speaks for the kind, 0 after one for another kind or for none, and 1 otherwise; the
    last such word counts.
    """
    span, digits = candidate["span"], _digits(candidate["span"])

    def side(char: Column) -> Column:
        return (
            F.when(char.isNull() | char.rlike(r"^\s?$"), 0)
            .when(char.rlike(r"\p{L}"), 1)
            .when(char.rlike("[0-9]"), 2)
            .otherwise(3)
        )

    others = "|".join([*(words for k, words in WORDS.items() if k != kind), OTHER_WORDS])
    # what follows the last word for the kind holds no other word
    own = candidate["left"].rlike(rf"(?is)(?:{WORDS[kind]})(?!.*(?:{others}))")
    word = F.when(own, 2).when(candidate["left"].rlike(rf"(?i){others}"), 0).otherwise(1)
    marks = F.length(F.regexp_replace(span, r"[A-Za-z0-9+@\s]|\(at\)|\[at\]|\[\.\]", ""))
    return [
        F.lit(KINDS.index(kind)),
        F.least(F.length(digits), F.lit(20)),
        F.least(marks, F.lit(5)),
        F.least(F.length(F.regexp_replace(span, r"\S", "")), F.lit(5)),
        side(F.right(candidate["left"], F.lit(1))),
        side(candidate["right"]),
        word,
    ]


Leaf = tuple[tuple[tuple[int, int, bool], ...], float]  # (feature, cut, above) of the path, value


def boost(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS) -> tuple[float, list[Leaf]]:
    """Trees of depth two for the log-odds, from (features, count, count of right ones)."""
    right, count = sum(r[2] for r in rows), sum(r[1] for r in rows)
    start = math.log((right + 0.5) / (count - right + 0.5))
    margin, leaves = [start] * len(rows), []

    def best_cut(some: list[int], g: list[float], h: list[float]):
        total_g, total_h = sum(g[i] for i in some), sum(h[i] for i in some)
        best = (1e-9, None)
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for i in some:
                at = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                at[0] += g[i]
                at[1] += h[i]
            low_g = low_h = 0.0
            for cut in sorted(sums)[:-1]:
                low_g, low_h = low_g + sums[cut][0], low_h + sums[cut][1]
                gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1)
                gain -= total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, (f, cut))
        return best[1]

    for _ in range(rounds if rows else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [r[2] - r[1] * q for r, q in zip(rows, p, strict=True)]
        h = [r[1] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        open_: list[tuple[list[int], tuple]] = [(list(range(len(rows))), ())]
        for depth in range(3):
            following = []
            for some, path in open_:
                cut = best_cut(some, g, h) if depth < 2 else None
                if cut is None:
                    value = RATE * sum(g[i] for i in some) / (sum(h[i] for i in some) + 1)
                    leaves.append((path, value))
                    for i in some:
                        margin[i] += value
                    continue
                f, at = cut
                following.append(([i for i in some if rows[i][0][f] <= at], (*path, (f, at, False))))
                following.append(([i for i in some if rows[i][0][f] > at], (*path, (f, at, True))))
            open_ = following
    return start, leaves


def _margin(start: float, leaves: list[Leaf], features: tuple[int, ...]) -> float:
    return start + sum(
        v for path, v in leaves if all((features[f] > cut) == above for f, cut, above in path)
    )


def learn(docs: DataFrame) -> tuple[float, list[Leaf], dict[str, float]]:
    """Trees and a threshold for each kind, from all candidates of all documents.

    A candidate is right if the base finds something in it; no feature tells that. Candidates that the base
    does not know count as wrong, so spans are added only where nearly all that look and stand like them are
    known. Candidates are counted by their features, of
    which there are at most 4 * 21 * 6 * 6 * 4 * 4 * 3; so many rows the driver gets at most. Half of the
    documents, by a hash, teach the trees, the others set the thresholds: the least margin from which on
    ``PRECISION`` of the candidates are right, or none.
    """
    half = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2
    rows = _spans(docs.select(half.alias("half"), F.coalesce("text", F.lit("")).alias("_text")))
    judged = F.concat(
        *[
            F.transform(
                _judged(k), lambda x: F.struct(*[x[f].alias(f) for f in FEATURES], x["known"].cast("int").alias("y"))
            )
            for k in KINDS
        ]
    )
    counted = rows.select("half", F.inline(judged))
    stats = counted.groupBy("half", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    found = sorted(tuple(r) for r in stats.collect())
    start, leaves = boost([(r[1:-2], r[-2], r[-1]) for r in found if r[0] == 0])
    thresholds = {}
    for k, kind in enumerate(KINDS):
        apart = [(_margin(start, leaves, r[1:-2]), r[-2], r[-1]) for r in found if r[0] == 1 and r[1] == k]
        n = y = 0
        for margin, more, right in sorted(apart, reverse=True):
            n, y = n + more, y + right
            if y >= PRECISION * n:
                thresholds[kind] = margin
    return start, leaves, thresholds


def _judged(kind: str) -> Column:
    """The candidates of a kind with their features, and whether the base knows them."""

    def judge(candidate: Column) -> Column:
        named = [c.alias(n) for n, c in zip(FEATURES, _features(kind, candidate), strict=True)]
        known = _known(kind, candidate["span"]).alias("known")
        return F.struct(*[candidate[c].alias(c) for c in ("start", "end", "span")], *named, known)

    return F.transform(f"wide_{kind}", judge)


def _chosen(kind: str, model: tuple[float, list[Leaf], dict[str, float]]) -> Column:
    """Candidates of a kind that the trees accept and the base does not know."""
    start, leaves, thresholds = model
    if kind not in thresholds:
        return F.filter(f"judged_{kind}", lambda x: F.lit(False))

    def accepted(candidate: Column) -> Column:
        margin = F.lit(start)
        for path, value in leaves:
            if any((KINDS.index(kind) > cut) != above for f, cut, above in path if not f):
                continue
            ends = [
                (candidate[FEATURES[f]] > cut) if above else (candidate[FEATURES[f]] <= cut)
                for f, cut, above in path
                if f
            ]
            if ends:
                margin = margin + F.when(reduce(lambda a, b: a & b, ends), value).otherwise(0.0)
            else:
                margin = margin + value
        return (margin >= thresholds[kind] - 1e-9) & ~candidate["known"]

    return F.filter(f"judged_{kind}", accepted)


def personal_data(docs: DataFrame) -> DataFrame:
    """The documents' columns with struct ``private``: base and all spans, each of (start, kind, end, span).

    Places count code points from 0, ends are exclusive; kind is a number into ``KINDS``. Base spans
    stay in any case; trees learned from all documents add spans in wider forms, where their calibrated
    margin is reached. A null or empty text has no spans; repeated rows are searched each; an empty table gives
    an empty one. A column named ``private`` is replaced, others are kept.
    """
    model = learn(docs)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = _spans(rows)

    def merged(parts: list[Column]) -> Column:
        return F.array_sort(F.concat(*parts))

    def placed(kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["span"].alias("span")
            ),
        )

    base = [placed(k, F.col(f"base_{k}")) for k in KINDS]
    rows = rows.withColumns({f"judged_{k}": _judged(k) for k in KINDS})
    rows = rows.withColumns({f"more_{k}": _chosen(k, model) for k in KINDS})
    more = [placed(k, F.col(f"more_{k}")) for k in KINDS]
    kept = [F.col(f"row.{c}") for c in docs.columns if c != "private"]
    private = F.struct(merged(base).alias("base"), merged(base + more).alias("spans"))
    return rows.select(*kept, private.alias("private"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span in ``text`` replaced by its kind in brackets.

    Of spans that overlap, the one that begins first counts. A null text stays null, as does an empty one.
    """
    found = personal_data(docs)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def replace(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        out = F.concat(acc["out"], gap, F.get(names, x["kind"]))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), out.alias("out")))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    replaced = F.when(F.col("text").isNotNull(), F.aggregate("private.spans", empty, replace, finish))
    return found.withColumn("text", replaced).drop("private")


def private_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, the hash of their list, and the list of all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("private.base", lambda x: x["kind"] == kind)).cast("long")

    return personal_data(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("private.base")), 256).alias("base_sha256"),
        listed(F.col("private.spans")).alias("spans"),
    )
