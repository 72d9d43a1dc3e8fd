"""Rows that come very often: bounded fetches, one comparison, right counts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import blocks, languages, near, rules
from tidemark.llm.shared import staged

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXT = " ".join(f"word{i}" for i in range(100))


def test_near_copies_that_repeat_are_compared_once(spark, monkeypatch):
    rows = [(1, TEXT, "en", "a", 1)] * 1000 + [(2, TEXT.replace("word50", "other"), "en", "a", 1)] * 1000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = []
    real = near._overlap

    def counted(pairs):
        seen.append(pairs.count())
        return real(pairs)

    monkeypatch.setattr(near, "_overlap", counted)
    got = near.near_duplicates(docs)
    assert {(r.doc_id, r.class_id, r["count"]) for r in got.groupBy("doc_id", "class_id").count().collect()} == {(1, 1, 1000), (2, 1, 1000)}
    assert got.filter("kept").count() == 1
    assert sum(seen) == 1
    monkeypatch.undo()
    (left,) = near.without_near_copies(docs).collect()
    assert left.doc_id == 1 and left.text == TEXT


def test_exact_copies_that_repeat(spark):
    rows = [(1, "a b", "en", "a", 1)] * 2500 + [(None, "A b", "en", "a", 1)] * 1200 + [(3, "c", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = blocks.exact_copies(docs).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 3700, True, 1), (1, 1, 3700, False, 2499), (None, 1, 3700, False, 1200), (3, 3, 1, True, 1)}
    assert sorted(r.doc_id for r in blocks.without_copies(docs).collect()) == [1, 3]


@pytest.fixture(scope="module")
def labelled(spark):
    """Some documents, one of them 30,000 times."""
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    chosen = plain.join(labels.filter("quality IS NOT NULL"), "doc_id").filter("lang IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 != 0")
    one = chosen.select(plain.columns).orderBy("doc_id").limit(1)
    often = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("n")
    return staged(plain.unionByName(often.withColumn("text", F.substring("text", 1, 200))), "often"), labels


def test_quality_fetches_a_row_a_label(labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    real = rules.fit_rules
    monkeypatch.setattr(rules, "fit_rules", lambda x, y: seen.append(len(x)) or real(x, y))
    rules.learn_quality(docs, labels)
    assert 0 < seen[0] <= labels.select("doc_id").distinct().count()


def test_languages_fetch_a_row_a_document(labelled, monkeypatch):
    docs, _ = labelled
    seen = []
    real = languages.fit_codes
    monkeypatch.setattr(languages, "fit_codes", lambda *a: seen.append(len(a[0])) or real(*a))
    languages.learn_languages(docs)
    assert 0 < seen[0] <= docs.select("doc_id").distinct().count()


# ---- the pipeline on odd rows -------------------------------------------------------------------


def odd_documents(spark):
    texts = [TEXT, TEXT, TEXT.upper(), TEXT + " more", None, "", " \n", "x", "Ä ä é", " ".join(f"w{i % 977}" for i in range(30_000))]
    rows = [(i, t, [None, "en"][i % 2], [None, "a", "b"][i % 3], 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, TEXT + " end", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    return df.withColumns({name: F.lit("clash") for name in ("row", "n", "name", "sha", "label", "key", "part", "taken", "one")})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_on_odd_rows(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.dtypes == docs.dtypes
    assert out.filter("sha != 'clash'").isEmpty()
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    if name == "exact_dedup":
        assert sorted(ids, key=str) == sorted([2, 3, 5, 6, 7, 8, 9, None], key=str)
    if name == "near_dedup":
        assert len(ids) == len(set(ids)) and 9 in ids


def test_last_stage_on_odd_rows(spark):
    out = corpus_pipeline.STAGES[-1][1](spark, odd_documents(spark), "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.filter("piece = 0").count() == 13


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "/root/testdata/sf0.001").count() == 0


def test_run_passes_each_stage_on(spark, tmp_path):
    docs, sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), "test")
    want = {(r.doc_id, r.piece) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "piece").collect()}
    got = corpus_pipeline.run(spark, sf).select("doc_id", "piece").collect()
    assert {(r.doc_id, r.piece) for r in got} == want and len(want) > 50
