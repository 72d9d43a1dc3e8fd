"""Added spans of personal data: context decides, odd rows are kept."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import private

CLASHING = ("_text", "row", "private", "half", "base_ip", "wide_ip", "judged_ip", "more_ip", "kind", "start")


def test_context_alone_decides(spark):
    """Numbers alike in every digit and blank: those after a word for phones are taken, orders are not."""
    own = [f"please call +1 555 123 {i:04d} today" for i in range(600)]
    own += [f"your order 1 555 123 {i:04d} today" for i in range(300)]
    own += ["please call 1 555 123 7777 today"] * 3
    df = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in private.private_digest(df).collect()}
    assert all(got[i].n_phone == 1 for i in range(600))
    assert [got[i].spans for i in range(900, 903)] == ["phone:12:26"] * 3
    assert all(got[i].n_phone == 0 for i in range(900, 903))
    assert {got[i].spans for i in range(600, 900)} == {""}
    left = private.redacted(df).filter("doc_id IN (650, 901)").orderBy("doc_id").collect()
    assert [r.text for r in left] == [own[650], "please call [phone] today"]


def test_numbers_that_nothing_tells_apart_are_left(spark):
    """Half of the card-like numbers pass the check digit: form and context are equal, so none is added."""
    own = ["paid with 4539578763621486 now", "paid with 4539578763621487 now"] * 200
    df = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    got = private.private_digest(df).groupBy("n_card", "spans").count().collect()
    assert {tuple(r) for r in got} == {(1, "card:10:26", 200), (0, "", 200)}


@pytest.mark.parametrize("text", ["192.168.10.12", "10.0.0.1", "233.254.104.120", "at 97.51.17.173."])
def test_wide_phone_takes_no_address(spark, text):
    found = spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(private.WIDE["phone"]), 0)).first()[0]
    assert found == []


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "mail a@b.co"), (2, None), (3, ""), (None, "host 10.0.0.1 and +33 1 23 45 67 89"), (1, "mail a@b.co")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    df = df.withColumns({name: F.lit("clash") for name in CLASHING})
    found = private.personal_data(df)
    assert found.columns == [*[c for c in df.columns if c != "private"], "private"]
    spans = {(r.doc_id, tuple((s.start, s.end, s.span) for s in r.private.base)) for r in found.collect()}
    assert spans == {
        (1, ((5, 11, "a@b.co"),)), (2, ()), (3, ()),
        (None, ((5, 13, "10.0.0.1"), (18, 35, "+33 1 23 45 67 89"))),
    }
    assert found.filter("row != 'clash' OR kind != 'clash'").isEmpty()
    left = private.redacted(df)
    assert left.columns == [c for c in df.columns if c != "private"]
    texts = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert texts == sorted([(1, "mail [email]"), (1, "mail [email]"), (2, None), (3, ""), (None, "host [ip] and [phone]")], key=str)


def test_overlapping_spans_are_replaced_once(spark):
    df = spark.createDataFrame([(1, "card 4539-5787 6362 1486 +1 555 123 4567")], "doc_id bigint, text string")
    assert "[card]" in private.redacted(df).first().text


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert private.personal_data(empty).count() == 0 and private.redacted(empty).count() == 0
