"""Statistics, n-grams and decoding recomputed word by word."""

import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import languages, rules

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t ", "one", "Two two TWO\n\nthree|four!! 12.", "ÄÖÜ äöü É.  x", "a a a b b\na a a b b\n", "x" * 5000,
    "\U0001f600 $$ ** Ok. NO? YES! 3.14\r\nEnd", "A B c\x0bd\x0ce", "\n\nlead and trail \n",
]


def brute_statistics(text):
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in regex.split(r"\n+", text) if x]
    n = len(words)
    per = lambda pattern: len(regex.findall(pattern, text)) / n if n else 0.0
    space = r" \t\n\x0b\f\r"
    return {
        "log_words": math.log1p(n),
        "word_length": len(text) / n if n else 0.0,
        "different_words": len(set(words)) / n if n else 0.0,
        "repeated_words": sum(a == b for a, b in zip(words, words[1:])) / n if n else 0.0,
        "different_lines": len(set(lines)) / len(lines) if lines else 0.0,
        "words_a_line": n / len(lines) if lines else 0.0,
        "shouted_words": per(r"\p{Lu}{3,}"),
        "capitals": per(r"\p{Lu}"),
        "symbols": per(rf"[^\p{{L}}\p{{N}}{space}.,]"),
        "symbol_runs": per(rf"[^\p{{L}}\p{{N}}{space}]{{2,}}"),
        "bars": per(r"\|"),
        "digits": per(r"[0-9]"),
        "stops": per(r"[.!?]"),
    }


def test_statistics_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    got = df.select("doc_id", *[c.alias(n) for n, c in rules.text_statistics(F.col("text")).items()]).collect()
    for row in got:
        want = brute_statistics(ODD[row.doc_id])
        assert {n: row[n] for n in want} == pytest.approx(want), ODD[row.doc_id]
        assert set(want) == set(rules.STATISTICS)


def test_scores_follow_from_the_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = rules.learn_quality(docs, labels)
    got = {r.doc_id: r.score for r in rules.quality(docs, labels).collect()}
    for row in docs.select("doc_id", "text").collect():
        x = np.array([[brute_statistics(row.text)[n] for n in rules.STATISTICS]])
        margin = rules.holds(list(model.rules), x) @ np.array(model.weights) + model.intercept
        assert got[row.doc_id] == pytest.approx(1 / (1 + math.exp(-margin[0])), abs=1e-9)


def brute_slots(text):
    """Slots of all byte n-grams of all words of a text, repeats included."""
    out = []
    for word in (text or "").encode().split():
        word = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        padded = b" " + word + b" "
        grams = [word[i : i + 1] for i in range(len(word))]
        grams += [padded[i : i + 2] for i in range(len(word) + 1)] + [padded[i : i + 3] for i in range(len(word))]
        for gram in grams:
            code = int.from_bytes(gram, "little") * 2654435761 + len(gram) * 0x9E3779B1
            out.append((code % 2**32) >> (32 - languages.SLOTS.bit_length() + 1))
    return out


def test_slot_counts(spark):
    df = spark.createDataFrame([("l", t) for t in ODD if t is not None], "lang string, text string").coalesce(1)
    got = languages._slot_counts(df).collect()
    for row, text in zip(got, [t for t in ODD if t is not None], strict=True):
        slots, counts = np.unique(np.array(brute_slots(text), int), return_counts=True)
        assert row.slots == slots.tolist() and row.counts == counts.tolist()


def test_predictions_decode_the_nearest_codeword(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.learn_languages(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:60] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    asked = spark.createDataFrame(rows, "doc_id bigint, text string")
    some = docs.select("doc_id", "text", "lang").unionByName(asked.filter("doc_id >= 1000000").withColumn("lang", F.lit(None).cast("string")))
    got = {r.doc_id: r for r in languages.languages(some).collect()}
    for doc_id, text in rows:
        row = got[doc_id]
        if not regex.search(r"\p{L}", text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        slots = np.array(brute_slots(text), int)
        margin = model.slots[slots].astype(float).sum(axis=0) / max(1, len(slots)) + model.bias
        loss = (np.logaddexp(0, -margin * model.codes) * model.trust).sum(axis=1) * model.codes.shape[1]
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        assert row.score == pytest.approx(p[best], abs=1e-3)
        assert row.lang_pred == model.languages[best]
