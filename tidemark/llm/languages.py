"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import coded_words, held_out, slices, staged
from tidemark.llm.tokens import spread

#: Documents of each language to learn from, about.
TRAIN_DOCS = 400
#: Bits of a codeword at least, and hash slots of n-grams.
CODE_BITS, SLOTS = 15, 1 << 14
SIZES = (1, 2, 3)
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_ngrams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the byte n-grams of each word, with a space on both sides, and the words' numbers.

    One pair of arrays for each n, in the order of the words.
    """
    text = _LOWER[np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8)]
    space = text == 32
    word = np.cumsum(space) - 1
    for n in SIZES:
        last = len(text) - n + 1
        code = np.zeros(last, np.uint32)
        inside = np.ones(last, bool)
        for k in range(n):
            code |= text[k : k + last].astype(np.uint32) << np.uint32(8 * k)
            if n == 1 or 0 < k < n - 1:
                inside &= ~space[k : k + last]
        if n == 2:
            inside &= ~(space[:last] & space[1:])
        inside[word[:last] >= len(words)] = False
        slot = (code[inside] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(
            32 - SLOTS.bit_length() + 1
        )
        yield slot, word[:last][inside]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of each range between two starts; 0 for empty ranges."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.diff(starts) > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


@dataclass(frozen=True)
class CodeModel:
    """Codewords of the languages, a linear classifier for each bit, and how far to trust it."""

    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, -1 or 1
    slots: np.ndarray  # n-gram slots x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, each row sums to 1

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Of each text and bit, over all n-grams of the whole text."""
        starts, codes, words = coded_words(texts)
        of_word = np.zeros((len(words), self.codes.shape[1] + 1), np.float32)
        step = 65536
        for first in range(0, len(words), step):
            some = words[first : first + step].to_pylist()
            for slot, word in word_ngrams(some):
                bounds = np.searchsorted(word, np.arange(len(some) + 1))
                of_word[first : first + len(some), :-1] += _sums(self.slots[slot], bounds)
                of_word[first : first + len(some), -1] += np.diff(bounds)
        totals = np.zeros((len(starts) - 1, of_word.shape[1]))
        step = 1 << 18
        for first in range(0, len(codes), step):
            ends = np.clip(starts, first, min(first + step, len(codes))) - first
            totals += _sums(of_word[codes[first : first + step]], ends)
        return totals[:, :-1] / np.maximum(totals[:, -1:], 1) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword, its probability and that of the next best.

        The distance to a codeword is the sum over bits of the logistic loss of that bit, weighed by how
        well its classifier tells the language on the training documents.
        """
        signed = margins[:, None, :] * self.codes[None]
        loss = (np.logaddexp(0, -signed) * self.trust[None]).sum(axis=2) * self.codes.shape[1]
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second


def codewords(languages: int, bits: int = CODE_BITS) -> np.ndarray:
    """Codewords of -1 and 1 that lie far apart: the best of many random draws, always the same.

    No bit is alike for all languages, except where there is one language only.
    """
    bits = max(bits, int(np.ceil(10 * np.log2(max(languages, 2)))))
    random = np.random.default_rng(10)
    best, apart = None, -1
    for _ in range(200):
        code = np.where(random.random((languages, bits)) < 0.5, -1, 1)
        if languages > 1:
            flat = np.abs(code.sum(axis=0)) == languages
            code[0, flat] *= -1
        near = min(
            ((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(languages - 1)), default=bits
        )
        if near > apart:
            best, apart = code, near
    return best


def fit_codes(languages: list[str], slots: list[np.ndarray], counts: list[np.ndarray]) -> CodeModel:
    """A model from documents' n-gram slots and their counts; all bits are learned together."""
    known = tuple(sorted(set(languages)))
    code = codewords(len(known))
    bits = code.shape[1]
    label = np.searchsorted(np.array(known), np.array(languages))
    target = (code[label] + 1) / 2
    w, b = np.zeros((SLOTS, bits), np.float32), np.zeros(bits)
    first, second = np.zeros_like(w), np.zeros_like(w)
    random = np.random.default_rng(11)
    step = 0

    def batch(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), SLOTS), np.float32)
        for i, row in enumerate(rows):
            x[i, slots[row]] = counts[row] / max(counts[row].sum(), 1)
        return x

    for _ in range(4 if len(known) > 1 else 0):
        order = random.permutation(len(label))
        for at in range(0, len(order), 100):
            rows = order[at : at + 100]
            x = batch(rows)
            error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target[rows]
            gradient, step = x.T @ error.astype(np.float32) / len(rows), step + 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            w -= 2.0 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
            b -= 0.1 * error.mean(axis=0)
    right = np.zeros((len(known), bits))
    for at in range(0, len(label), 100):
        rows = np.arange(at, min(at + 100, len(label)))
        np.add.at(right, label[rows], (batch(rows) @ w + b) * code[label[rows]] > 0)
    trust = (right + 1) / (np.bincount(label, minlength=len(known))[:, None] + 1)
    return CodeModel(
        known, code, w.astype(np.float32), b, trust / trust.sum(axis=1, keepdims=True)
    )


def _slot_counts(docs: DataFrame) -> DataFrame:
    """lang, slots and counts: the n-grams of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, codes, words = coded_words(batch.column(1))
            found = list(word_ngrams(words.to_pylist()))
            bounds = [np.searchsorted(word, np.arange(len(words) + 1)) for _, word in found]
            slots, counts = [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                word, times = np.unique(codes[a:b], return_counts=True)
                total = np.zeros(SLOTS)
                for (slot, _), bound in zip(found, bounds, strict=True):
                    sizes = bound[word + 1] - bound[word]
                    here = slot[spread(bound[word], sizes)]
                    total += np.bincount(here, np.repeat(times, sizes), SLOTS)
                slots.append(np.flatnonzero(total).astype(np.int32))
                counts.append(total[slots[-1]].astype(np.float32))
            yield pa.record_batch(
                [batch.column(0), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
                names=["lang", "slots", "counts"],
            )

    return docs.mapInArrow(count, "lang string, slots array<int>, counts array<float>")


def learn_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> CodeModel | None:
    """A model from documents that are not held out and have a text and a language; None without any.

    Of each language about ``train_docs`` documents are drawn by a hash of their id. Rows of one id and
    language count once, with the least text of theirs, so that no more rows are fetched.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"), 5))
    different = staged(known.select("doc_id", "lang").distinct(), "known")
    sizes = different.groupBy("lang").agg(F.count("*").alias("size"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = different.join(sizes, "lang").filter(draw < F.lit(float(train_docs)) / F.col("size"))
    ids = staged(ids.select("doc_id", "lang"), "drawn")
    some = known.join(ids, ["doc_id", "lang"], "left_semi")
    some = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    rows = _slot_counts(some).toArrow().to_pydict()
    order = sorted(range(len(rows["lang"])), key=lambda i: (rows["lang"][i], rows["slots"][i], rows["counts"][i]))
    order = [i for i in order if rows["slots"][i]]
    if not order:
        return None
    return fit_codes(
        [rows["lang"][i] for i in order],
        [np.array(rows["slots"][i]) for i in order],
        [np.array(rows["counts"][i]) for i in order],
    )


def languages(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learned. ``score`` is the probability of the nearest codeword;
    ``ambiguous`` marks where the second nearest has more than half of that. Repeated rows are
    predicted each; other columns are not looked at; an empty table gives an empty one.
    """
    model = learn_languages(docs, train_docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None:
                n = batch.num_rows
                best = [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([False] * n)]
            else:
                at, p, second = model.decode(model.margins(batch.column(1)))
                names = pa.array(model.languages).take(pa.array(at))
                best = [names, pa.array(p), pa.array(second > p / 2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), *best],
                names=["doc_id", "letters", "lang_pred", "score", "ambiguous"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", "text", letters.alias("letters")).mapInArrow(
        predict, f"doc_id {kind}, letters boolean, lang_pred string, score double, ambiguous boolean"
    )
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5).alias("held_out"),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        (F.col("letters") & F.col("ambiguous")).alias("ambiguous"),
    )
