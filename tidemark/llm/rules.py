"""Quality classifier: a sparse ensemble of rules taken from trees, compiled to Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import held_out

#: Labelled documents to learn from at most; above that, those with the least hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS = 60, 3, 32


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; an empty or null text has 0 in each."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    lines = F.filter(F.split(text, r"\n+"), lambda line: line != "")
    count, chars = F.size(words), F.length(text)
    next_word = F.slice(words, F.lit(2), F.greatest(count - 1, F.lit(0)))
    repeats = F.size(F.filter(F.zip_with(words, next_word, lambda a, b: a == b), lambda same: same))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")

    def per_word(pattern: str) -> Column:
        return share(F.regexp_count(text, F.lit(pattern)), count)

    return {
        "log_words": F.log1p(count.cast("double")),
        "word_length": share(chars, count),
        "different_words": share(F.size(F.array_distinct(words)), count),
        "repeated_words": share(repeats, count),
        "different_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": share(count, F.size(lines)),
        "shouted_words": per_word(r"\p{Lu}{3,}"),
        "capitals": per_word(r"\p{Lu}"),
        "symbols": per_word(r"[^\p{L}\p{N}\s.,]"),
        "symbol_runs": per_word(r"[^\p{L}\p{N}\s]{2,}"),
        "bars": per_word(r"\|"),
        "digits": per_word(r"[0-9]"),
        "stops": per_word(r"[.!?]"),
    }


STATISTICS = (
    "log_words",
    "word_length",
    "different_words",
    "repeated_words",
    "different_lines",
    "words_a_line",
    "shouted_words",
    "capitals",
    "symbols",
    "symbol_runs",
    "bars",
    "digits",
    "stops",
)

#: A rule: for some statistics, by number, the open lower and closed upper end of what it allows.
Rule = tuple[tuple[int, float, float], ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths from the root to every other node of gradient-boosted trees over binned statistics."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    least = max(5, len(y) // 500)
    random = np.random.default_rng(9)
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            size = len(edges[f]) + 1
            b = bins[rows, f]
            g = np.cumsum(np.bincount(b, gradient[rows], size))
            h = np.cumsum(np.bincount(b, hessian[rows], size))
            n = np.cumsum(np.bincount(b, minlength=size))
            left = slice(0, size - 1)
            gain = g[left] ** 2 / (h[left] + 1) + (g[-1] - g[left]) ** 2 / (h[-1] - h[left] + 1)
            gain = gain - g[-1] ** 2 / (h[-1] + 1)
            gain[(n[left] < least) | (n[-1] - n[left] < least)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        return best[1:]

    def grow(rows: np.ndarray, bounds: dict, level: int, gradient, hessian, value: np.ndarray) -> None:
        if bounds:
            rules.setdefault(tuple(sorted((f, *ends) for f, ends in bounds.items())))
        f, at = split(rows, gradient, hessian) if level < depth else (None, None)
        if f is None:
            value[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1)
            return
        low, high = bounds.get(f, (-np.inf, np.inf))
        cut, below = float(edges[f][at]), bins[rows, f] <= at
        grow(rows[below], {**bounds, f: (low, min(high, cut))}, level + 1, gradient, hessian, value)
        grow(rows[~below], {**bounds, f: (max(low, cut), high)}, level + 1, gradient, hessian, value)

    for _ in range(trees):
        p = _sigmoid(margin)
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        value = np.zeros(len(y))
        if len(rows):
            grow(rows, {}, 0, y - p, p * (1 - p), value)
        margin += 0.2 * value
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rule holds for which row."""
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for f, low, high in rule:
            out[:, j] &= (x[:, f] > low) & (x[:, f] <= high)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> np.ndarray:
    """Weights, and last the intercept, by accelerated proximal gradient; the intercept is free."""
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1)
    w = ahead = np.append(np.zeros(z.shape[1]), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        error = (_sigmoid(z @ ahead[:-1] + ahead[-1]) - y) / len(y)
        new = ahead - rate * np.append(z.T @ error, error.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with a weight each, and an intercept."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, statistics: dict[str, Column]) -> Column:
        """The ensemble as one column expression of the statistics."""
        margin = F.lit(self.intercept)
        columns = list(statistics.values())
        for rule, weight in zip(self.rules, self.weights, strict=True):
            ends = []
            for f, low, high in rule:
                ends += [columns[f] > low] * (low > -np.inf) + [columns[f] <= high] * (high < np.inf)
            margin = margin + F.when(reduce(lambda a, b: a & b, ends), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(holds(list(self.rules), x) @ np.array(self.weights) + self.intercept)


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Rules from trees, weighed by a lasso whose penalty is chosen on a fifth of the rows.

    Without rows every score is 0.5; with one label only, it is the share of that label, smoothed.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = RuleEnsemble((), (), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return constant
    rules = tree_rules(x, y)
    z = holds(rules, x)
    kept = (z.mean(axis=0) > 0.002) & (z.mean(axis=0) < 0.998)
    rules, z = [r for r, k in zip(rules, kept, strict=True) if k], z[:, kept].astype(np.float64)
    if not rules:
        return constant
    scale = np.maximum(z.std(axis=0), 1e-3)
    z = (z - z.mean(axis=0)) / scale
    test = np.arange(len(y)) % 5 == 0
    best, chosen = np.inf, 0.003
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w = lasso_logistic(z[~test], y[~test], penalty, 150)
        p = np.clip(_sigmoid(z[test] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        if loss < best:
            best, chosen = loss, penalty
    w = lasso_logistic(z, y, chosen)
    used = np.flatnonzero(w[:-1])
    weights = w[:-1][used] / scale[used]
    centre = holds([rules[j] for j in used], x).mean(axis=0)
    return RuleEnsemble(
        tuple(rules[j] for j in used), tuple(map(float, weights)), float(w[-1] - centre @ weights)
    )


def learn_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """An ensemble learned from labelled documents that are not held out.

    At most ``train_rows`` labels are used, those whose doc_id has the least hash. Null labels are
    left out; a doc_id labelled more than once counts as its lowest label, and one with several rows
    as that of the least statistics, so that no more rows than labels are fetched.
    """
    some = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .filter(~held_out(F.col("doc_id"), 5))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))
    statistics = F.struct(*[c.alias(n) for n, c in text_statistics(F.col("text")).items()])
    one = rows.groupBy("label_id", "label").agg(F.min(statistics).alias("least"))
    sample = one.select("label_id", "label", "least.*").toPandas()
    sample = sample.sort_values("label_id", ignore_index=True)
    return fit_rules(sample[list(STATISTICS)].to_numpy(np.float64), sample["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: RuleEnsemble, into: str = "score") -> DataFrame:
    """The documents with the model's score, from 0 to 1, as column ``into`` (replacing any)."""
    names = {n: f"_statistic_{n}" for n in STATISTICS}
    wide = docs.drop(into).withColumns(
        {names[n]: c for n, c in text_statistics(F.col("text")).items()}
    )
    score = model.score({n: F.col(c) for n, c in names.items()})
    return wide.withColumn(into, score).drop(*names.values())


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see ``learn_quality``.

    Scores come from the text alone; null counts as empty. Repeated rows are scored each.
    """
    model = learn_quality(docs, labels, train_rows)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 5).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they are."""
    model = learn_quality(docs, labels, train_rows)
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return scored(rows, model).filter(F.col("score") >= THRESHOLD).select("row.*")
