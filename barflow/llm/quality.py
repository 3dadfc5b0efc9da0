"""Quality classifier: a sparse rule ensemble over statistics of the text.

Boosted shallow trees over the statistics propose rules: every path from a root is a conjunction of comparisons.
A logistic regression with an L1 penalty (lasso) weighs them and drops most. The rest is compiled into one Spark
column, so scoring is a projection over the text, without a join or Python.

Fitting uses at most ``sample`` labelled rows, the first in the order of a hash of their doc_id; this is the only
bound, and the only rows that come to the driver. Scoring covers every row.

NULL and empty texts have statistics 0 and get a score like any other. Labels other than 0 and 1 are ignored,
repeated labels of a document count once (the lowest). Without labels every score is 1; with labels of one kind
it is that label; with labels that no statistic tells apart it is their mean. Ties of statistics fall on the side of "<=". Only doc_id and text are read, and of labels
doc_id and quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import doc_crc, table
from barflow.llm.registry import query

SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, CUTS = 40, 3, 24
PENALTY, ROUNDS = 0.002, 400


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a native expression and a number for any text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n, chars, of_lines = F.size(words), F.length(text), F.size(lines)
    again = F.filter(F.zip_with(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), words, lambda a, b: a == b), lambda same: same)

    def per(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(F.lit(0.0)).cast("double")

    def share(pattern: str) -> Column:
        return per(F.regexp_count(text, F.lit(pattern)), chars)

    return {
        "words": n.cast("double"), "word_length": per(chars, n), "distinct": per(F.size(F.array_distinct(words)), n), "repeated": per(F.size(again), n),
        "repeated_lines": 1.0 - per(F.size(F.array_distinct(lines)), of_lines), "line_words": per(n, of_lines), "symbols": share("[#*$%&|<>~^@]"),
        "capitals": share(r"\p{Lu}"), "digits": share("[0-9]"), "shouts": share("[!?]"), "stops": share("[.,;:]"),
    }


@dataclass
class Rules:
    """score = logistic(intercept + sum of weight where all of (statistic, above, bound) hold); fixed: a constant score instead."""

    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]
    intercept: float
    fixed: float | None = None

    def column(self, stats: dict[str, Column]) -> Column:
        if self.fixed is not None:
            return F.lit(float(self.fixed))
        total = F.lit(self.intercept)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, above, bound in tests:
                holds = holds & ((stats[name] > bound) if above else (stats[name] <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _tree(binned: np.ndarray, residual: np.ndarray, curve: np.ndarray, rows: np.ndarray, tests: tuple, depth: int, paths: list, step: np.ndarray) -> None:
    """Grow one tree on the gradient; every node below the root leaves its path, every leaf its step."""
    if tests:
        paths.append(tests)
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        g, h = residual[rows], curve[rows]
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[rows, f], g, CUTS + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h, CUTS + 1))[:-1]
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (float(gain[cut]), (f, cut))
    if best[1] is None:
        step[rows] = residual[rows].sum() / (curve[rows].sum() + 1.0)
        return
    f, cut = best[1]
    low = binned[rows, f] <= cut
    for side, above in ((rows[low], False), (rows[~low], True)):
        if len(side):
            _tree(binned, residual, curve, side, (*tests, (f, above, cut)), depth - 1, paths, step)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    """Trees, their paths, and lasso weights, from at most SAMPLE rows of statistics."""
    if not len(y) or y.min() == y.max():
        return Rules([], 0.0, float(y[0]) if len(y) else 1.0)
    bounds = [np.quantile(x[:, f], np.arange(1, CUTS + 1) / (CUTS + 1)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1)
    score, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _tree(binned, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, paths, step)
        score += 0.3 * step
    # One rule per distinct set of rows.
    rules: dict[bytes, tuple] = {}
    for tests in dict.fromkeys(paths):
        holds = np.ones(len(y), bool)
        for f, above, cut in tests:
            holds &= (binned[:, f] > cut) if above else (binned[:, f] <= cut)
        if 0 < holds.sum() < len(y):
            rules.setdefault(np.packbits(holds).tobytes(), (tests, holds))
    if not rules:
        return Rules([], 0.0, float(y.mean()))
    z = np.stack([holds for _, holds in rules.values()], axis=1).astype(np.float64)
    weights, intercept = _lasso(z, y)
    kept = [(float(w), tuple((names[f], above, float(bounds[f][cut])) for f, above, cut in tests)) for w, (tests, _) in zip(weights, rules.values()) if w]
    return Rules(kept, float(intercept))


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic loss plus PENALTY times the absolute weights, by accelerated proximal gradient; the intercept is free."""
    full = np.c_[z, np.ones(len(y))]
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(v @ (full.T @ (full @ v))) / len(y) * 1.01)
    w = np.zeros(full.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - step * (full.T @ (p - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(0.0, np.abs(new[:-1]) - step * PENALTY)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Learn from the labelled rows whose crc32(doc_id) mod 4 is not 2."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % 4 != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(sample)
    stats = statistics(F.col("text"))
    # At most ``sample`` ids and labels are sent to the scan of the documents.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id").cast("long") == F.col("of")).select("of", "label", *[c.alias(k) for k, c in stats.items()])
    got = rows.orderBy("of", *stats).limit(sample).toArrow()
    x = np.stack([got[k].to_numpy() for k in stats], axis=1) if got.num_rows else np.zeros((0, len(stats)))
    return fit_rules(x, got["label"].to_numpy().astype(float), list(stats))


def score(docs: DataFrame, model: Rules) -> DataFrame:
    """doc_id, score of every row of ``docs``: statistics first, rules over them."""
    stats = docs.select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    return stats.select("doc_id", model.column({k: F.col(k) for k in statistics(F.lit(""))}).alias("score"))


def keep_good(docs: DataFrame, model: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    packed = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    good = model.column({k: F.col(k) for k in statistics(F.lit(""))}) >= threshold
    # Not a filter: that would be pushed below the statistics and make them anew in every test of every rule.
    return packed.select(F.explode(F.array_repeat("row", good.cast("int"))).alias("row")).select("row.*")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from three quarters of the labels, scored for all documents."""
    docs = table(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (doc_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
