"""Quality rules: fixed limits, then an isolation forest on rule statistics.

Each tree splits a small sample of documents at random bounds of random statistics; a document that random splits set
apart after few steps is anomalous. The limit on the anomaly score is calibrated from all labelled rows, counted by label
and fine bin of the score: it rejects the largest share of the bad ones, less GOOD_COUNTS times the share of the good ones.

The trees see TREES x SAMPLE documents (those of least hash of the id, spread over the corpus): what the driver gets is
twice as many rows of twelve numbers at most, and BINS counts a label. Statistics, scores and the limit cover every
document.

Defined cases: null text is empty, fails the base rule and isn't kept; without labelled rows of both kinds the method
rejects nothing; rows that repeat get the same result once each, ties at the limit are kept; an id that has several labels
counts for each; labels other than 0 and 1 count for nothing; an empty table gives an empty result; columns beside doc_id
and text aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, written
from .stats import features, with_counts

TREES, SAMPLE = 100, 256
#: Anomaly scores, from 0 to 1, are told apart to one part in BINS where the limit is chosen.
BINS = 1 << 14
GOOD_COUNTS = 10


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean steps of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: split statistic (-1: leaf), bound, left child (the right one follows), path length of leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.per = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.per, replace=False)], rng) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        deepest = int(np.ceil(np.log2(max(2, len(rows)))))
        feature, bound, child, length = [], [], [], []

        def add() -> int:
            for x, v in ((feature, -1), (bound, 0.0), (child, 0), (length, 0.0)):
                x.append(v)
            return len(feature) - 1

        todo = [(add(), np.arange(len(rows)), 0)]
        while todo:
            at, members, depth = todo.pop()
            low, high = rows[members].min(0), rows[members].max(0)
            wide = np.flatnonzero(high > low)
            if depth >= deepest or len(members) < 2 or not len(wide):
                length[at] = depth + float(_mean_path(len(members)))
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            left, right = add(), add()
            feature[at], bound[at], child[at] = f, cut, left
            under = rows[members, f] <= cut
            todo += [(left, members[under], depth + 1), (right, members[~under], depth + 1)]
        return np.array(feature), np.array(bound), np.array(child), np.array(length)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher: more anomalous."""
        total = np.zeros(len(rows))
        for feature, bound, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                at[inner] = child[here] + (rows[np.flatnonzero(inner), feature[here]] > bound[here])
            total += length[at]
        usual = float(_mean_path(self.per)) or 1.0
        return 2.0 ** (-(total / max(1, len(self.trees))) / usual)


def limit_from(good: np.ndarray, bad: np.ndarray) -> float:
    """Scores above this are rejected; good and bad hold the number of rows in each of BINS bins."""
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda n: 1 - np.cumsum(n) / n.sum()
    return float(np.argmax(above(bad) - GOOD_COUNTS * above(good)) + 1) / BINS


def base_failed():
    return (F.col("stats.n_words") < 50) | (100 * F.col("stats.n_repeat_words") > 50 * F.col("stats.n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stats, base_failed, anomaly, kept for each row of docs. labels: doc_id, label (1: good)."""
    names = list(features())
    counted = written(with_counts(docs.select("doc_id", "text")).drop("text").select("doc_id", "stats", F.array(*features().values()).alias("x"), base_failed().alias("base_failed")))
    hashed = counted.where("not base_failed").select("doc_id", "x", F.xxhash64("doc_id").alias("key"))
    seen = least_hashed(hashed, TREES * SAMPLE, "x").select("x").toPandas()
    forest = Forest(np.array(seen["x"].tolist(), np.float64).reshape(-1, len(names)))

    @F.pandas_udf("double")
    def anomaly(x: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.array(x.tolist(), np.float64).reshape(-1, len(names))))

    scored = written(counted.withColumn("anomaly", anomaly("x")).drop("x"))
    graded = labels.where("label in (0, 1)").select(F.col("doc_id").alias("of"), "label")
    known = scored.where("not base_failed").join(graded, F.col("doc_id") == F.col("of"))
    # A score on the edge of two bins belongs to the lower one, as it is kept where the edge is the limit.
    found = known.groupBy("label", F.ceil(F.col("anomaly") * BINS).alias("bin")).count().collect()
    counts = np.zeros((2, BINS))
    for r in found:
        counts[int(r["label"]), min(max(r["bin"] - 1, 0), BINS - 1)] += r["count"]
    limit = limit_from(counts[1], counts[0])
    return scored.select("doc_id", "stats", "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") <= limit)).alias("kept"))
