"""Quality classifier: a sparse ensemble of rules.

A random forest is grown on statistics of labelled texts; each path from a root to a node becomes a rule, a conjunction of
tests of statistics. A logistic model with a lasso penalty keeps a few rules, and the score of a text is one Spark column
expression over its statistics. Labels, language, source and id are never inputs of a score.

The forest and the lasso are fitted on at most MAX_LABELLED labelled rows (those with the least hash of the id); the score
is computed for every text.

Defined cases: null text counts as empty; rows with a null label teach nothing; with no labels, or labels of one kind
only, every score is the share of good labels (0.5 without any); rows that repeat, or have no doc_id, are scored once
each; a score equal to the cut passes; an id that has several labels teaches each; an empty table gives an empty result;
columns beside doc_id and text aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, written
from .stats import features, with_counts

MAX_LABELLED = 50_000
TREES, DEPTH, PENALTY = 12, 3, 0.002

Test = tuple[int, str, float]


@dataclass(frozen=True)
class RuleModel:
    """Statistics by number, rules as conjunctions of (statistic, <= or >, bound), a weight each, and the intercept."""

    names: tuple[str, ...]
    rules: tuple[tuple[tuple[Test, ...], float], ...]
    intercept: float

    def score(self, of: str = "stats") -> Column:
        columns = features(of)
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, [columns[n] for n in self.names]), F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple[Test, ...], columns: list[Column]) -> Column:
    out = F.lit(True)
    for k, sign, bound in rule:
        out = out & ((columns[k] <= bound) if sign == "<=" else (columns[k] > bound))
    return out


def paths(tree: str) -> list[tuple[Test, ...]]:
    """The conjunctions on the way to each inner and outer node of a tree in Spark's text form, the root left out."""
    stack, found = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEeNa]+)\)", line)
        if m:
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            found.append(tuple(x[1] for x in stack))
    return found


def train(labelled: DataFrame) -> RuleModel:
    """labelled: a column for each statistic, and label (0 or 1)."""
    names = tuple(features())
    graded = labelled.where("label in (0, 1)").select(*names, F.col("label").cast("double").alias("label"), "key")
    known = written(least_hashed(graded, MAX_LABELLED).drop("key"))
    n, good = known.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        share = min(max((good or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(names, (), math.log(share / (1 - share)))
    rows = VectorAssembler(inputCols=list(names), outputCol="x").transform(known).select("x", "label")
    forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=11, minInstancesPerNode=5).fit(rows)
    rules = list(dict.fromkeys(p for tree in forest.trees for p in paths(tree.toDebugString)))
    columns = [F.col(n) for n in names]
    marked = known.select("label", *[holds(r, columns).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marked).select("x", "label")
    fired.persist()
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(fired)
    fired.unpersist()
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return RuleModel(names, tuple((r, w) for r, w in zip(rules, weights) if w != 0.0), float(lasso.intercept))


def labelled_statistics(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """counted: doc_id, stats; labels: doc_id, label. One row for each pair that meets."""
    return counted.join(labels.where("label is not null").select(F.col("doc_id").alias("of"), "label"), F.col("doc_id") == F.col("of")).select("label", F.xxhash64("doc_id").alias("key"), *[c.alias(n) for n, c in features().items()])


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of docs; labels (doc_id, label) are all that may be learned from."""
    counted = written(with_counts(docs.select("doc_id", "text")).drop("text"))
    model = train(labelled_statistics(counted, labels))
    return counted.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs that score cut or more, with all their columns. Texts are written out with their statistics, which are counted once."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])
    counted = written(with_counts(held, "in_text"))
    model = train(labelled_statistics(counted.select(F.col("in_doc_id").alias("doc_id"), "stats"), labels))
    return counted.where(model.score() >= cut).select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
