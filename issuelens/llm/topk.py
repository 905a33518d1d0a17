"""Exact top-k by integer inner product, a term at a time.

Vectors are cut into blocks, queries too; each pair of blocks is a task. Inside it, the components of a block of vectors
are postings by term (dimension): for each query row, each of its non-zero terms adds its weighted postings into a dense
array of scores, the k best are selected by partition, and the winners of all blocks are merged.

Defined cases: a vector that is null, holds a null or a non-finite component, or has no vec_id takes no part; shorter
vectors have zeros behind; rows that share a vec_id are rows like any others: each is a candidate of the other, and as a
query each has a ranking of its own; a query with fewer than k other
rows gets all of them; ties go to the smaller vec_id; an empty table gives an empty result; other columns aren't looked
at. Components are held to the range of a long after scaling; products and sums are 64-bit integers and wrap around.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, QUERIES = 8192, 2048


def whole(column: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) for each component x as double."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(column: str = "embedding") -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(F.col(column), bad)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def best_of(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, vector id, score) of the k best of each query among the vectors of other rows."""
    postings = []
    for t in range(vectors.shape[1]):
        at = np.flatnonzero(vectors[:, t])
        postings.append((slice(None) if len(at) == len(ids) else at, np.ascontiguousarray(vectors[at, t])))
    found = []
    for q, own in zip(queries, query_rows):
        score = np.zeros(len(ids), np.int64)
        for t in np.flatnonzero(q):
            at, weights = postings[t]
            score[at] += q[t] * weights
        other = np.flatnonzero(rows != own)
        if len(other) > k:
            least = np.partition(score[other], len(other) - k)[len(other) - k]
            other = other[score[other] >= least]
        order = other[np.lexsort((ids[other], -score[other]))][:k]
        found += [(int(own), int(ids[j]), int(score[j])) for j in order]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: vec_id long, terms array<long>."""
    # Rows are numbered in a table, so that a number stays with its row.
    vectors = written(vectors.select("vec_id", "terms").withColumn("row", F.monotonically_increasing_id()))
    rows = vectors.count()
    blocks, query_blocks = -(-rows // BLOCK) or 1, -(-vectors.where(is_query).count() // QUERIES) or 1
    own = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.withColumn("block", own(blocks)).withColumn("query_block", every(query_blocks))
    asked = vectors.where(is_query).withColumn("query_block", own(query_blocks)).withColumn("block", every(blocks))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max((len(x) for side in (left, right) for x in side["terms"]), default=0)
        both = len(left) and len(right)
        found = best_of(_matrix(left["terms"], width), left["vec_id"].to_numpy(), left["row"].to_numpy(), _matrix(right["terms"], width), right["row"].to_numpy(), k) if both else []
        return pd.DataFrame(found, columns=["query_row", "vec_id", "score"]).astype("int64")

    near = held.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInPandas(meet, "query_row long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id")))
    best = near.withColumn("rank", place).where(F.col("rank") <= k)
    names = vectors.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_row").select("query_id", "rank", "vec_id", "score")
