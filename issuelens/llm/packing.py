"""Packing into length buckets that waste the least padding.

The lengths of all documents give one histogram, exact at every length: d different lengths need d * d / 2 tokens at
least, so the table that the driver gets has at most the square root of twice the corpus's tokens in rows. Dynamic
programming over it picks the bucket bounds with the least padding; the best split of a prefix never moves left as the
prefix grows, so each round halves the ranges to look in. Inside each bucket, documents fill batches of budget // bound
rows, so that a padded batch holds at most budget tokens. Places are numbered in shards and shifted by the sums of the
shards before, so a bucket of any size is dealt out over many tasks and only its last batch is short.

Defined cases: null and empty texts have length 0 and go to the first bucket; a document longer than the budget is a
batch of its own; rows that repeat, or have no doc_id, are packed once each and spread over the shards like all others;
an empty table gives an empty result; columns beside doc_id and text aren't looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

SHARD_ROWS = 50_000


def _round(best: np.ndarray, upto: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: the least padding of each prefix of the lengths, and where its last bucket begins (the leftmost place)."""
    size = len(long)
    new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
    new[0] = 0.0
    #: Prefixes first to last, whose last bucket begins from low to high.
    first, last, low, high = (np.array([x]) for x in (1, size, 0, size - 1))
    while len(first):
        mid = (first + last) // 2
        top = np.minimum(high, mid - 1)
        width = top - low + 1
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        j = np.repeat(mid, width)
        cost = best[at] + (upto[j] - upto[at]) * long[j - 1]
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        least = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(least, width))
        own = np.searchsorted(start, hit, "right") - 1
        _, leftmost = np.unique(own, return_index=True)
        split = at[hit[leftmost]]
        new[mid], cut[mid] = least, split
        left, right = mid > first, mid < last
        first, last, low, high = (np.concatenate(x) for x in ((first[left], mid[right] + 1), (mid[left] - 1, last[right]), (low[left], split[right]), (split[left], high[right])))
    return new, cut


def bounds(lengths: list[int] | np.ndarray, counts: list[int] | np.ndarray, buckets: int) -> list[int]:
    """Largest length of each bucket: at most so many of the ascending lengths, so that the padding is least."""
    size = len(lengths)
    if size == 0:
        return []
    # Padded tokens less the documents' own, which no choice changes.
    long = np.asarray(lengths, np.float64)
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    best, back = np.concatenate([[0.0], np.full(size, np.inf)]), []
    for _ in range(min(buckets, size)):
        best, cut = _round(best, upto, long)
        back.append(cut)
    out, j = [], size
    for cut in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, budget: int = 65_536, buckets: int = 16, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot for each row of docs; length defaults to the words of text."""
    tokens = F.coalesce(length if length is not None else n_words(), F.lit(0)).cast("long").alias("n_tokens")
    sized = written(docs.select("doc_id", tokens, F.monotonically_increasing_id().alias("row")))
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")
    lengths, counts = histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    tops = bounds(lengths, counts, buckets) or [0]
    upto = np.concatenate([[0], np.cumsum(counts)])
    rows = np.diff(upto[np.searchsorted(lengths, [-1, *tops], "right")])
    chosen = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket"))
    bucket = F.lit(1) + sum(((F.col("n_tokens") > t).cast("int") for t in tops[:-1]), F.lit(0))
    dealt = sized.withColumn("bucket", bucket)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("row"), chosen([-(-n // SHARD_ROWS) or 1 for n in rows]).cast("long")))
    shards = dealt.groupBy("bucket", "shard").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row")) - 1
    placed = dealt.withColumn("place", place).join(shards.select("bucket", "shard", before.alias("before")), ["bucket", "shard"])
    at, room = F.col("before") + F.col("place"), chosen([max(1, budget // max(1, t)) for t in tops]).cast("long")
    return placed.select("doc_id", "n_tokens", "bucket", chosen(tops).cast("long").alias("bucket_len"), F.floor(at / room).alias("batch"), (at % room).alias("slot"))
