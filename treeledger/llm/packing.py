"""Packing token sequences into batches with the least padding."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeledger.sources.workspace import materialize

MAX_LENGTH, BUCKETS, BUDGET = 2048, 8, 16384


def word_count(text: str) -> Column:
    r"""Number of words, runs of characters other than space and \t to \r; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding.

    lengths ascends. best[j] is the least padding of the first j lengths in k buckets; the
    last bucket from i to j pads everything to lengths[j-1]. Of equally good starts the
    first is taken.
    """
    n = len(lengths)
    size = np.array(lengths, np.int64)
    rows = np.r_[0, np.cumsum(np.array(counts, np.int64))]
    held = np.r_[0, np.cumsum(np.array(counts, np.int64) * size)]
    huge = np.iinfo(np.int64).max // 2
    best, choices = np.r_[0, np.full(n, huge)], []
    for _ in range(min(buckets, n)):
        after, chosen = np.full(n + 1, huge), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (held[j] - held[:j])
            chosen[j] = cost.argmin()
            after[j] = min(cost[chosen[j]], huge)
        best = after
        choices.append(chosen)
    bounds, j = [], n
    for chosen in reversed(choices):
        bounds.append(int(size[j - 1]))
        j = int(chosen[j])
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, doc_id: str = "doc_id", max_length: int = MAX_LENGTH, buckets: int = BUCKETS,
         budget: int = BUDGET) -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, n_tokens, bucket, bucket_length, batch, slot.

    A document longer than max_length is cut into pieces of that length and a rest. The
    global histogram of piece lengths has at most max_length rows; dynamic programming over
    it picks the bucket bounds. A batch is budget // bucket_length pieces of one bucket, in
    the order of doc_id, and only the last batch of a bucket may be smaller. Batch numbers
    run over all buckets. A document without tokens has one piece of length 0 and no place.
    Repeated rows are packed as often as they occur; a null id sorts first.
    """
    if max_length > budget:
        raise ValueError("a piece must fit the token budget")
    size = F.lit(max_length).cast("bigint")
    last = F.greatest(F.floor((F.col("_n") - 1) / max_length), F.lit(0)).cast("bigint")
    pieces = docs.select(F.col(doc_id).alias("doc_id"), length.cast("bigint").alias("_n"))
    pieces = pieces.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * size).alias("start"),
                           F.least(size, F.col("_n") - F.col("piece") * size).alias("n_tokens"))
    pieces = materialize(pieces)
    histogram = sorted((r[0], r[1]) for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect())
    bounds = best_bounds([n for n, _ in histogram], [c for _, c in histogram], buckets)
    bucket, upper, capacity, offset, total, low = (F.lit(None).cast("bigint"),) * 4 + (0, 0)
    for i, bound in enumerate(bounds):
        here = (F.col("n_tokens") > low) & (F.col("n_tokens") <= bound)
        values = (i, bound, budget // bound, total)
        bucket, upper, capacity, offset = (F.when(here, F.lit(v).cast("bigint")).otherwise(old)
                                           for v, old in zip(values, (bucket, upper, capacity, offset)))
        total += -(-sum(c for n, c in histogram if low < n <= bound) // (budget // bound))
        low = bound
    return _placed(pieces.withColumn("bucket", bucket), upper, capacity, offset)


def _placed(pieces: DataFrame, upper: Column, capacity: Column, offset: Column) -> DataFrame:
    """Rank the pieces within their buckets where a range sort has put them.

    Each written part of the sort knows how many pieces of which bucket it holds. These
    counts (parts plus buckets in number) give every part the rank that it starts from.
    """
    key = ["bucket", "doc_id", "piece", "n_tokens"]
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    laid = pieces.repartitionByRange(*key).sortWithinPartitions(*key)
    laid = materialize(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    parts = laid.groupBy("_part", "bucket").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.col("bucket").alias("_bucket"), "_first",
                         F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    parts = F.broadcast(parts.withColumnRenamed("_part", "_p"))
    ranked = laid.join(parts,
                       (F.col("_part") == F.col("_p")) & F.col("bucket").eqNullSafe(F.col("_bucket")), "left")
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return ranked.select("doc_id", "piece", "start", "n_tokens", "bucket", upper.alias("bucket_length"),
                         (offset + F.floor(rank / capacity)).alias("batch"),
                         F.when(F.col("bucket").isNotNull(), F.pmod(rank, capacity)).alias("slot"))


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Pack documents by their number of words."""
    return pack(docs, word_count(text), doc_id, **options)
