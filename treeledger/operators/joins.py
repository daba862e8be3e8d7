"""Joins that stay cheap on long paths and balanced when one key owns most rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it owns more than 1/SLICES of all rows, so there are fewer
# than SLICES heavy keys whatever the data; that bound is what allows the broadcast.
SLICES = 4096
MIN_HEAVY_ROWS = 100_000


def path_join(left: DataFrame, right: DataFrame, how: str, colocated: bool = False) -> DataFrame:
    """Join on path by way of its hash.

    Paths of one tree share long beginnings, which makes comparing them the main
    cost of a sort. Sorting and matching by hash first leaves the text comparison
    to rows that really meet. Tables bucketed by path need neither shuffle nor hash.
    """
    if colocated:
        return left.join(right, "path", how)
    left = left.withColumn("_hash", F.xxhash64("path"))
    right = right.withColumn("_hash", F.xxhash64("path"))
    return left.join(right, ["_hash", "path"], how).drop("_hash")


def only_paths(table: DataFrame, *wanted: DataFrame) -> DataFrame:
    """Rows of a big table at the paths of small ones.

    A semi join may broadcast the wanted paths, if Spark measures them as small
    enough, where the outer join that follows would have to shuffle the big table.
    """
    paths = wanted[0].toDF("path")
    for more in wanted[1:]:
        paths = paths.unionByName(more.toDF("path"))
    return table.join(paths.where(F.col("path").isNotNull()), "path", "left_semi")


def heavy_keys(counts: DataFrame, keys: list[str], rows: str = "_rows", slices: int = SLICES,
               at_least: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Heavy keys of a (keys, rows) count table with the number of slices each is cut into."""
    share = counts.agg(F.ceil(F.sum(rows) / slices)).scalar()
    limit = F.greatest(F.coalesce(share, F.lit(0)), F.lit(at_least))
    return counts.where(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).alias("_slices"))


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, spread_by: list[str],
                counts: DataFrame | None = None, slices: int = SLICES,
                at_least: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Join rows to a lookup table that holds every key once.

    The slices of a heavy key go to different tasks; its lookup row is repeated for
    each. The salt is part of the join key, so a later grouping on the same keys
    shuffles again after its partial step and never inherits a lopsided layout.
    counts may hand in rows per key (keys, _rows) where they are known already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = F.broadcast(heavy_keys(counts, keys, slices=slices, at_least=at_least))
    one = F.lit(1).cast("bigint")
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_slices", one))
    salted = rows.join(heavy, keys, "left").withColumn("_salt", salt).drop("_slices")
    repeats = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", one) - 1))
    repeated = lookup.join(heavy, keys, "left").withColumn("_salt", repeats).drop("_slices")
    # The hash comes first for the reason given at path_join.
    hashed = F.xxhash64(*keys, "_salt")
    return (salted.withColumn("_hash", hashed)
            .join(repeated.withColumn("_hash", hashed), ["_hash", *keys, "_salt"], how).drop("_hash", "_salt"))
