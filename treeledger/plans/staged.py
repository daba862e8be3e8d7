"""Read possible duplicates in stages: a little of all, more only of those that are still equal."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.joins import lookup_join, path_join
from treeledger.sources.workspace import materialize

FIRST, GROWTH, BLOCK = 64 << 10, 16, 64 << 20
Reader = Callable[[DataFrame], DataFrame]


def still_equal(rows: DataFrame) -> DataFrame:
    """Rows whose class another row is in as well; classes of any size are split over tasks."""
    counts = materialize(rows.groupBy("class").agg(F.count(F.lit(1)).alias("_rows")))
    repeated = counts.where("_rows > 1").select("class")
    return lookup_join(rows, repeated, ["class"], "left_semi", ["path"], counts)


def _refined(rows: DataFrame, digests: DataFrame, first: int) -> DataFrame:
    """Rows with the class that their new digest puts them in; null where nothing could be read."""
    named = digests.select("path", F.col("sha256").alias("_digest"))
    return path_join(rows, named, "left").withColumn(
        "class", F.sha2(F.concat("class", F.lit("/"), "_digest"), 256)).withColumn(
        "whole", F.coalesce("whole", F.when(F.col("size") <= first, F.col("_digest")))).drop("_digest")


def staged_digests(candidates: DataFrame, read: Reader, whole: Reader, first: int = FIRST, growth: int = GROWTH,
                   block: int = BLOCK) -> DataFrame:
    """path and sha256 of candidates (path, fingerprint, size); null for what could not be read.

    read turns rows (path, fingerprint, size, start, length) into (path, start, sha256) of that
    range, the last one of a file up to its end. A class is the size and the digests so far;
    whoever is alone in its class is read no further and gets that class in place of a
    digest, marked `unique:`. The ranges grow until they reach a block; what is left of a
    file is then read in blocks by as many tasks as there are blocks. whole, (path,
    fingerprint, size) to (path, sha256), reads one file of each class that remains, and all
    of a class whose first one has changed meanwhile.
    """
    live = candidates.select("path", "fingerprint", "size", F.sha2(F.col("size").cast("string"), 256).alias("class"),
                             F.lit(None).cast("string").alias("whole"))
    columns, settled = live.columns, []

    def narrowed(rows: DataFrame) -> DataFrame:
        rows = materialize(rows.select(*columns))
        equal = materialize(still_equal(rows.where("class IS NOT NULL")).select(*columns))
        alone = path_join(rows, equal.select("path"), "left_anti")
        settled.append(alone.select("path", F.concat(F.lit("unique:"), "class").alias("sha256")))
        return equal

    start, length = 0, first
    while True:
        todo = live.where(F.col("size") > start)
        if start and todo.isEmpty():
            break
        last = length >= block
        ranges = F.sequence(F.lit(start).cast("bigint"), F.col("size") - 1, F.lit(block).cast("bigint")) if last else F.array(
            F.lit(start).cast("bigint"))
        asked = todo.select("path", "fingerprint", "size", F.explode(ranges).alias("start"), F.lit(block if last else length).cast("bigint").alias("length"))
        found = read(asked)
        if last:
            parts = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "sha256"))).alias("parts"),
                                              F.bool_and(F.col("sha256").isNotNull()).alias("all"))
            found = parts.select("path", F.when(F.col("all"), F.sha2(F.array_join("parts.sha256", "/"), 256)).alias("sha256"))
        live = narrowed(live.where(F.col("size") <= start).unionByName(_refined(todo, found, first)) if start else _refined(todo, found, first))
        if last:
            break
        start, length = start + length, min(length * growth, block)

    known = live.where("whole IS NOT NULL").select("path", F.col("whole").alias("sha256"))
    rest = live.where("whole IS NULL")
    heads = rest.groupBy("class").agg(F.min(F.struct("path", "fingerprint", "size")).alias("head"), F.count(F.lit(1)).alias("_rows"))
    heads = materialize(heads.select("class", "head.*", "_rows"))
    read_heads = path_join(heads.select("path", "class"), whole(heads.select("path", "fingerprint", "size")), "left")
    read_heads = materialize(read_heads.select("class", "sha256"))
    shared = lookup_join(rest, read_heads, ["class"], "inner", ["path"], heads.select("class", "_rows"))
    changed = shared.where("sha256 IS NULL").select("path", "fingerprint", "size")
    out = known.unionByName(shared.where("sha256 IS NOT NULL").select("path", "sha256")).unionByName(
        path_join(changed.select("path"), whole(changed), "left").select("path", "sha256"))
    for part in settled:
        out = out.unionByName(part)
    return out
