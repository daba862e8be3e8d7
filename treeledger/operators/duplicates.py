"""Files with equal content: size classes first, digests only for what is left."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import own_path
from treeledger.operators.joins import lookup_join, path_join


def size_window(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that are not empty and, with max_bytes, not larger than that."""
    filled = files.where("size > 0")
    return filled if max_bytes is None else filled.where(F.col("size") <= max_bytes)


def size_classes(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Sizes that more than one file has."""
    counts = size_window(files, max_bytes).groupBy("size").agg(F.count(F.lit(1)).alias("files"))
    return counts.where("files > 1")


def one_per_identity(files: DataFrame) -> DataFrame:
    """One name per (device, inode): the first by path. Hard links are not copies; unknown inodes link nothing."""
    first = F.min(F.struct("path", "fingerprint")).alias("first")
    return (files.groupBy("size", "device", "inode", own_path()).agg(first)
            .select("size", "device", "inode", "first.path", "first.fingerprint"))


def duplicate_candidates(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Distinct files that share their size with at least one other distinct file."""
    single = one_per_identity(size_window(files, max_bytes))
    counts = single.groupBy("size").agg(F.count(F.lit(1)).alias("_rows"))
    classes = counts.where("_rows > 1").select("size", F.col("_rows").alias("identities"))
    return lookup_join(single, classes, ["size"], "inner", ["path"], counts)


# Bits of the filter: so many a class, but at least and at most so many.
CLASS_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29


def possibly_of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose size may be among those of classes: all that are, and few others.

    A bitmap by hash of the size goes to the rows; so rows that carry content are dropped
    where they are read and never moved. It has CLASS_BITS bits for each class, which lets
    one row in sixteen through that should not pass, and MOST_BITS at the most: 64 MB,
    whatever the data. Beyond 33 million classes it therefore lets more rows through; a
    join with the classes themselves follows in any case.
    """
    wanted = classes.agg(F.least(F.greatest(F.count(F.lit(1)) * CLASS_BITS, F.lit(LEAST_BITS)), F.lit(MOST_BITS))).scalar()
    place = F.pmod(F.xxhash64("size"), wanted) + 1
    bits = (classes.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))
    placed = rows.withColumn("_bit", F.bitmap_bit_position(place)).withColumn("_bucket", F.bitmap_bucket_number(place))
    byte = F.expr("conv(hex(substring(_bits, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10)").cast("int")
    held = F.bit_get(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1
    return placed.join(F.broadcast(bits), "_bucket").where(held).select(*rows.columns)


def recheck(candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """Mark candidates whose fingerprint is no longer the one of the scan, or that are gone."""
    now = observed.select("path", F.col("fingerprint").alias("seen"))
    return (path_join(candidates, now, "left")
            .withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("seen"))).drop("seen"))


def class_bytes(readable: DataFrame) -> DataFrame:
    """What reading each size class costs."""
    return readable.groupBy("size").agg(F.sum("size").alias("bytes"))


def candidate_bytes(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The same for all candidates of an inventory, from counts alone."""
    single = size_window(files, max_bytes).select("size", "device", "inode", own_path()).distinct()
    counts = single.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select("size", (F.col("size") * F.col("n")).alias("bytes"))


def within_budget(classes: DataFrame, budget: int) -> DataFrame:
    """Size classes, smallest first, with the bytes read once each is done, as far as the budget goes.

    The running total is taken in two steps over bands of sizes, the band of a size being
    its square root. Sizes are distinct integers, so neither the number of bands nor the
    classes in one can pass about twice the root of the largest size (2 million for files
    of a terabyte). A class costs at least twice its size, so the bands that begin within
    the budget are fewer than the cube root of twice the budget; that bounds the broadcast.
    """
    banded = classes.withColumn("band", F.floor(F.sqrt(F.col("size").cast("double"))))
    bands = banded.groupBy("band").agg(F.sum("bytes").alias("_bytes"))
    all_before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = bands.select("band", F.coalesce(F.sum("_bytes").over(all_before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("band").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = banded.join(F.broadcast(starts.where(F.col("_start") < budget)), "band").select(
        "size", "bytes", (F.col("_start") + F.sum("bytes").over(inside)).alias("read_bytes"))
    return running.where(F.col("read_bytes") <= budget)


def of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return lookup_join(rows, classes.select("size"), ["size"], "left_semi", ["path"])


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """One row per repeated content; potential_bytes is what keeping one copy would free."""
    return _with_potential(_copies(hashed).where("_rows > 1"))


def duplicate_members(hashed: DataFrame) -> DataFrame:
    """One row per path of every duplicate group, never a list that grows with the group."""
    counts = _copies(hashed)
    repeated = _with_potential(counts.where("_rows > 1"))
    return lookup_join(hashed.select("size", "sha256", "path"), repeated, ["size", "sha256"], "inner", ["path"], counts)


def _copies(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("_rows"))


def _with_potential(counts: DataFrame) -> DataFrame:
    copies = F.col("_rows")
    return counts.select("size", "sha256", copies.alias("copies"),
                         (F.col("size") * (copies - 1)).alias("potential_bytes"))


def rank_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("potential_bytes"), "sha256")
