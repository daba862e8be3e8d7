"""Totals, extension breakdown, directory sizes, hard-link-aware sizes and rankings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules, own_path
from treeledger.schema import TOP_DIRECTORIES, TOP_FILES


def file_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def rank_extensions(extensions: DataFrame) -> DataFrame:
    return extensions.orderBy(F.desc("bytes"), "extension")


def direct_bytes(files: DataFrame) -> DataFrame:
    """Bytes of the files lying immediately in each directory."""
    return files.groupBy(F.col("parent").alias("path")).agg(F.sum("size").alias("size"))


def directory_totals(direct: DataFrame, root: str, registered: DataFrame | None = None,
                     rules: PathRules = POSIX) -> DataFrame:
    """Recursive size of every directory above a file; registered ones without files count 0.

    direct holds one row per directory, so the fan-out to ancestors is directories
    times depth, never files times depth. Registered directories join the same
    aggregation as zero rows, which saves a join.
    """
    path = F.col("path")
    seeds = direct.where(rules.inside(path, root)).select(F.explode(rules.lineage(path, root)).alias("path"), "size")
    if registered is not None:
        seeds = seeds.unionByName(registered.select("path", F.lit(0).cast("bigint").alias("size")))
    return seeds.groupBy("path").agg(F.sum("size").alias("size"))


def describe_directories(totals: DataFrame, rules: PathRules = POSIX) -> DataFrame:
    path = F.col("path")
    return totals.select("path", rules.parent(path).alias("parent"), rules.name(path).alias("name"), "size")


def identities(files: DataFrame) -> DataFrame:
    return files.select("device", "inode", own_path()).distinct().drop("_own")


def identity_sizes(files: DataFrame) -> DataFrame:
    """Sizes that count each (device, inode) once, however many names it has; unknown inodes are all different."""
    once = files.groupBy("device", "inode", own_path()).agg(F.max("size").alias("size"), F.max("allocated").alias("allocated"))
    return once.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum("allocated"), F.lit(0)).alias("allocated_bytes"),
        F.count_if(F.col("allocated").isNull()).alias("allocation_errors"))


def largest_files(files: DataFrame, n: int = TOP_FILES, tie: str = "path") -> DataFrame:
    """Biggest files; equal sizes by path ascending, or descending with tie='scan'."""
    last = F.desc("path") if tie == "scan" else F.asc("path")
    return files.select("path", "size").orderBy(F.desc("size"), last).limit(n)


def largest_directories(directories: DataFrame, n: int = TOP_DIRECTORIES) -> DataFrame:
    return directories.select("path", "size").orderBy(F.desc("size"), "path").limit(n)


def share_of_total(sizes: DataFrame, total: DataFrame) -> DataFrame:
    """Bar length in percent, at least 1; total is a one-row table (bytes)."""
    whole = F.greatest(total.select("bytes").scalar(), F.lit(1))
    return sizes.withColumn("share", F.greatest(F.lit(1.0), F.col("size") / whole * 100))
