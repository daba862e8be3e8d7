"""Six exclusive classes of change inside one subtree, from saved metadata only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.joins import path_join
from treeledger.schema import SCOPE_CLASSES


def classify(previous: DataFrame, observed: DataFrame, selected: str, rules: PathRules = POSIX,
             colocated: bool = False) -> DataFrame:
    """One row per path of the subtree with its class and both sizes.

    Precedence runs top to bottom: a replaced file that also changed size counts as
    replaced. An inode of 0 is unknown and never proves a replacement. Device and
    inode are compared as text, exactly.
    """
    def side(files: DataFrame, mark: str) -> DataFrame:
        kept = files.where(rules.under(F.col("path"), selected))
        return kept.select("path", *[F.col(c).alias(f"{mark}_{c}") for c in ("size", "device", "inode", "fingerprint")])

    both = path_join(side(previous, "old"), side(observed, "new"), "full_outer", colocated)
    known = (F.col("old_inode") != "0") & (F.col("new_inode") != "0")
    moved = (F.col("old_device") != F.col("new_device")) | (F.col("old_inode") != F.col("new_inode"))
    kind = (F.when(F.col("old_size").isNull(), "added")
            .when(F.col("new_size").isNull(), "removed")
            .when(known & moved, "replaced")
            .when(F.col("old_size") != F.col("new_size"), "resized")
            .when(F.col("old_fingerprint") != F.col("new_fingerprint"), "metadata_changed")
            .otherwise("unchanged"))
    return both.select("path", kind.alias("kind"), "old_size", "new_size")


def summarize(classified: DataFrame) -> DataFrame:
    """One row of counts and sizes. unchanged says nothing about content."""
    counts = [F.count_if(F.col("kind") == name).alias(name) for name in SCOPE_CLASSES]
    totals = classified.agg(
        *counts, F.count("old_size").alias("before_files"), F.count("new_size").alias("after_files"),
        F.coalesce(F.sum("old_size"), F.lit(0)).alias("before_bytes"),
        F.coalesce(F.sum("new_size"), F.lit(0)).alias("after_bytes"))
    return totals.select(
        F.lit(1).alias("schema_version"), F.lit("saved_file_metadata").alias("basis"),
        F.lit(False).alias("content_verified"), F.struct(*SCOPE_CLASSES).alias("counts"),
        "before_files", "after_files", "before_bytes", "after_bytes",
        (F.col("after_bytes") - F.col("before_bytes")).alias("delta_bytes"))
