"""Order-independent digests of directories, by which equal ones are told without looking at their files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.joins import lookup_join, path_join

PARTS = ("a", "b")


def direct_digests(files: DataFrame) -> DataFrame:
    """Per directory the files immediately in it: their number and 128 bits made of their paths and sizes.

    Paths are unique, so exclusive-or over the files' hashes does not depend on an order
    and nothing cancels out.
    """
    hashes = [F.xxhash64("path", "size"), F.xxhash64(F.lit("second"), "size", "path")]
    return files.groupBy(F.col("parent").alias("path")).agg(
        *[F.bit_xor(h).alias(name) for h, name in zip(hashes, PARTS)], F.count(F.lit(1)).alias("files"))


def directory_digests(direct: DataFrame, root: str, registered: DataFrame, rules: PathRules = POSIX) -> DataFrame:
    """path, parent, own_* for the files right in each directory, and all_* for everything beneath it."""
    path, zero = F.col("path"), F.lit(0).cast("bigint")
    above = direct.where(rules.inside(path, root)).select(
        F.explode(rules.lineage(path, root)).alias("to"), *PARTS, "files", path.alias("own"))
    rows = above.select(F.col("to").alias("path"), *PARTS, "files", (F.col("to") == F.col("own")).alias("here"))
    empty = registered.select("path", *[zero.alias(c) for c in (*PARTS, "files")], F.lit(True).alias("here"))
    here = F.col("here")
    found = rows.unionByName(empty).groupBy("path").agg(
        *[F.coalesce(F.bit_xor(F.when(here, F.col(c))), zero).alias(f"own_{c}") for c in PARTS],
        F.coalesce(F.sum(F.when(here, F.col("files"))), zero).alias("own_files"),
        *[F.bit_xor(c).alias(f"all_{c}") for c in PARTS], F.sum("files").alias("all_files"))
    return found.withColumn("parent", rules.parent(path))


def differing(old: DataFrame, new: DataFrame, scope: str | None = None, rules: PathRules = POSIX) -> DataFrame:
    """Directories (parent, old_files, new_files) whose own files differ between two digest tables.

    A directory in an equal subtree is equal itself; it drops out by its own digest. Equal
    digests of the whole scope let the reader of the result skip everything.
    """
    def side(table: DataFrame, prefix: str) -> DataFrame:
        rows = table.where(rules.inside(F.col("path"), scope)) if scope else table
        return rows.select("path", *[F.col(f"own_{c}").alias(f"{prefix}_{c}") for c in (*PARTS, "files")])

    both = path_join(side(old, "old"), side(new, "new"), "full_outer")
    zero = F.lit(0).cast("bigint")
    unlike: Column = F.lit(False)
    for c in (*PARTS, "files"):
        unlike = unlike | (F.coalesce(f"old_{c}", zero) != F.coalesce(f"new_{c}", zero))
    return both.where(unlike).select(F.col("path").alias("parent"), F.coalesce("old_files", zero).alias("old_files"),
                                     F.coalesce("new_files", zero).alias("new_files"))


def files_of(files: DataFrame, directories: DataFrame, rows: str) -> DataFrame:
    """The files right in the given directories; the column `rows` tells how many each has, so that large ones are split."""
    chosen = directories.select("parent")
    return lookup_join(files, chosen, ["parent"], "left_semi", ["path"], directories.select("parent", F.col(rows).alias("_rows")))
