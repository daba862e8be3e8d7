"""What differs between two snapshots, by path and logical size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.functions.text import contains_text
from treeledger.operators.joins import path_join
from treeledger.schema import COMPARISON_KINDS


def check_kind(kind: str) -> None:
    if kind != "all" and kind not in COMPARISON_KINDS:
        raise ValueError(f"kind must be all or one of {COMPARISON_KINDS}")


def in_scope(files: DataFrame, scope: str | None, query: str = "", rules: PathRules = POSIX) -> DataFrame:
    """Path filters hold for the join key, so they are applied to both sides before the join."""
    if scope:
        files = files.where(rules.under(F.col("path"), scope))
    return files.where(contains_text(F.col("path"), query)) if query else files


def changes(baseline: DataFrame, current: DataFrame, scope: str | None = None, query: str = "",
            kind: str = "all", rules: PathRules = POSIX, colocated: bool = False) -> DataFrame:
    """Rows (path, kind, baseline_size, current_size, delta_bytes); equal sizes are left out.

    removed means no longer observed. One full outer join finds all kinds; a single
    kind gets the narrower join it needs. colocated says both sides are bucketed by path.
    """
    check_kind(kind)
    old = in_scope(baseline, scope, query, rules).select("path", F.col("size").alias("baseline_size"))
    new = in_scope(current, scope, query, rules).select("path", F.col("size").alias("current_size"))
    before, after = F.col("baseline_size"), F.col("current_size")
    if kind == "removed":
        rows = path_join(old, new, "left_anti", colocated).withColumn("current_size", F.lit(None).cast("bigint"))
    elif kind == "added":
        rows = path_join(new, old, "left_anti", colocated).withColumn("baseline_size", F.lit(None).cast("bigint"))
    elif kind == "resized":
        rows = path_join(old, new, "inner", colocated).where(before != after)
    else:
        rows = path_join(old, new, "full_outer", colocated).where(before.isNull() | after.isNull() | (before != after))
    label = F.when(after.isNull(), "removed").when(before.isNull(), "added").otherwise("resized")
    delta = F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))
    return rows.select("path", label.alias("kind"), "baseline_size", "current_size", delta.alias("delta_bytes"))


def change_counts(changed: DataFrame) -> DataFrame:
    """One row: how many of each kind, how many in all, and the net change in bytes."""
    kind = F.col("kind")
    counts = [F.count_if(kind == name).alias(name) for name in COMPARISON_KINDS]
    return changed.agg(*counts, F.count(F.lit(1)).alias("total"),
                       F.coalesce(F.sum("delta_bytes"), F.lit(0)).alias("delta_bytes"))


def scope_known(directories: list[DataFrame], scope: str) -> DataFrame:
    """One row telling whether any of the snapshots registered the directory."""
    hits: Column = F.lit(False)
    for table in directories:
        hits = hits | table.where(F.col("path") == scope).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return directories[0].sparkSession.range(1).select(hits.alias("known"))


def pair_coverage(baseline_summary: DataFrame, current_summary: DataFrame) -> DataFrame:
    """Coverage flags of both snapshots (one-row tables) and of the pair."""
    first = baseline_summary.select("coverage_complete").scalar()
    second = current_summary.select("coverage_complete").scalar()
    return baseline_summary.sparkSession.range(1).select(
        first.alias("baseline_coverage_complete"), second.alias("current_coverage_complete"),
        (first & second).alias("coverage_complete"))
