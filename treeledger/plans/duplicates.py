"""Review a snapshot for files with equal content."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators import duplicates as D
from treeledger.operators.joins import path_join
from treeledger.operators.links import ids_under
from treeledger.sources.workspace import materialize


@dataclass(frozen=True)
class DuplicateReview:
    """groups: one row per content. members: one row per path. meta: one row."""

    groups: DataFrame
    members: DataFrame
    meta: DataFrame


def find_duplicates(files: DataFrame, digest: Callable[[DataFrame], DataFrame], observed: DataFrame | None = None,
                    budget: int | None = None, max_bytes: int | None = None,
                    details_complete: bool = True, links: DataFrame | None = None, top: str = "/",
                    rules: PathRules = POSIX) -> DuplicateReview:
    """Candidates by size, checked against observed, read within the budget, grouped by digest.

    digest turns (path, fingerprint, size) rows into (path, sha256); a missing or null
    digest counts as an error, and so does a file with one of links on the way down from
    top: it is never read. Candidates and digests are each kept in the work folder,
    so content is read once and everything after starts from those tables.
    """
    candidates = D.duplicate_candidates(files, max_bytes)
    checked = candidates.withColumn("changed", F.lit(False)) if observed is None else D.recheck(candidates, observed)
    if links is not None:
        named = checked.select(F.col("path").alias("id"), "path")
        linked = ids_under(named, ["path"], links, top, rules).select(F.col("id").alias("path"), F.lit(True).alias("linked"))
        checked = path_join(checked, linked, "left").withColumn("changed", F.col("changed") | F.col("linked").isNotNull())
    checked = materialize(checked)
    readable = checked.where(~F.col("changed"))
    costs = D.class_bytes(readable)
    kept = costs if budget is None else D.within_budget(costs, budget)
    chosen = readable if budget is None else D.of_classes(readable, kept)
    # The side that reads content stays on its own: digests meet sizes by path afterwards.
    digests = digest(chosen.select("path", "fingerprint", "size"))
    hashed = materialize(path_join(chosen.select("path", "size"), digests, "left"))
    good = hashed.where(F.col("sha256").isNotNull())
    errors = (checked.agg(F.count_if(F.col("changed"))).scalar()
              + hashed.agg(F.count_if(F.col("sha256").isNull())).scalar())
    spent = F.coalesce(good.agg(F.sum("size")).scalar(), F.lit(0))
    wanted = F.coalesce(readable.agg(F.sum("size")).scalar(), F.lit(0))
    over = F.lit(False) if budget is None else wanted > budget
    large = F.lit(0).cast("bigint") if max_bytes is None else files.agg(F.count_if(F.col("size") > max_bytes)).scalar()
    meta = files.sparkSession.range(1).select(
        (~over & (large == 0) & F.lit(details_complete)).alias("complete"), errors.alias("errors"), spent.alias("read_bytes"),
        F.when(over, F.lit("read budget reached")).alias("reason"), large.alias("left_out"))
    return DuplicateReview(D.duplicate_groups(good), D.duplicate_members(good), meta)
