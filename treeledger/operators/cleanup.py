"""Which temporary files qualify for cleanup, and whether a selection still does."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.functions.text import age_days
from treeledger.operators.joins import only_paths
from treeledger.operators.links import ids_under, rows_by_marked_parent
from treeledger.operators.tree import rows_under
from treeledger.sources.workspace import materialize
from treeledger.schema import (
    CLEANUP_AGE_DAYS, CLEANUP_EXTENSIONS, DAY_SECONDS, LIVE_STATES, QUARANTINE_NAME, QUARANTINE_QUOTA_BYTES,
)


def old_temporary(extension: Column, modified: Column, now: float) -> Column:
    age = CLEANUP_AGE_DAYS * DAY_SECONDS
    # The first comparison is a second too wide and only there for the Parquet reader.
    aged = (modified <= F.lit(float(now - age + 1))) & (F.lit(float(now)) - modified >= age)
    return extension.isin(*CLEANUP_EXTENSIONS) & aged


def under_roots(files: DataFrame, roots: list[str] | DataFrame, rules: PathRules = POSIX) -> DataFrame:
    """Files below any root: a pushed-down prefix test for a list, a sweep over all parents for a table."""
    if isinstance(roots, DataFrame):
        return rows_under(files, roots, "left_semi", rules)
    return files.where(rules.under_any(F.col("path"), roots))


def eligible(files: DataFrame, now: float, temp_roots: list[str] | DataFrame, top: str,
             links: DataFrame | None = None, rules: PathRules = POSIX) -> DataFrame:
    """Old .tmp and .log files below a temporary root, with no link on the way down."""
    aged = files.where(old_temporary(F.col("extension"), F.col("modified"), now))
    kept = under_roots(aged, temp_roots, rules)
    return kept if links is None else rows_by_marked_parent(kept, links, top, "left_anti", rules)


def candidates(eligible_files: DataFrame, now: float, n: int | None = None) -> DataFrame:
    """All, or the first n by path. Ids depend on path and fingerprint only, so a rerun repeats them."""
    ident = F.left(F.sha2(F.concat_ws("\n", "path", "fingerprint"), 256), F.lit(32))
    first = eligible_files if n is None else eligible_files.orderBy("path").limit(n)
    return first.select(ident.alias("id"), "path", "size", "fingerprint",
                        age_days(F.col("modified"), now).alias("age_days"))


def candidate_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def bad_ids(selection: DataFrame, found: DataFrame) -> DataFrame:
    """Selected ids that are repeated or that no candidate has."""
    counted = selection.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    repeated = counted.where("times > 1").select("id", F.lit("repeated").alias("reason"))
    unknown = counted.select("id").join(found, "id", "left_anti").select("id", F.lit("unknown").alias("reason"))
    return repeated.unionByName(unknown)


def quarantine_path(path: Column, ident: Column, temp_roots: list[str], quarantine: str = QUARANTINE_NAME,
                    rules: PathRules = POSIX) -> Column:
    """Where a file would be set aside: in the quarantine of the first root above it; else null."""
    folder = F.lit(None).cast("string")
    for root in reversed(temp_roots):
        folder = F.when(rules.under(path, root), F.lit(rules.prefix(root) + quarantine + rules.sep)).otherwise(folder)
    return F.concat(folder, ident)


def revalidate(selection: DataFrame, found: DataFrame, fresh: DataFrame, now: float, temp_roots: list[str],
               quarantine: str = QUARANTINE_NAME, rules: PathRules = POSIX, links: DataFrame | None = None,
               top: str = "/") -> DataFrame:
    """A verdict per selected id against a fresh listing; one failure condemns the batch.

    fresh is a files table. Only its rows at the selected paths and their planned
    destinations matter; both joins are by unique path. With links (paths below top), a
    file with a link on the way to either end is not eligible.
    """
    chosen = selection.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    planned = chosen.join(found, "id", "left").withColumn(
        "destination", quarantine_path(F.col("path"), F.col("id"), temp_roots, quarantine, rules))
    near = only_paths(fresh, planned.select("path"), planned.select("destination"))
    seen = near.select("path", F.col("fingerprint").alias("seen"), F.col("extension").alias("seen_extension"),
                        F.col("modified").alias("seen_modified"))
    taken = near.select(F.col("path").alias("destination"), F.lit(True).alias("taken"))
    # Unknown ids have no path; a key of their own keeps them from meeting in one task.
    def key(end: str) -> Column:
        return F.coalesce(F.col(end), F.concat(F.lit("\0"), F.col("id")))

    joined = (planned.withColumn("_path", key("path")).withColumn("_destination", key("destination"))
              .join(seen.withColumnRenamed("path", "_path"), "_path", "left")
              .join(taken.withColumnRenamed("destination", "_destination"), "_destination", "left"))
    still = old_temporary(F.col("seen_extension"), F.col("seen_modified"), now) & F.col("destination").isNotNull()
    if links is not None:
        linked = ids_under(planned, ["path", "destination"], links, top, rules)
        joined = joined.join(linked.withColumn("linked", F.lit(True)), "id", "left")
        still = still & F.col("linked").isNull()
    verdict = (F.when(F.col("times") > 1, "repeated").when(F.col("path").isNull(), "unknown")
               .when(~F.col("fingerprint").eqNullSafe(F.col("seen")), "changed")
               .when(~F.coalesce(still, F.lit(False)), "ineligible")
               .when(F.col("taken").isNotNull(), "collision").otherwise("ok"))
    return joined.select("id", "path", "destination", "size", "fingerprint", verdict.alias("verdict"))


def batch_allowed(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col("verdict") == "ok").alias("ok"),
                        F.coalesce(F.bool_and(F.col("verdict") == "ok"), F.lit(False)).alias("allowed"))


def quota(moves: DataFrame, selected: DataFrame, limit: int = QUARANTINE_QUOTA_BYTES) -> DataFrame:
    """Whether what is retained already plus the selected sizes stays within the quota."""
    held = moves.where(F.col("state").isin(*LIVE_STATES)).agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    asked = F.coalesce(F.sum("size"), F.lit(0))
    sums = selected.agg(asked.alias("selected_bytes")).withColumn("retained_bytes", held)
    return sums.select("retained_bytes", "selected_bytes",
                       (F.col("retained_bytes") + F.col("selected_bytes") <= limit).alias("allowed"))


def selection_plan(verdicts: DataFrame, moves: DataFrame, now: float, batch: str,
                   limit: int = QUARANTINE_QUOTA_BYTES) -> DataFrame:
    """Journal rows for the whole batch, or none at all. The verdicts are worked out once and kept."""
    verdicts = materialize(verdicts)
    valid = batch_allowed(verdicts).select("allowed").scalar()
    room = quota(moves, verdicts.where("verdict = 'ok'"), limit).select("allowed").scalar()
    return verdicts.where(valid & room).select(
        "id", F.col("path").alias("source"), "destination", "size", "fingerprint",
        F.lit("pending").alias("state"), F.lit(float(now)).alias("created"), F.lit(batch).alias("batch"))
