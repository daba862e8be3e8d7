"""Observe one subtree again and publish the mixture as a new snapshot."""

import time
from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators import digest, rollup
from treeledger.operators import scope_changes as X
from treeledger.plans.budget import TimedOut, time_budget
from treeledger.plans.snapshot import summarize
from treeledger.schema import QUARANTINE_NAME, REFRESH
from treeledger.sources.ingest import check_root, ingest
from treeledger.sources.store import TABLES, SnapshotStore, repair_directories
from treeledger.sources.workspace import materialize

MEASUREMENT = "mixed times: only the selected subtree was observed again, the rest is the baseline; no candidates"


RefreshTimedOut = TimedOut


def outside(rows: DataFrame, selected: str, rules: PathRules = POSIX) -> DataFrame:
    return rows.where(~rules.inside(F.col("path"), selected))


def merge_files(baseline: DataFrame, observed: DataFrame, selected: str, rules: PathRules = POSIX) -> DataFrame:
    """Baseline rows outside the subtree and all newly observed rows inside; they cannot meet."""
    return outside(baseline, selected, rules).unionByName(observed.where(rules.under(F.col("path"), selected)))


def merge_directories(baseline: DataFrame, observed: DataFrame, selected: str,
                      rules: PathRules = POSIX) -> DataFrame:
    kept = outside(baseline.select("path"), selected, rules)
    return kept.unionByName(observed.select("path").where(rules.inside(F.col("path"), selected))).distinct()


def check_scope(store: SnapshotStore, baseline: str, selected: str, rules: PathRules = POSIX):
    """The baseline's summary facts, or ValueError when this subtree cannot be refreshed."""
    facts = store.summary(baseline).select(
        "root", "finished_at", "coverage_complete", "details_complete",
        F.col("refresh").isNotNull().alias("refreshed")).first()
    if facts is None or not facts["coverage_complete"] or not facts["details_complete"] or facts["refreshed"]:
        raise ValueError("a refresh needs a full baseline with complete coverage that is no refresh itself")
    root = facts["root"]
    if not rules.is_absolute(selected) or ".." in rules.components(selected) or selected == root:
        raise ValueError("select a directory below the root of the baseline")
    if not rules.contains(root, selected):
        raise ValueError("the directory lies outside the baseline")
    if store.read(baseline, "directories").where(F.col("path") == selected).isEmpty():
        raise ValueError("the directory is not registered in the baseline")
    return facts


def refreshed_directories(store: SnapshotStore, baseline: str, selected: str, root: str, found,
                          rules: PathRules = POSIX) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """For directories and digests: data files to refer to, rows to copy from touched ones, and rows of the subtree.

    A directory above the subtree changes by what the subtree's own total or digest changed;
    nothing outside is added up again.
    """
    above, step = [], selected
    while step != root:
        step = rules.parent_of(step)
        above.append(step)
    places = [rules.parent_of(p) for p in (selected, *above)]
    path = F.col("path")
    sizes = rollup.directory_totals(rollup.direct_bytes(found.files), selected, found.directories, rules)
    inside = {"directories": rollup.describe_directories(sizes, rules),
              "digests": digest.directory_digests(digest.direct_digests(found.files), selected, found.directories, rules)}
    out = {}
    for table, columns in (("directories", ["size"]), ("digests", ["all_a", "all_b", "all_files"])):
        whole, touched = store.parted(baseline, table, selected, places, rules)
        if table == "directories":
            touched = repair_directories(touched, store.summary(baseline))
        new = materialize(inside[table].select(*TABLES[table].fieldNames()))
        at = [rows.where(path == selected).select(*columns).first() for rows in (touched, new)]
        was, now = ([row[c] for c in columns] if row else [0] * len(columns) for row in at)
        rows = outside(touched, selected, rules)
        for column, before, after in zip(columns, was, now):
            value = F.col(column)
            moved = (value.bitwiseXOR(F.lit(before ^ after)) if column in ("all_a", "all_b") else value + F.lit(after - before))
            rows = rows.withColumn(column, F.when(path.isin(*above), moved).otherwise(value))
        out[table] = (whole, rows, new)
    return out


def refresh(store: SnapshotStore, baseline: str, selected: str, target: str, listing: DataFrame,
            exclude_paths=(), quarantine: str = QUARANTINE_NAME, links_followed: bool = False,
            timeout_seconds: int = 300, finished_at: float | None = None,
            rules: PathRules = POSIX, cancel: Event | None = None) -> DataFrame:
    """Write snapshot target from the baseline and a fresh listing of selected; return its summary.

    Data files of the baseline that the subtree does not touch are referred to; only the
    others are written again, without the subtree's old rows. cancel and the end of the time
    stop the running job; nothing is published then.
    """
    if type(timeout_seconds) is not int or not 1 <= timeout_seconds <= 3600:
        raise ValueError("timeout_seconds must be an int between 1 and 3600")
    store.check_new(target)
    with time_budget(store.spark, timeout_seconds, cancel) as budget:
        old = check_scope(store, baseline, selected, rules)
        check_root(listing, selected)
        found = ingest(listing, selected, exclude_paths, quarantine, links_followed, rules, written=True)
        counts = found.counts.first()
        if counts["errors"]:
            raise ValueError("the subtree was not observed completely; nothing is published")
        observed = found.files
        whole, touched = store.parted(baseline, "files", selected, rules=rules)
        changes = X.summarize(X.classify(touched, observed, selected, rules)).first()
        budget.check()
        store.claim(target)
        store.write_table(target, "files", observed, stored=outside(touched, selected, rules))
        budget.check()
        shared = whole
        for table, (rest, copied, new) in refreshed_directories(store, baseline, selected, old["root"], found, rules).items():
            store.write_table(target, table, new, stored=copied)
            shared = shared.unionByName(rest)
        manifest = store.write_manifest(target, shared)
        reused = manifest.where("table = 'files'").agg(F.sum("rows")).first()[0] or 0
        reused -= counts["files"]
        files, directories = store.unpublished(target, "files"), store.unpublished(target, "directories")
        store.write_tables(target, {"errors": found.errors, "extensions": rollup.by_extension(files),
                                    "candidates": store.read(baseline, "candidates").limit(0)})

        end = time.time() if finished_at is None else finished_at
        elapsed = budget.check()
        about = {
            "baseline_id": baseline, "baseline_finished_at": old["finished_at"], "path": selected,
            "scanned_files": counts["files"], "reused_files": reused, "observed_at": float(end),
            "selected_coverage_complete": True, "timeout_seconds": timeout_seconds,
            "elapsed_before_sync_seconds": elapsed, "outside_revalidated": False,
            "changes": changes.asDict(recursive=True),
        }
        note = store.spark.createDataFrame([(about,)], T.StructType([T.StructField("refresh", REFRESH)]))
        facts = {
            "root": F.lit(old["root"]), "errors": F.lit(counts["errors"]), "skipped": F.lit(counts["skipped"]),
            "complete": F.lit(True), "coverage_complete": F.lit(False), "finished_at": F.lit(float(end)),
            "candidate_files": F.lit(0), "candidate_bytes": F.lit(0), "elapsed_seconds": F.lit(elapsed),
            "measurement": F.lit(MEASUREMENT), "refresh": note.select("refresh").scalar(),
        }
        return store.publish(target, summarize(files, directories, facts))
