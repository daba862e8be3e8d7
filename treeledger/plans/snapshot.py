"""Build a snapshot from a listing."""

import time
from threading import Event

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators import cleanup, digest, rollup
from treeledger.plans.budget import time_budget
from treeledger.schema import QUARANTINE_NAME, SUMMARY
from treeledger.sources.ingest import check_root, counts_of, errors_of, ingest, limit_scan, seen_by
from treeledger.sources.store import SnapshotStore

MEASUREMENT = "logical size, size with hard links counted once, allocated size; not an atomic view of a changing tree"


def ordered_rows(ranked: DataFrame, rank: list[Column], fields: list[str]) -> Column:
    """A short ranked table as one array of structs, in the order of rank."""
    packed = F.sort_array(F.collect_list(F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(rank)],
                                                  F.struct(*fields).alias("row"))))
    return ranked.agg(F.transform(packed, lambda r: r["row"])).scalar()


def summarize(files: DataFrame, directories: DataFrame, facts: dict) -> DataFrame:
    """The summary row of stored tables. facts gives the columns only the scan itself knows."""
    spark = files.sparkSession
    by_size = [-F.col("size"), F.col("path")]
    totals = rollup.file_totals(files).select(F.struct("files", "bytes")).scalar()
    sizes = rollup.identity_sizes(files).select(
        F.struct("unique_bytes", "allocated_bytes", "allocation_errors")).scalar()
    row = spark.range(1).select(
        totals.alias("t"), sizes.alias("s"),
        ordered_rows(rollup.largest_directories(directories), by_size, ["path", "size"]).alias("directories"),
        ordered_rows(rollup.largest_files(files), by_size, ["path", "size"]).alias("largest"))
    computed = {
        "files": F.col("t.files"), "bytes": F.col("t.bytes"), "inventory_files": F.col("t.files"),
        "unique_bytes": F.col("s.unique_bytes"), "allocated_bytes": F.col("s.allocated_bytes"),
        "allocation_errors": F.col("s.allocation_errors"), "directories": F.col("directories"),
        "largest": F.col("largest"), "details_complete": F.lit(True),
    } | facts
    empty = F.lit(None)
    return row.select(*[computed.get(f.name, empty).cast(f.dataType).alias(f.name) for f in SUMMARY.fields])


def build_snapshot(store: SnapshotStore, scan_id: str, listing: DataFrame, root: str, now: float,
                   temp_roots: list[str] = (), exclude_paths=(), max_files: int | None = None,
                   max_dirs: int | None = None, quarantine: str = QUARANTINE_NAME, links_followed: bool = False,
                   finished_at: float | None = None, rules: PathRules = POSIX, timeout_seconds: int | None = None,
                   cancel: Event | None = None) -> DataFrame:
    """Write a whole snapshot and return its summary row.

    timeout_seconds and the event cancel stop the job that is running; nothing is published then. The normalised files are written first; every aggregate then reads the columns
    it needs from that table, so nothing has to stay in executor memory.
    """
    started = time.monotonic()
    store.check_new(scan_id)
    root = rules.normalize(root)
    with time_budget(store.spark, timeout_seconds, cancel) as spent:
        check_root(listing, root)
        found = ingest(listing, root, exclude_paths, quarantine, links_followed, rules, written=True)
        files, folders, errors, counted = found.files, found.directories, found.errors, found.counts
        complete: Column = F.lit(True)
        if max_files is not None or max_dirs is not None:
            files, folders, state = limit_scan(files, folders, max_files, max_dirs)
            complete = state.select("complete").scalar()
        store.claim(scan_id)
        files = store.write_table(scan_id, "files", files)
        if max_files is not None or max_dirs is not None:
            seen = seen_by(found.rows, files, folders, state, root)
            errors, counted = errors_of(seen), counts_of(seen)
        sizes = rollup.directory_totals(rollup.direct_bytes(files), root, folders, rules)
        chosen = cleanup.candidates(cleanup.eligible(files, now, list(temp_roots), root, rules=rules), now)
        tables = store.write_tables(scan_id, {
            "directories": rollup.describe_directories(sizes, rules), "errors": errors,
            "digests": digest.directory_digests(digest.direct_digests(files), root, folders, rules),
            "extensions": rollup.by_extension(files), "candidates": chosen})
        planned = cleanup.candidate_totals(tables["candidates"]).select(F.struct("candidates", "bytes")).scalar()
        counts = counted.select(F.struct("errors", "skipped")).scalar()
        end = time.time() if finished_at is None else finished_at
        facts = {
            "root": F.lit(root), "errors": counts["errors"], "skipped": counts["skipped"], "complete": complete,
            "coverage_complete": complete & (counts["errors"] == 0), "finished_at": F.lit(float(end)),
            "candidate_files": planned["candidates"], "candidate_bytes": planned["bytes"],
            "elapsed_seconds": F.lit(round(time.monotonic() - started, 3)), "measurement": F.lit(MEASUREMENT),
        }
        spent.check()
        return store.publish(scan_id, summarize(files, tables["directories"], facts))
