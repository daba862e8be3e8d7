"""Comparison of two snapshots and subtree refresh."""

from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX
from treeledger.operators import compare as C
from treeledger.operators import rollup as R
from treeledger.operators import scope_changes as S
from treeledger.operators.paging import last_rows, ordered_slice
from treeledger.plans import refresh as N
from treeledger.plans.report import comparison_lines
from treeledger.sources.store import catalog, default_pair, repair_directories
from treeledger.sources.workspace import materialize
from treeledger.workload import views as V
from treeledger.workload.registry import query

_ROW = "path, kind, baseline_size, current_size, delta_bytes"
_COUNTS = """count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'resized') AS resized, count(*) AS total, CAST(coalesce(sum(delta_bytes), 0) AS BIGINT) AS delta_bytes"""


def _changes(spark, sf, **options):
    return C.changes(V.old_files(spark, sf), V.new_files(spark, sf), **options)


@query("compare_rows", "E1 I2", ("changed",), f"SELECT {_ROW} FROM changed")
def compare_rows(spark, sf):
    return _changes(spark, sf)


@query("compare_counts", "F6", ("changed",), f"SELECT {_COUNTS} FROM changed")
def compare_counts(spark, sf):
    return C.change_counts(_changes(spark, sf))


@query("compare_scoped", "C6 E1", ("changed",), f"SELECT {_ROW} FROM changed WHERE starts_with(path, '/data/en/')")
def compare_scoped(spark, sf):
    return _changes(spark, sf, scope=POSIX.normalize("/data//fr/../en"))


@query("compare_scope_boundary", "C6", ("changed",), f"SELECT {_ROW} FROM changed WHERE starts_with(path, '/data/en/src1/')")
def compare_scope_boundary(spark, sf):
    """/data/en/src1 must not take in /data/en/src10 to /data/en/src19."""
    return _changes(spark, sf, scope="/data/en/src1")


@query("compare_kind", "D5 E1", ("changed",), f"SELECT {_ROW} FROM changed WHERE kind = 'resized'")
def compare_kind(spark, sf):
    return _changes(spark, sf, kind="resized")


@query("removed_only", "E3 D5", ("changed",), f"SELECT {_ROW} FROM changed WHERE kind = 'removed'")
def removed_only(spark, sf):
    return _changes(spark, sf, kind="removed")


@query("added_only", "E3 D5", ("changed",), f"SELECT {_ROW} FROM changed WHERE kind = 'added'")
def added_only(spark, sf):
    return _changes(spark, sf, kind="added")


@query("compare_search", "C7 E1", ("changed",), f"SELECT {_ROW} FROM changed WHERE contains(lower(path), '.tmp')")
def compare_search(spark, sf):
    return _changes(spark, sf, query=".TMP")


@query("compare_page", "H6", ("changed",), f"SELECT {_ROW} FROM changed ORDER BY path LIMIT 100 OFFSET 40")
def compare_page(spark, sf):
    return ordered_slice(_changes(spark, sf), [F.col("path")], 40, 100)


@query("compare_export", "B4 C8b", ("changed",), """
SELECT path, path || ',' || kind || ',' || coalesce(CAST(baseline_size AS VARCHAR), '') || ',' ||
  coalesce(CAST(current_size AS VARCHAR), '') || ',' || CAST(delta_bytes AS VARCHAR) || ',True,False' AS line FROM changed""")
def compare_export(spark, sf):
    flags = _changes(spark, sf).withColumn("baseline_coverage_complete", F.lit(True))
    return comparison_lines(flags.withColumn("current_coverage_complete", F.lit(False)))


@query("warehouse_changes", "E1", ("wh_old", "wh_new"), """
SELECT coalesce(b.path, a.path) AS path,
  CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'resized' END AS kind,
  b.size AS baseline_size, a.size AS current_size, coalesce(a.size, 0) - coalesce(b.size, 0) AS delta_bytes
FROM wh_old b FULL JOIN wh_new a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size""")
def warehouse_changes(spark, sf):
    return C.changes(V.old_orders(spark, sf), V.new_orders(spark, sf))


@query("warehouse_counts", "E1 F6", ("wh_old", "wh_new"), """
SELECT count(*) FILTER (b.path IS NULL) AS added, count(*) FILTER (a.path IS NULL) AS removed,
  count(*) FILTER (a.size <> b.size) AS resized,
  count(*) FILTER (a.path IS NULL OR b.path IS NULL OR a.size <> b.size) AS total,
  CAST(sum(coalesce(a.size, 0) - coalesce(b.size, 0)) AS BIGINT) AS delta_bytes
FROM wh_old b FULL JOIN wh_new a ON a.path = b.path""")
def warehouse_counts(spark, sf):
    return C.change_counts(C.changes(V.old_orders(spark, sf), V.new_orders(spark, sf)))


@query("warehouse_last_page", "E1 F6 H6", ("wh_old", "wh_new"), """
WITH changes AS (SELECT coalesce(b.path, a.path) AS path,
    CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'resized' END AS kind,
    b.size AS baseline_size, a.size AS current_size, coalesce(a.size, 0) - coalesce(b.size, 0) AS delta_bytes
  FROM wh_old b FULL JOIN wh_new a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size)
SELECT *, (SELECT count(*) FROM changes) AS total FROM changes ORDER BY path DESC LIMIT 100""")
def warehouse_last_page(spark, sf):
    """The totals of a comparison and the page at its far end, from rows that are worked out once."""
    rows = materialize(C.changes(V.old_orders(spark, sf), V.new_orders(spark, sf)))
    total = C.change_counts(rows).select("total").scalar()
    return last_rows(rows, ["path"], 100).withColumn("total", total)


@query("scope_known", "E6", ("dirs",), """
SELECT path, true AS known FROM dirs WHERE path = '/data/empty'
UNION ALL SELECT '/data/nowhere', false WHERE NOT EXISTS (SELECT 1 FROM dirs WHERE path = '/data/nowhere')""")
def scope_known(spark, sf):
    folders = [V.registered(V.old_files(spark, sf)), V.registered(V.new_files(spark, sf), V.EMPTY)]
    rows = [C.scope_known(folders, p).select(F.lit(p).alias("path"), "known") for p in (V.EMPTY, "/data/nowhere")]
    return rows[0].unionByName(rows[1])


def _summaries(spark, sf):
    """One summary per customer group of the orders; its newest order is its time."""
    group = F.col("o_custkey") % 100
    return V.table(spark, sf, "orders").groupBy(group.alias("g")).agg(
        F.max("o_orderkey").cast("double").alias("finished_at"),
        (F.count(F.lit(1)) % 3 != 0).alias("complete"), F.max("o_orderstatus").alias("status")).select(
        F.concat(F.lit("scan-"), F.col("g").cast("string")).alias("scan_id"), "complete",
        F.concat(F.lit("/wh/"), "status").alias("root"), "finished_at",
        (F.col("complete") & (F.col("g") % 2 == 0)).alias("coverage_complete"))


_SCANS = """
WITH scans AS (SELECT 'scan-' || CAST(o_custkey % 100 AS VARCHAR) AS id, max(o_orderkey) AS finished_at,
  CASE WHEN count(*) % 3 <> 0 THEN 'completed' ELSE 'partial' END AS state, '/wh/' || max(o_orderstatus) AS root,
  count(*) % 3 <> 0 AND o_custkey % 100 % 2 = 0 AS coverage
  FROM orders GROUP BY o_custkey % 100)"""


@query("snapshot_catalog", "A4", (), _SCANS + "SELECT id, state, root, finished_at FROM scans")
def snapshot_catalog(spark, sf):
    return catalog(_summaries(spark, sf)).withColumn("finished_at", F.col("finished_at").cast("bigint"))


@query("default_pair", "A5 G5", (), _SCANS + """
SELECT (SELECT id FROM scans ORDER BY finished_at DESC, id DESC LIMIT 1 OFFSET 1) AS baseline,
  (SELECT id FROM scans ORDER BY finished_at DESC, id DESC LIMIT 1) AS current""")
def pair(spark, sf):
    return default_pair(catalog(_summaries(spark, sf)))


@query("coverage_flags", "F12", (), _SCANS + """
SELECT a.coverage AS baseline_coverage_complete, b.coverage AS current_coverage_complete,
  a.coverage AND b.coverage AS coverage_complete
FROM scans a, scans b WHERE a.id = 'scan-4' AND b.id = 'scan-6'""")
def coverage_flags(spark, sf):
    summaries = _summaries(spark, sf)
    return C.pair_coverage(summaries.where("scan_id = 'scan-4'"), summaries.where("scan_id = 'scan-6'"))


def _classified(spark, sf):
    return S.classify(V.old_files(spark, sf), V.new_files(spark, sf), V.SCOPE)


@query("six_class_rows", "E2", ("six",), "SELECT path, kind, old_size, new_size FROM six")
def six_class_rows(spark, sf):
    return _classified(spark, sf)


@query("six_class", "E2", ("six",), """
SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'replaced') AS replaced, count(*) FILTER (kind = 'resized') AS resized,
  count(*) FILTER (kind = 'metadata_changed') AS metadata_changed, count(*) FILTER (kind = 'unchanged') AS unchanged
FROM six""")
def six_class(spark, sf):
    return S.summarize(_classified(spark, sf)).select("counts.*")


@query("six_class_scope_sizes", "F7", ("six",), """
SELECT CAST(1 AS BIGINT) AS schema_version, 'saved_file_metadata' AS basis, false AS content_verified,
  count(old_size) AS before_files, count(new_size) AS after_files,
  CAST(coalesce(sum(old_size), 0) AS BIGINT) AS before_bytes, CAST(coalesce(sum(new_size), 0) AS BIGINT) AS after_bytes,
  CAST(coalesce(sum(new_size), 0) - coalesce(sum(old_size), 0) AS BIGINT) AS delta_bytes FROM six""")
def six_class_scope_sizes(spark, sf):
    return S.summarize(_classified(spark, sf)).drop("counts")


_FILE = ["path", "parent", "name", "size", "allocated", "extension", "fingerprint", "device", "inode"]


@query("outside_scope", "D4", ("oldf",), """
SELECT path, size FROM oldf WHERE path <> '/data/en' AND NOT starts_with(path, '/data/en/')""")
def outside_scope(spark, sf):
    return N.outside(V.old_files(spark, sf), V.SCOPE).select("path", "size")


def _merged(spark, sf):
    return N.merge_files(V.old_files(spark, sf), V.new_files(spark, sf), V.SCOPE)


@query("refresh_files", "I3", ("merged",), f"SELECT {', '.join(_FILE)} FROM merged")
def refresh_files(spark, sf):
    return _merged(spark, sf).select(*_FILE)


def _merged_directories(spark, sf):
    old, new = V.old_files(spark, sf), V.new_files(spark, sf)
    return N.merge_directories(V.registered(old), V.registered(new, V.EMPTY), V.SCOPE)


@query("refresh_directories", "I4", ("mergeddirs",), "SELECT path FROM mergeddirs")
def refresh_directories(spark, sf):
    return _merged_directories(spark, sf)


@query("refresh_rollup", "F4 I4", ("merged", "mergeddirs"), """
SELECT d.path, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS size
FROM mergeddirs d LEFT JOIN merged f ON starts_with(f.path, d.path || '/') GROUP BY d.path""")
def refresh_rollup(spark, sf):
    return R.directory_totals(R.direct_bytes(_merged(spark, sf)), V.ROOT, _merged_directories(spark, sf))


@query("refresh_totals", "F15 F5 F1", ("merged",), """
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
  count(*) FILTER (starts_with(path, '/data/en/')) AS scanned_files,
  count(*) FILTER (NOT starts_with(path, '/data/en/')) AS reused_files,
  (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT max(size) AS s FROM merged GROUP BY device, inode)) AS unique_bytes
FROM merged""")
def refresh_totals(spark, sf):
    merged = _merged(spark, sf)
    scanned = F.count_if(POSIX.under(F.col("path"), V.SCOPE))
    return merged.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), scanned.alias("scanned_files"),
                      (F.count(F.lit(1)) - scanned).alias("reused_files")).withColumn(
        "unique_bytes", R.identity_sizes(merged).select("unique_bytes").scalar())


@query("root_repair", "N4", ("wh_new",), """
SELECT path, CAST(sum(size) AS BIGINT) AS size FROM (SELECT '/' AS path, size FROM wh_new
  UNION ALL SELECT '/wh', size FROM wh_new UNION ALL SELECT parent, size FROM wh_new
  UNION ALL SELECT regexp_replace(parent, '/[^/]*$', ''), size FROM wh_new) GROUP BY path""")
def root_repair(spark, sf):
    """A snapshot whose volume root was listed at twice its size, put right from the total."""
    files = V.new_orders(spark, sf)
    sizes = R.directory_totals(R.direct_bytes(files), "/")
    wrong = sizes.withColumn("size", F.when(F.col("path") == "/", F.col("size") * 2).otherwise(F.col("size")))
    return repair_directories(wrong, R.file_totals(files).withColumn("root", F.lit("/")))
