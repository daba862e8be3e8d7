"""Ingest, totals, roll-up and rankings."""

from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions import text as X
from treeledger.functions.paths import POSIX
from treeledger.operators import browse as B
from treeledger.operators import rollup as R
from treeledger.schema import QUARANTINE_NAME
from treeledger.sources import ingest as I
from treeledger.workload import views as V
from treeledger.workload.registry import query

_SEEN = "kind = 'f' AND NOT contains(path, '/.quarantine/')"


def _listing(spark, sf):
    return V.raw_listing(spark, sf, QUARANTINE_NAME)


def whole_seconds(df):
    return df.withColumn("modified", F.col("modified").cast("bigint"))


@query("ingest_listing", "A1 C1 C2 C3", ("newf",), """
SELECT path, parent, name, size, allocated, extension, modified, modified * 1000000000 AS mtime_ns, device, inode,
  '1:' || inode || ':' || CAST(size AS VARCHAR) || ':' || CAST(modified * 1000000000 AS VARCHAR) AS fingerprint
FROM newf""")
def ingest_listing(spark, sf):
    return whole_seconds(I.ingest(_listing(spark, sf), V.ROOT).files)


@query("ingest_directories", "A1 I4", ("dirs",), "SELECT path FROM dirs")
def ingest_directories(spark, sf):
    return I.ingest(_listing(spark, sf), V.ROOT).directories


@query("scan_totals", "A1 F1 F13", ("listing", "errors"), f"""
SELECT count(*) FILTER ({_SEEN}) AS files, CAST(sum(size) FILTER ({_SEEN}) AS BIGINT) AS bytes,
  (SELECT count(*) FROM errors) AS errors, count(*) FILTER (kind = 'l' OR path = '/data/en/.quarantine') AS skipped
FROM listing""")
def scan_totals(spark, sf):
    denied = V.access_errors(spark, sf).select(F.concat("path", F.lit(".denied")).alias("path"), "error")
    return I.ingest(_listing(spark, sf).unionByName(denied, allowMissingColumns=True), V.ROOT).counts


@query("ingest_followed_links", "A1 D1", ("newf",), "SELECT path, size FROM newf")
def ingest_followed_links(spark, sf):
    """A lister that walked through links: what it found there is dropped."""
    files = V.new_files(spark, sf)
    link = F.concat("parent", F.lit("/lnk-"), F.col("doc_id").cast("string"))
    beyond = files.where("doc_id % 25 = 1").select(
        F.concat(link, F.lit("/deep/"), "name").alias("path"), F.lit("f").alias("kind"), "size", "allocated",
        "modified", "device", "inode")
    return I.ingest(_listing(spark, sf).unionByName(beyond), V.ROOT, links_followed=True).files.select("path", "size")


@query("excluded_paths", "D3", ("newf",), """
SELECT path, size FROM newf
WHERE NOT starts_with(path, '/data/fr/') AND NOT starts_with(path, '/data/en/3/')""")
def excluded_paths(spark, sf):
    found = I.ingest(_listing(spark, sf), V.ROOT, exclude_paths=["/data/fr", "/data/en/x/../3"])
    return found.files.select("path", "size")


@query("exclusion_counts", "D3 F1", ("listing",), f"""
SELECT count(*) FILTER ({_SEEN}) AS files, CAST(sum(size) FILTER ({_SEEN}) AS BIGINT) AS bytes,
  CAST(0 AS BIGINT) AS errors,
  count(*) FILTER (kind = 'l' OR path IN ('/data/en/.quarantine', '/data/fr', '/data/en/3')) AS skipped
FROM listing WHERE NOT starts_with(path, '/data/fr/') AND NOT starts_with(path, '/data/en/3/')""")
def exclusion_counts(spark, sf):
    return I.ingest(_listing(spark, sf), V.ROOT, exclude_paths=["/data/fr", "/data/en/3"]).counts


@query("scan_file_limit", "D2", ("newf",), """
SELECT path, size, (SELECT count(*) <= 150 FROM newf) AS complete FROM newf ORDER BY path LIMIT 150""")
def scan_file_limit(spark, sf):
    files = V.new_files(spark, sf)
    kept, _, state = I.limit_scan(files, V.registered(files), max_files=150)
    return kept.select("path", "size", state.select("complete").scalar().alias("complete"))


@query("scan_directory_limit", "D2", ("newf", "dirs"), """
SELECT path, size, (SELECT count(*) <= 30 FROM dirs) AS complete FROM newf
WHERE parent IN (SELECT path FROM dirs ORDER BY path LIMIT 30)""")
def scan_directory_limit(spark, sf):
    files = V.new_files(spark, sf)
    kept, _, state = I.limit_scan(files, V.registered(files, V.EMPTY), max_dirs=30)
    return kept.select("path", "size", state.select("complete").scalar().alias("complete"))


_ODD = ["a.tar.gz", ".bashrc", "foo.", "..foo", "A.TXT", "none", ".a.B", "tr.ail. "]


@query("path_parts", "C1 C2", (), r"""
WITH p AS (SELECT '/data/' || lang || '/' || CAST(doc_id AS VARCHAR) || '/' || CASE doc_id % 8
  WHEN 0 THEN 'a.tar.gz' WHEN 1 THEN '.bashrc' WHEN 2 THEN 'foo.' WHEN 3 THEN '..foo' WHEN 4 THEN 'A.TXT'
  WHEN 5 THEN 'none' WHEN 6 THEN '.a.B' ELSE 'tr.ail. ' END AS path FROM documents),
n AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '/([^/]*)$', 1) AS name FROM p)
SELECT path, parent, name, coalesce(nullif(lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)), ''), '(无扩展名)') AS extension
FROM n""")
def path_parts(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in _ODD]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), names)
    rows = V.table(spark, sf, "documents").select(path.alias("path"))
    name = POSIX.name(F.col("path"))
    return rows.select("path", POSIX.parent(F.col("path")).alias("parent"), name.alias("name"),
                       P.extension(name).alias("extension"))


@query("identity_facts", "C3 C4", ("logs",), """
SELECT path, '7:' || inode || ':' || CAST(size AS VARCHAR) || ':' || CAST(modified * 1000000000 AS VARCHAR) AS fingerprint,
  allocated FROM logs""")
def identity_facts(spark, sf):
    return V.log_files(spark, sf).select("path", "fingerprint", "allocated")


@query("file_ages", "C9", ("logs",), """
SELECT path, CAST(trunc((1706745600 - modified) / 86400.0) AS BIGINT) AS age_days FROM logs""")
def file_ages(spark, sf):
    return V.log_files(spark, sf).select("path", X.age_days(F.col("modified"), 1706745600).alias("age_days"))


@query("by_extension", "F2", ("newf",), """
SELECT extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM newf GROUP BY extension""")
def by_extension(spark, sf):
    return R.by_extension(V.new_files(spark, sf))


@query("extension_ranking", "H9 F2", ("newf",), """
SELECT extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM newf GROUP BY extension
ORDER BY bytes DESC, extension LIMIT 12""")
def extension_ranking(spark, sf):
    return R.rank_extensions(R.by_extension(V.new_files(spark, sf))).limit(12)


@query("direct_bytes", "F3", ("newf",), """
SELECT parent AS path, CAST(sum(size) AS BIGINT) AS size FROM newf GROUP BY parent""")
def direct_bytes(spark, sf):
    return R.direct_bytes(V.new_files(spark, sf))


def _directories(spark, sf):
    files = V.new_files(spark, sf)
    sizes = R.directory_totals(R.direct_bytes(files), V.ROOT, V.registered(files, V.EMPTY))
    return R.describe_directories(sizes)


@query("dir_rollup", "F4 C2", ("dirsizes",), """
SELECT path, CASE WHEN parent = '' THEN '/' ELSE parent END AS parent, name, size FROM dirsizes""")
def dir_rollup(spark, sf):
    return _directories(spark, sf)


@query("log_rollup", "F3 F4", ("logs",), """
SELECT path, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT '/logs' AS path, size FROM logs UNION ALL SELECT parent, size FROM logs
  UNION ALL SELECT regexp_replace(parent, '/[^/]*$', ''), size FROM logs) GROUP BY path""")
def log_rollup(spark, sf):
    return R.directory_totals(R.direct_bytes(V.log_files(spark, sf)), "/logs")


@query("warehouse_rollup", "F3 F4", ("wh_new",), """
SELECT path, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT '/' AS path, size FROM wh_new UNION ALL SELECT '/wh', size FROM wh_new UNION ALL SELECT parent, size FROM wh_new
  UNION ALL SELECT regexp_replace(parent, '/[^/]*$', ''), size FROM wh_new) GROUP BY path""")
def warehouse_rollup(spark, sf):
    """From the volume root, which is its own parent and counts once."""
    return R.directory_totals(R.direct_bytes(V.new_orders(spark, sf)), "/")


@query("hardlink_sizes", "F5 E5", ("newf",), """
SELECT CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(allocated), 0) AS BIGINT) AS allocated_bytes,
  count(*) FILTER (allocated IS NULL) AS allocation_errors
FROM (SELECT max(size) AS size, max(allocated) AS allocated FROM newf GROUP BY device, inode)""")
def hardlink_sizes(spark, sf):
    return R.identity_sizes(V.new_files(spark, sf))


@query("distinct_identities", "F16 E5", ("newf",), "SELECT DISTINCT device, inode FROM newf")
def distinct_identities(spark, sf):
    return R.identities(V.new_files(spark, sf))


@query("top_files", "H1", ("newf",), "SELECT path, size FROM newf ORDER BY size DESC, path LIMIT 200")
def top_files(spark, sf):
    return R.largest_files(V.new_files(spark, sf))


@query("top_files_scan_order", "H1", ("newf",), "SELECT path, size FROM newf ORDER BY size DESC, path DESC LIMIT 200")
def top_files_scan_order(spark, sf):
    return R.largest_files(V.new_files(spark, sf), tie="scan")


@query("top_dirs", "H2", ("dirsizes",), "SELECT path, size FROM dirsizes ORDER BY size DESC, path LIMIT 100")
def top_dirs(spark, sf):
    return R.largest_directories(_directories(spark, sf))


@query("share_of_total", "G3", ("dirsizes", "newf"), """
SELECT path, size, greatest(1.0, CAST(size AS DOUBLE) / greatest((SELECT CAST(sum(size) AS BIGINT) FROM newf), 1) * 100) AS share
FROM dirsizes ORDER BY size DESC, path LIMIT 100""")
def share_of_total(spark, sf):
    return R.share_of_total(R.largest_directories(_directories(spark, sf)), R.file_totals(V.new_files(spark, sf)))


@query("access_errors", "A6 C12", ("errors",), """
SELECT path || '.denied' AS path, error AS reason FROM errors""")
def access_errors(spark, sf):
    denied = V.access_errors(spark, sf).select(F.concat("path", F.lit(".denied")).alias("path"), "error")
    return I.ingest(_listing(spark, sf).unionByName(denied, allowMissingColumns=True), V.ROOT).errors


def _errors(spark, sf):
    return V.access_errors(spark, sf).select("path", F.col("error").alias("reason"))


@query("errors_page", "H7 A6", ("errors",), """
SELECT path, error AS reason FROM errors ORDER BY path LIMIT 100 OFFSET 5""")
def errors_page(spark, sf):
    return B.error_page(_errors(spark, sf), 5).items


@query("errors_next_page", "H7", ("errors",), """
SELECT path, error AS reason FROM errors ORDER BY path LIMIT 100 OFFSET 3""")
def errors_next_page(spark, sf):
    """Goes on behind the third row, whose whole reason is part of the key."""
    errors = _errors(spark, sf)
    last = errors.orderBy("path").offset(2).limit(1)
    known = {"path": F.lit(last.select("path").scalar()), "reason": F.lit(last.select("reason").scalar())}
    return B.error_page(errors, after=known).items


def _denied(spark, sf):
    """The tree with a third of its directories and its root denied."""
    listing = _listing(spark, sf).withColumn("error", F.lit(None).cast("string"))
    folders = V.registered(V.new_files(spark, sf), V.EMPTY).select(
        "path", F.lit("d").alias("kind"), F.when(F.length("path") % 3 == 2, F.lit("denied")).alias("error"))
    return listing.where("kind <> 'd'").unionByName(folders, allowMissingColumns=True)


_DENIED = "length(path) % 3 = 2"


@query("denied_directories", "A1 A6", ("dirs",), """
SELECT path FROM dirs""")
def denied_directories(spark, sf):
    """A directory that could not be read is registered all the same."""
    return I.ingest(_denied(spark, sf), V.ROOT).directories


@query("denied_root_counts", "A1 F12 F13", ("dirs", "newf"), f"""
SELECT (SELECT count(*) FROM newf) AS files, (SELECT count(*) FROM dirs WHERE {_DENIED}) AS errors,
  (SELECT count(*) FROM dirs WHERE {_DENIED} AND path = '/data') AS root_errors""")
def denied_root_counts(spark, sf):
    """The root's own error counts like any other."""
    found = I.ingest(_denied(spark, sf), V.ROOT)
    root = found.errors.where(F.col("path") == V.ROOT).agg(F.count(F.lit(1))).scalar()
    return found.counts.select("files", "errors", root.alias("root_errors"))


@query("unknown_inodes", "F5 F16", ("newf",), """
SELECT CAST(sum(s) AS BIGINT) AS unique_bytes FROM (SELECT max(size) AS s FROM newf
  GROUP BY device, CASE WHEN path LIKE '%1%' THEN path ELSE inode END)""")
def unknown_inodes(spark, sf):
    """Files without an inode, or with 0, are nobody's hard link."""
    files = V.new_files(spark, sf).withColumn(
        "inode", F.when(~F.col("path").contains("1"), F.col("inode")).otherwise(
            F.when(F.length("path") % 2 == 0, F.lit("0"))))
    return R.identity_sizes(files).select("unique_bytes")


@query("error_count", "F13", ("errors",), "SELECT count(*) AS total FROM errors")
def error_count(spark, sf):
    return B.error_page(_errors(spark, sf)).meta
