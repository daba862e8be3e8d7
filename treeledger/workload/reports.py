"""Presentation, exports and stored snapshots."""

from pyspark.sql import functions as F

from treeledger.functions import text as X
from treeledger.ledger import Ledger
from treeledger.operators import cleanup as K
from treeledger.operators import rollup as R
from treeledger.plans import report
from treeledger.plans.snapshot import MEASUREMENT, summarize
from treeledger.schema import QUARANTINE_NAME, SUMMARY
from treeledger.sources.workspace import new_folder
from treeledger.workload import views as V
from treeledger.workload.registry import query


def _human(column: str) -> str:
    def scaled(power: int, unit: str) -> str:
        return f"printf('%.1f', floor({column} / {1024 ** power}.0::DOUBLE * 10 + 0.5) / 10) || ' {unit}'"
    return (f"CASE WHEN {column} < 1024 THEN CAST({column} AS VARCHAR) || ' B' WHEN {column} < {1024 ** 2} THEN {scaled(1, 'KiB')} "
            f"WHEN {column} < {1024 ** 3} THEN {scaled(2, 'MiB')} WHEN {column} < {1024 ** 4} THEN {scaled(3, 'GiB')} "
            f"ELSE {scaled(4, 'TiB')} END")


@query("human_sizes", "C10", ("newf",), f"""
SELECT path, s.n AS size, {_human('s.n')} AS shown FROM (SELECT path, unnest([size, size * 1000, size * 1000000,
  size * 1000000000]) AS n FROM newf) s""")
def human_sizes(spark, sf):
    size = F.col("size")
    scaled = F.explode(F.array(size, size * 1000, size * 1000000, size * 1000000000))
    return V.new_files(spark, sf).select("path", scaled.alias("size")).withColumn("shown", X.human_size(F.col("size")))


@query("signed_sizes", "C11", ("wh_old", "wh_new"), f"""
SELECT path, delta, CASE WHEN delta < 0 THEN '−' WHEN delta > 0 THEN '+' ELSE '' END || {_human('abs(delta)')} AS shown
FROM (SELECT o.path, (o.size % 3 - 1) * (o.size + n.size) AS delta FROM wh_old o JOIN wh_new n ON o.path = n.path)""")
def signed_sizes(spark, sf):
    old = V.old_orders(spark, sf).select("path", F.col("size").alias("a"))
    new = V.new_orders(spark, sf).select("path", F.col("size").alias("b"))
    rows = old.join(new, "path").select("path", ((F.col("a") % 3 - 1) * (F.col("a") + F.col("b"))).alias("delta"))
    return rows.withColumn("shown", X.signed_size(F.col("delta")))


_HEADS = ["=", "+", "-", "@", " =", "\t", "", " =", " -", "\x1c+", "\n", "\u0085@"]


@query("formula_guards", "C8a C8b", (), """
WITH p AS (SELECT doc_id, list_extract(['=', '+', '-', '@', ' =', chr(9), '', chr(160) || '=', chr(8195) || '-', chr(28) || '+',
  chr(10), chr(133) || '@'], CAST(doc_id % 12 + 1 AS INTEGER)) || lang || CAST(doc_id AS VARCHAR) AS path FROM documents)
SELECT path, CASE WHEN left(path, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || path AS guarded,
  CASE WHEN doc_id % 12 <> 6 THEN '''' ELSE '' END || path AS strict FROM p""")
def formula_guards(spark, sf):
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 12 + 1).cast("int"))
    rows = V.table(spark, sf, "documents").select(F.concat(head, "lang", F.col("doc_id").cast("string")).alias("path"))
    path = F.col("path")
    return rows.select("path", X.formula_guard(path).alias("guarded"), X.strict_formula_guard(path).alias("strict"))


@query("truncations", "C12", (), """
SELECT page_id, substr(html, 1, 500) AS reason, substr(url, 1, 1000) AS path FROM pages""")
def truncations(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.truncated(F.col("html"), 500).alias("reason"),
                                              X.truncated(F.col("url"), 1000).alias("path"))


@query("inventory_export", "B3 C8a", ("newf",), """
SELECT path, path || ',' || CAST(size AS VARCHAR) || ',' || coalesce(CAST(allocated AS VARCHAR), '') || ',' ||
  CAST(modified AS VARCHAR) || '.0,' || extension AS line FROM newf""")
def inventory_export(spark, sf):
    return report.inventory_lines(V.new_files(spark, sf))


@query("quoted_export", "B3", (), """
SELECT text AS path, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(guarded, '"', '""') || '"' ELSE guarded END
  || ',' || CAST(n_chars AS VARCHAR) || ',,' || CASE doc_id % 4 WHEN 0 THEN '1704067200.0' WHEN 1 THEN '1704067200.25'
  WHEN 2 THEN '1704067200.5' ELSE '1704067200.75' END || ',.txt' AS line FROM
  (SELECT *, CASE WHEN left(text, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS guarded FROM documents)""")
def quoted_export(spark, sf):
    """Whole texts as names: quotes, commas and line breaks survive."""
    rows = V.table(spark, sf, "documents").select(
        F.col("text").alias("path"), F.col("n_chars").alias("size"), F.lit(None).cast("bigint").alias("allocated"),
        (F.lit(1704067200.0) + (F.col("doc_id") % 4) / 4).alias("modified"), F.lit(".txt").alias("extension"))
    return report.inventory_lines(rows)


def _tables(spark, sf):
    files = V.new_files(spark, sf).drop("text")
    sizes = R.directory_totals(R.direct_bytes(files), V.ROOT, V.registered(files, V.EMPTY))
    return files, R.describe_directories(sizes), R.by_extension(files)


def _summary(spark, sf):
    files, directories, _ = _tables(spark, sf)
    found = K.candidate_totals(K.candidates(K.eligible(files, V.NOW, V.TEMP_ROOTS, V.ROOT), V.NOW))
    refused = V.access_errors(spark, sf).agg(F.count(F.lit(1))).scalar()
    facts = {"root": F.lit(V.ROOT), "candidate_files": found.select("candidates").scalar(), "errors": refused,
             "candidate_bytes": found.select("bytes").scalar(), "complete": F.lit(True), "coverage_complete": refused == 0,
             "skipped": files.agg(F.count_if(F.col("allocated").isNull())).scalar(),
             "finished_at": files.agg(F.max("modified")).scalar(), "elapsed_seconds": files.agg(F.avg(F.lit(0.5))).scalar(),
             "measurement": F.lit(MEASUREMENT)}
    return summarize(files, directories, facts)


# Every field of a summary. The entries without allocated bytes stand for those skipped.
_SUMMARY = f"""SELECT '/data' AS root, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files,
  (SELECT count(*) FROM errors) AS errors, count(*) FILTER (allocated IS NULL) AS skipped, true AS complete,
  (SELECT list(struct_pack(path := path, size := size) ORDER BY size DESC, path) FROM
    (SELECT path, size FROM dirsizes ORDER BY size DESC, path LIMIT 100)) AS directories,
  (SELECT list(struct_pack(path := path, size := size) ORDER BY size DESC, path) FROM
    (SELECT path, size FROM newf ORDER BY size DESC, path LIMIT 200)) AS largest,
  (SELECT count(*) FROM temporary) AS candidate_files,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM temporary) AS candidate_bytes,
  max(modified) AS finished_at, CAST(0.5 AS DOUBLE) AS elapsed_seconds,
  (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT max(size) AS s FROM newf GROUP BY device, inode)) AS unique_bytes,
  (SELECT CAST(sum(a) AS BIGINT) FROM (SELECT max(allocated) AS a FROM newf GROUP BY device, inode)) AS allocated_bytes,
  (SELECT count(*) FROM (SELECT max(allocated) AS a FROM newf GROUP BY device, inode) WHERE a IS NULL) AS allocation_errors,
  true AS details_complete, (SELECT count(*) = 0 FROM errors) AS coverage_complete, count(*) AS inventory_files,
  '{MEASUREMENT}' AS measurement, NULL AS refresh
FROM newf"""


@query("json_report", "B5 C15", ("newf", "dirsizes", "temporary", "errors"), f"""
SELECT 'summary' AS part, CAST(to_json(s) AS VARCHAR) AS report FROM
  (SELECT * REPLACE (CAST(finished_at AS VARCHAR) AS finished_at) FROM ({_SUMMARY})) s
UNION ALL SELECT 'extension', CAST(to_json(struct_pack(extension := extension, files := n, bytes := b)) AS VARCHAR) FROM
  (SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM newf GROUP BY extension)
UNION ALL SELECT 'candidate', CAST(to_json(struct_pack(path := path, size := size)) AS VARCHAR) FROM temporary""")
def json_report(spark, sf):
    candidates = K.candidates(K.eligible(V.new_files(spark, sf), V.NOW, V.TEMP_ROOTS, V.ROOT), V.NOW)
    # Seconds since 1970 as whole numbers: engines print floating point numbers of that size in different ways.
    summary = _summary(spark, sf).withColumn("finished_at", F.col("finished_at").cast("bigint").cast("string"))
    return report.whole_report(summary, _tables(spark, sf)[2], candidates.select("path", "size"))


_NUMBERS = ["bytes", "files", "errors", "skipped", "candidate_files", "candidate_bytes", "finished_at", "unique_bytes",
            "allocated_bytes", "allocation_errors", "inventory_files"]
_FLAGS = ["complete", "details_complete", "coverage_complete"]


@query("json_codec", "C15", ("newf", "dirsizes", "temporary", "errors"), f"""
WITH s AS ({_SUMMARY})
SELECT 'directories' AS field, d.path AS text, d.size AS number FROM (SELECT unnest(directories) AS d FROM s)
UNION ALL SELECT 'largest', d.path, d.size FROM (SELECT unnest(largest) AS d FROM s)
UNION ALL SELECT 'root', root, NULL FROM s UNION ALL SELECT 'measurement', measurement, NULL FROM s
UNION ALL SELECT 'elapsed_seconds', CAST(elapsed_seconds AS VARCHAR), NULL FROM s
""" + "".join(f"UNION ALL SELECT '{name}', NULL, CAST({name} AS BIGINT) FROM s\n" for name in [*_NUMBERS, *_FLAGS]))
def json_codec(spark, sf):
    """Every field of the summary through its text and back; a refresh, which this one has not, comes back as none."""
    back = report.read_report(report.json_report(_summary(spark, sf)), SUMMARY).where("refresh IS NULL")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    listed = [back.select(F.lit(name).alias("field"), F.inline(name).alias("text", "number")) for name in ("directories", "largest")]
    fields = {name: (F.col(name).cast("string"), number) for name in ("root", "measurement", "elapsed_seconds")}
    fields |= {name: (text, F.col(name).cast("bigint")) for name in [*_NUMBERS, *_FLAGS]}
    single = back.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), a.alias("text"), b.alias("number")) for name, (a, b) in fields.items()])))
    return listed[0].unionByName(listed[1]).unionByName(single)


@query("summary_rankings", "H1 H2 H9 N1", ("newf", "dirsizes"), """
SELECT 'largest' AS list, path, size FROM (SELECT path, size FROM newf ORDER BY size DESC, path LIMIT 200)
UNION ALL SELECT 'directories', path, size FROM (SELECT path, size FROM dirsizes ORDER BY size DESC, path LIMIT 100)
UNION ALL SELECT 'extensions', extension, CAST(sum(size) AS BIGINT) FROM newf GROUP BY extension""")
def summary_rankings(spark, sf):
    summary = _summary(spark, sf)
    parts = [summary.select(F.lit(name).alias("list"), F.explode(name).alias("r")).select(
        "list", F.col(f"r.{key}").alias("path"), F.col(f"r.{size}").alias("size"))
        for name, key, size in (("largest", "path", "size"), ("directories", "path", "size"))]
    extensions = _tables(spark, sf)[2].select(F.lit("extensions").alias("list"), F.col("extension").alias("path"),
                                              F.col("bytes").alias("size"))
    return parts[0].unionByName(parts[1]).unionByName(extensions)


_SHARE = """
SELECT CAST(sum(size) AS BIGINT) AS logical_bytes, count(*) AS file_count, CAST(0 AS BIGINT) AS unreadable_count,
  (SELECT count(*) FROM temporary) AS temporary_candidate_count,
  (SELECT CAST(sum(size) AS BIGINT) FROM temporary) AS temporary_candidate_bytes,
  (SELECT string_agg(CAST(size AS VARCHAR), '|' ORDER BY size DESC, path) FROM
    (SELECT size, path FROM newf ORDER BY size DESC, path LIMIT 10)) AS largest_file_bytes,
  true AS coverage_complete,
  (SELECT string_agg(extension || '=' || CAST(n AS VARCHAR) || '/' || CAST(b AS VARCHAR), '|' ORDER BY b DESC, extension) FROM
    (SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM newf GROUP BY extension ORDER BY b DESC, extension LIMIT 30)) AS extensions,
  {more} {paths} AS paths_included
FROM newf"""
_PATHS = """(SELECT string_agg(path || '=' || CAST(size AS VARCHAR), '|' ORDER BY size DESC, path) FROM
    (SELECT path, size FROM {table} ORDER BY size DESC, path LIMIT {n})) AS {name},"""


def stored(spark, sf) -> Ledger:
    """A ledger with the current tree stored as scan 'new'."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    listing = V.raw_listing(spark, sf, QUARANTINE_NAME)
    ledger.scan("new", listing, V.ROOT, V.NOW, temp_roots=V.TEMP_ROOTS, finished_at=2.0)
    return ledger


def stored_pair(spark, sf) -> Ledger:
    """The earlier tree as 'old', listed without links, and the current one as 'new'."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    for ident, files, finished in (("old", V.old_files(spark, sf), 1.0), ("new", V.new_files(spark, sf), 2.0)):
        folders = V.registered(files).select("path", F.lit("d").alias("kind"))
        listing = files.withColumn("kind", F.lit("f")).select(
            "path", "kind", "size", "allocated", "mtime_ns", "device", "inode")
        ledger.scan(ident, listing.unionByName(folders, allowMissingColumns=True), V.ROOT, V.NOW,
                    temp_roots=V.TEMP_ROOTS, finished_at=finished)
    return ledger


def _flat(shared):
    pairs = F.transform("extensions", lambda e: F.concat(
        e["extension"], F.lit("="), e["files"].cast("string"), F.lit("/"), e["bytes"].cast("string")))
    sizes = F.transform("largest_file_bytes", lambda n: n.cast("string"))
    out = shared.withColumn("extensions", F.array_join(pairs, "|")).withColumn(
        "largest_file_bytes", F.array_join(sizes, "|"))
    for name in ("largest_files", "largest_directories"):
        if name in out.columns:
            rows = F.transform(name, lambda r: F.concat(r["path"], F.lit("="), r["logical_bytes"].cast("string")))
            out = out.withColumn(name, F.array_join(rows, "|"))
    return out.drop("notice", "allocated_bytes", "unique_bytes")


@query("share_summary", "F14 N6", ("newf", "temporary"), _SHARE.format(more="", paths="false"))
def share_summary(spark, sf):
    store = stored(spark, sf).store
    return _flat(report.share_summary(store.summary("new"), store.read("new", "extensions")))


@query("share_summary_with_paths", "F14 N6", ("newf", "temporary", "dirsizes"), _SHARE.format(
    more=_PATHS.format(table="newf", n=30, name="largest_files")
    + _PATHS.format(table="dirsizes", n=20, name="largest_directories"), paths="true"))
def share_summary_with_paths(spark, sf):
    store = stored(spark, sf).store
    return _flat(report.share_summary(store.summary("new"), store.read("new", "extensions"), True))


@query("snapshot_write", "B1 A3 N1", ("newf",), """
SELECT path, parent, name, size, allocated, extension, modified, modified * 1000000000 AS mtime_ns, device, inode,
  '1:' || inode || ':' || CAST(size AS VARCHAR) || ':' || CAST(modified * 1000000000 AS VARCHAR) AS fingerprint FROM newf""")
def snapshot_write(spark, sf):
    """Through storage and back, after the build of a whole snapshot."""
    files = stored(spark, sf).store.read("new", "files")
    return files.withColumn("modified", F.col("modified").cast("bigint"))


@query("snapshot_summary", "N1 F1 F5 F12", ("newf", "listing", "temporary"), """
SELECT '/data' AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, true AS complete, true AS coverage_complete,
  CAST(0 AS BIGINT) AS errors, (SELECT count(*) FROM listing WHERE kind = 'l') + 1 AS skipped,
  (SELECT count(*) FROM temporary) AS candidates, count(*) AS inventory_files FROM newf""")
def snapshot_summary(spark, sf):
    row = stored(spark, sf).store.summary("new")
    return row.select("root", "files", "bytes", "complete", "coverage_complete", "errors", "skipped",
                      F.col("candidate_files").alias("candidates"), "inventory_files")


@query("stored_browse", "A3 H4", ("dirsizes",), """
SELECT path, name, size, 'directory' AS kind FROM dirsizes WHERE parent = '/data' ORDER BY size DESC, path LIMIT 100""")
def stored_browse(spark, sf):
    return stored(spark, sf).browse("new").items.select("path", "name", "size", "kind")


@query("exclusive_publish", "B2 A4", ("newf",), """
SELECT path, size, 'completed' AS state, true AS refused FROM newf""")
def exclusive_publish(spark, sf):
    """Writing another tree under the same scan id is refused and changes nothing."""
    ledger = stored(spark, sf)
    other = V.raw_listing(spark, sf, QUARANTINE_NAME).withColumn("size", F.col("size") + 1)
    try:
        ledger.scan("new", other, V.ROOT, V.NOW)
        refused = False
    except FileExistsError:
        refused = True
    state = ledger.scans().where("id = 'new'").select("state").scalar()
    return ledger.store.read("new", "files").select("path", "size", state.alias("state"), F.lit(refused).alias("refused"))


@query("stored_comparison", "N2 H6 E6", ("changed",), """
SELECT path, kind, baseline_size, current_size, delta_bytes FROM changed WHERE starts_with(path, '/data/en/')
ORDER BY path LIMIT 100""")
def stored_comparison(spark, sf):
    return stored_pair(spark, sf).compare("old", "new", "/data/en/").page().items


@query("compare_next_page", "N2 H6", ("changed",), """
SELECT path, kind, baseline_size, current_size, delta_bytes FROM changed WHERE path > '/data/en/' ORDER BY path LIMIT 50""")
def compare_next_page(spark, sf):
    """Goes on behind a known path instead of counting rows."""
    return stored_pair(spark, sf).compare("old", "new").page(limit=50, after="/data/en/").items


@query("stored_comparison_meta", "N2 F6 F12", ("changed",), """
SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed,
  count(*) FILTER (kind = 'resized') AS resized, count(*) AS total, CAST(sum(delta_bytes) AS BIGINT) AS delta_bytes,
  CAST(20 AS BIGINT) AS "offset", CAST(100 AS BIGINT) AS "limit", 120 < count(*) AS has_more, true AS coverage_complete
FROM changed""")
def stored_comparison_meta(spark, sf):
    return stored_pair(spark, sf).compare("old", "new").page(20).meta


def refreshed(spark, sf) -> Ledger:
    """The pair of stored trees, and 'mixed': the earlier one with the scope as it is in the current one."""
    ledger = stored_pair(spark, sf)
    inside = V.new_files(spark, sf).where(F.col("path").startswith(V.SCOPE + "/"))
    folders = V.registered(inside).where(F.col("path").startswith(V.SCOPE)).select("path", F.lit("d").alias("kind"))
    listing = inside.withColumn("kind", F.lit("f")).select(
        "path", "kind", "size", "allocated", "mtime_ns", "device", "inode")
    ledger.refresh("old", V.SCOPE, "mixed", listing.unionByName(folders, allowMissingColumns=True), finished_at=3.0)
    return ledger


@query("stored_refresh", "N3 E2 F7 F15", ("merged", "six"), """
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, false AS coverage_complete, CAST(0 AS BIGINT) AS candidates,
  'old' AS baseline_id, count(*) FILTER (NOT starts_with(path, '/data/en/')) AS reused_files,
  count(*) FILTER (starts_with(path, '/data/en/')) AS scanned_files,
  (SELECT count(*) FROM six WHERE kind = 'replaced') AS replaced,
  (SELECT count(*) FROM six WHERE kind = 'metadata_changed') AS metadata_changed,
  (SELECT CAST(sum(new_size) - sum(old_size) AS BIGINT) FROM six) AS delta_bytes FROM merged""")
def stored_refresh(spark, sf):
    ledger = refreshed(spark, sf)
    row = ledger.store.summary("mixed")
    return row.select("files", "bytes", "coverage_complete", F.col("candidate_files").alias("candidates"),
                      "refresh.baseline_id", "refresh.reused_files", "refresh.scanned_files",
                      "refresh.changes.counts.replaced", "refresh.changes.counts.metadata_changed",
                      "refresh.changes.delta_bytes")
