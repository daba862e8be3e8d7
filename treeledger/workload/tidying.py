"""Cleanup candidates, selections and the quarantine journal."""

from pyspark.sql import functions as F

from treeledger.operators import cleanup as K
from treeledger.operators import journal as J
from treeledger.schema import LIVE_STATES, QUARANTINE_NAME
from treeledger.workload import views as V
from treeledger.workload.registry import query

_ID = "left(sha256(path || chr(10) || fingerprint), 32)"
_AGE = "CAST(trunc((1704067200 - modified) / 86400.0) AS BIGINT)"


def _eligible(spark, sf, files=V.new_files):
    return K.eligible(files(spark, sf), V.NOW, V.TEMP_ROOTS, V.ROOT)


@query("cleanup_eligible", "D1 E7", ("temporary",), "SELECT path, size FROM temporary")
def cleanup_eligible(spark, sf):
    return _eligible(spark, sf).select("path", "size")


@query("log_cleanup", "D1 E7 C9", ("logs",), """
SELECT path, size, CAST(trunc((1705276800 - modified) / 86400.0) AS BIGINT) AS age_days FROM logs
WHERE 1705276800 - modified >= 604800 AND starts_with(path, '/logs/error/')""")
def log_cleanup(spark, sf):
    kept = K.eligible(V.log_files(spark, sf), 1705276800, ["/logs/error"], "/logs")
    return K.candidates(kept, 1705276800, None).select("path", "size", "age_days")


@query("under_temp_roots", "E7", ("newf",), """
SELECT path, size FROM newf WHERE split_part(path, '/', 4) IN ('src1', 'src4', 'src7') AND split_part(path, '/', 5) <> ''""")
def under_temp_roots(spark, sf):
    """Roots as a table: every directory named src1, src4 or src7 right below a language."""
    files = V.new_files(spark, sf)
    roots = V.registered(files).where(F.split_part("path", F.lit("/"), F.lit(4)).isin("src1", "src4", "src7"))
    return K.under_roots(files, roots).select("path", "size")


@query("link_free_candidates", "D1", ("temporary",), """
SELECT path, size FROM temporary WHERE split_part(path, '/', 4) NOT IN ('src2', 'src5', 'src12') """)
def link_free_candidates(spark, sf):
    """Some directories turn out to be links; nothing below them qualifies."""
    files = V.new_files(spark, sf)
    links = V.registered(files).where(F.split_part("path", F.lit("/"), F.lit(4)).isin("src2", "src5", "src12"))
    return K.eligible(files, V.NOW, V.TEMP_ROOTS, V.ROOT, links).select("path", "size")


@query("cleanup_candidates", "H3 D1 C9", ("temporary",), f"""
SELECT {_ID} AS id, path, size, fingerprint, {_AGE} AS age_days FROM temporary""")
def cleanup_candidates(spark, sf):
    return K.candidates(_eligible(spark, sf), V.NOW)


@query("candidate_totals", "F10", ("temporary",), """
SELECT count(*) AS candidates, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes
FROM temporary""")
def candidate_totals(spark, sf):
    return K.candidate_totals(K.candidates(_eligible(spark, sf), V.NOW))


def _found(spark, sf):
    return K.candidates(_eligible(spark, sf, V.old_files), V.NOW, None)


def _selection(found):
    """Every candidate, some of them twice, and some ids nobody knows."""
    again = found.where("age_days % 5 = 4").select("id")
    unknown = found.where("age_days % 7 = 3").select(F.concat(F.lit("x"), "id").alias("id"))
    return found.select("id").unionByName(again).unionByName(unknown)


_FOUND = f"""
WITH found AS (SELECT {_ID} AS id, path, size, fingerprint, {_AGE} AS age_days FROM oldf
  WHERE extension IN ('.tmp', '.log') AND 1704067200 - modified >= 604800
    AND (starts_with(path, '/data/en/') OR starts_with(path, '/data/links/'))),
picked AS (SELECT id FROM found UNION ALL SELECT id FROM found WHERE age_days % 5 = 4
  UNION ALL SELECT 'x' || id FROM found WHERE age_days % 7 = 3),
chosen AS (SELECT id, count(*) AS times FROM picked GROUP BY id),
verdicts AS (SELECT c.id, f.path, CASE WHEN starts_with(f.path, '/data/en/') THEN '/data/en/.quarantine/' || c.id
    WHEN f.path IS NOT NULL THEN '/data/links/.quarantine/' || c.id END AS destination, f.size, f.fingerprint,
  CASE WHEN times > 1 THEN 'repeated' WHEN f.path IS NULL THEN 'unknown'
    WHEN n.path IS NULL OR n.fingerprint <> f.fingerprint THEN 'changed' ELSE 'ok' END AS verdict
  FROM chosen c LEFT JOIN found f USING (id) LEFT JOIN newf n ON n.path = f.path)
"""


@query("bad_ids", "I5 E4", ("oldf", "newf"), _FOUND + """
SELECT id, 'repeated' AS reason FROM chosen WHERE times > 1
UNION ALL SELECT id, 'unknown' FROM chosen WHERE id NOT IN (SELECT id FROM found)""")
def bad_ids(spark, sf):
    found = _found(spark, sf)
    return K.bad_ids(_selection(found), found)


def _verdicts(spark, sf):
    found = _found(spark, sf)
    return K.revalidate(_selection(found), found, V.new_files(spark, sf), V.NOW, V.TEMP_ROOTS)


@query("candidate_revalidate", "E4 D1", ("oldf", "newf"), _FOUND + """
SELECT id, path, destination, size, fingerprint, verdict FROM verdicts""")
def candidate_revalidate(spark, sf):
    return _verdicts(spark, sf)


@query("revalidate_guards", "E4 D1", ("oldf", "newf"), _FOUND + """
SELECT id, CASE WHEN verdict <> 'ok' THEN verdict WHEN split_part(path, '/', 4) IN ('src2', 'src5', 'src12') THEN 'ineligible'
  WHEN size % 3 = 0 THEN 'collision' ELSE 'ok' END AS verdict FROM verdicts""")
def revalidate_guards(spark, sf):
    """Some directories have become links, and some destinations are taken."""
    found, fresh = _found(spark, sf), V.new_files(spark, sf).drop("text")
    taken = found.where("size % 3 = 0").select(K.quarantine_path(F.col("path"), F.col("id"), V.TEMP_ROOTS, QUARANTINE_NAME).alias("path"))
    links = V.registered(fresh).where(F.split_part("path", F.lit("/"), F.lit(4)).isin("src2", "src5", "src12"))
    return K.revalidate(_selection(found), found, fresh.unionByName(taken, allowMissingColumns=True), V.NOW, V.TEMP_ROOTS,
                        links=links, top=V.ROOT).select("id", "verdict")


@query("batch_allowed", "E4", ("oldf", "newf"), _FOUND + """
SELECT count(*) AS selected, count(*) FILTER (verdict = 'ok') AS ok, bool_and(verdict = 'ok') AS allowed FROM verdicts""")
def batch_allowed(spark, sf):
    return K.batch_allowed(_verdicts(spark, sf))


@query("quota_check", "F11 M2 D9", ("moves", "temporary"), """
SELECT retained_bytes, selected_bytes, retained_bytes + selected_bytes <= 2147483648 AS allowed FROM (
  SELECT unnest([1, 100000]) * (SELECT CAST(sum(size) AS BIGINT) FROM moves WHERE state IN ('quarantined', 'pending', 'purging', 'restoring')) AS retained_bytes,
    CAST(sum(size) AS BIGINT) AS selected_bytes FROM temporary)""")
def quota_check(spark, sf):
    """As the journal is, and with files a hundred thousand times as large, which leave no room."""
    moves, chosen = _moves(spark, sf)[0], _eligible(spark, sf)
    return K.quota(moves, chosen).unionByName(K.quota(moves.withColumn("size", F.col("size") * 100_000), chosen))


@query("selection_plan", "M6 E4 F11", ("temporary",), f"""
SELECT {_ID} AS id, path AS source, CASE WHEN starts_with(path, '/data/en/') THEN '/data/en/.quarantine/'
  ELSE '/data/links/.quarantine/' END || {_ID} AS destination, size, fingerprint, 'pending' AS state,
  CAST(1704067200 AS BIGINT) AS created, 'b-new' AS batch FROM temporary""")
def selection_plan(spark, sf):
    """All candidates of the current snapshot, still as they were: the whole batch is planned."""
    found = K.candidates(_eligible(spark, sf), V.NOW, None)
    verdicts = K.revalidate(found.select("id"), found, V.new_files(spark, sf), V.NOW, V.TEMP_ROOTS)
    plan = K.selection_plan(verdicts, _moves(spark, sf)[0], V.NOW, "b-new")
    return plan.withColumn("created", F.col("created").cast("bigint"))


@query("selection_refused", "M6 E4", ("oldf",), """
SELECT path AS source, size FROM oldf WHERE false""")
def selection_refused(spark, sf):
    """One bad id is enough to plan nothing."""
    return K.selection_plan(_verdicts(spark, sf), _moves(spark, sf)[0], V.NOW, "b").select("source", "size")


def _moves(spark, sf):
    return V.journal(spark, sf, QUARANTINE_NAME)


def _checked(spark, sf):
    return J.presence(*_moves(spark, sf))


@query("journal_presence", "E10", ("moves",), """
SELECT id, CASE WHEN src THEN fp_now END AS source_fingerprint, CASE WHEN dst THEN fp_now END AS destination_fingerprint
FROM moves""")
def journal_presence(spark, sf):
    return _checked(spark, sf).select("id", "source_fingerprint", "destination_fingerprint")


@query("journal_reconcile", "M1 E10", ("moves",), """
SELECT id, state, CASE WHEN state = 'pending' AND NOT src AND dst THEN 'quarantined'
  WHEN state = 'pending' AND src AND NOT dst THEN 'failed'
  WHEN state = 'restoring' AND src AND NOT dst AND fp_now = fingerprint THEN 'restored'
  WHEN state = 'purging' AND dst THEN 'quarantined' WHEN state = 'purging' THEN 'purged' ELSE state END AS new_state
FROM moves""")
def journal_reconcile(spark, sf):
    return J.reconcile(_checked(spark, sf)).select("id", "state", "new_state")


@query("journal_current", "M1 H8", ("moves",), """
SELECT id, CASE WHEN state = 'pending' AND NOT src AND dst THEN 'quarantined'
  WHEN state = 'pending' AND src AND NOT dst THEN 'failed'
  WHEN state = 'restoring' AND src AND NOT dst AND fp_now = fingerprint THEN 'restored'
  WHEN state = 'purging' AND dst THEN 'quarantined' WHEN state = 'purging' THEN 'purged' ELSE state END AS state, size, batch
FROM moves""")
def journal_current(spark, sf):
    """The journal after the reconciled states were appended to it."""
    moves, present = _moves(spark, sf)
    appended = J.transitions(J.reconcile(J.presence(moves, present)))
    log = moves.withColumn("version", F.lit(1)).unionByName(appended.withColumn("version", F.lit(2)))
    return J.current(log).select("id", "state", "size", "batch")


@query("history_page", "H8", ("moves",), """
SELECT id, source, destination, size, fingerprint, state, created, batch FROM moves ORDER BY created DESC, id LIMIT 100""")
def history_page(spark, sf):
    return J.history_page(_moves(spark, sf)[0]).withColumn("created", F.col("created").cast("bigint"))


@query("live_moves", "D9", ("moves",), """
SELECT state, count(*) AS moves, CAST(sum(size) AS BIGINT) AS bytes FROM moves
WHERE state IN ('quarantined', 'pending', 'purging', 'restoring') GROUP BY state""")
def live_moves(spark, sf):
    live = _moves(spark, sf)[0].where(F.col("state").isin(*LIVE_STATES))
    return live.groupBy("state").agg(F.count(F.lit(1)).alias("moves"), F.sum("size").alias("bytes"))


@query("batch_restore_plan", "M3 D9", ("moves",), """
SELECT id, batch, state FROM moves WHERE batch = 'b1' AND state IN ('quarantined', 'restoring')""")
def batch_restore_plan(spark, sf):
    return J.batch_plan(_moves(spark, sf)[0], "b1").select("id", "batch", "state")


_LINKED = "split_part(source, '/', 4) IN ('src2', 'src5')"


def _linked(spark, sf):
    """Moves below directories that a listing of links names."""
    moves = _moves(spark, sf)[0]
    links = V.registered(V.old_files(spark, sf)).where(F.col("path").isin(f"{V.SCOPE}/src2", f"{V.SCOPE}/src5"))
    return J.linked_moves(moves, links, V.ROOT)


@query("restore_verdict", "M4", ("moves",), f"""
SELECT id, batch, state, CASE WHEN state NOT IN ('quarantined', 'restoring') THEN 'not_in_quarantine'
  WHEN src AND state <> 'restoring' THEN 'source_occupied' WHEN NOT dst OR {_LINKED} THEN 'unsafe_path'
  WHEN fp_now <> fingerprint THEN 'changed' WHEN src AND NOT same_inode THEN 'conflict' ELSE 'ok' END AS verdict
FROM moves""")
def restore_verdict(spark, sf):
    return J.restore_verdict(_checked(spark, sf), V.TEMP_ROOTS, _linked(spark, sf))


@query("purge_verdict", "M5", ("moves",), """
SELECT id, state, verdict, CASE WHEN verdict = 'ok' THEN size ELSE 0 END AS released_bytes FROM (
  SELECT id, state, size, CASE WHEN state <> 'quarantined' THEN 'not_in_quarantine' WHEN NOT dst THEN 'unsafe_path'
    WHEN fp_now <> fingerprint THEN 'changed' ELSE 'ok' END AS verdict FROM moves)""")
def purge_verdict(spark, sf):
    return J.purge_verdict(_checked(spark, sf), V.TEMP_ROOTS)
