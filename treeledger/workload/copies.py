"""Duplicate content."""

from pyspark.sql import functions as F

from treeledger.operators import duplicates as D
from treeledger.operators.joins import path_join
from treeledger.plans.duplicates import find_duplicates
from treeledger.plans.staged import staged_digests
from treeledger.sources.content import digest_column, digest_column_ranges
from treeledger.sources.workspace import materialize
from treeledger.workload import views as V
from treeledger.workload.registry import query


def _digests(files):
    return digest_column(files, F.col("text"))


def _digests_of(files, candidates):
    """Digests of what may be a candidate, made where the text is read."""
    near = D.possibly_of_classes(files, candidates.select("size").distinct())
    return path_join(candidates.select("path"), _digests(near), "inner")


def _hashed(spark, sf):
    """Candidates with their digests: a table is written for the candidates only, which the filter and the join both read."""
    files = V.new_files(spark, sf)
    candidates = materialize(D.duplicate_candidates(files).select("path", "size"))
    return path_join(candidates, _digests_of(files, candidates), "inner")


@query("size_window", "D6", ("newf",), "SELECT path, size FROM newf WHERE size > 0")
def size_window(spark, sf):
    return D.size_window(V.new_files(spark, sf)).select("path", "size")


@query("size_classes", "F8 D6", ("newf",), """
SELECT size, count(*) AS files FROM newf WHERE size > 0 GROUP BY size HAVING count(*) > 1""")
def size_classes(spark, sf):
    return D.size_classes(V.new_files(spark, sf))


@query("first_names", "G1 E5", ("single",), "SELECT size, device, inode, path FROM single")
def first_names(spark, sf):
    return D.one_per_identity(D.size_window(V.new_files(spark, sf))).drop("fingerprint")


@query("duplicate_candidates", "F8 F9 G1", ("candidates",), "SELECT path, size FROM candidates")
def duplicate_candidates(spark, sf):
    return D.duplicate_candidates(V.new_files(spark, sf)).select("path", "size")


@query("content_digests", "A2", ("newf",), "SELECT path, sha256(text) AS sha256 FROM newf")
def content_digests(spark, sf):
    return _digests(V.new_files(spark, sf))


@query("duplicate_groups", "F9", ("groups",), "SELECT size, sha256, copies, potential_bytes FROM groups")
def duplicate_groups(spark, sf):
    return D.duplicate_groups(_hashed(spark, sf))


@query("duplicate_members", "F9", ("groups", "hashed"), """
SELECT g.size, g.sha256, h.path, g.copies, g.potential_bytes FROM groups g JOIN hashed h USING (size, sha256)""")
def duplicate_members(spark, sf):
    return D.duplicate_members(materialize(_hashed(spark, sf)))


def _staged(spark, sf):
    """Digests in ranges that grow from 256 bytes, so that the texts take several stages."""
    files = V.new_files(spark, sf)
    candidates = materialize(D.duplicate_candidates(files).select("path", "fingerprint", "size"))
    sized = files.select("path", F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("size"))
    asked = materialize(path_join(candidates.drop("size"), sized, "inner"))
    near = D.possibly_of_classes(files, candidates.select("size").distinct())
    digests = staged_digests(asked, lambda ranges: digest_column_ranges(ranges, near, F.col("text")),
                             lambda rows: path_join(rows.select("path"), _digests(near), "inner"), first=256, block=4096)
    return path_join(candidates.select("path", "size"), digests, "inner")


@query("staged_duplicates", "F9 N5 A2", ("groups", "hashed"), """
SELECT g.size, g.sha256, h.path, g.copies, g.potential_bytes FROM groups g JOIN hashed h USING (size, sha256)""")
def staged_duplicates(spark, sf):
    return D.duplicate_members(_staged(spark, sf))


@query("duplicate_ranking", "H10", ("groups",), """
SELECT size, sha256, copies, potential_bytes FROM groups ORDER BY potential_bytes DESC, sha256 LIMIT 20""")
def duplicate_ranking(spark, sf):
    return D.rank_groups(D.duplicate_groups(_hashed(spark, sf))).limit(20)


@query("duplicate_recheck", "E9", ("oldf", "newf"), """
WITH one AS (SELECT size, device, inode, min(path) AS path FROM oldf WHERE size > 0 GROUP BY size, device, inode),
c AS (SELECT * FROM one WHERE size IN (SELECT size FROM one GROUP BY size HAVING count(*) > 1))
SELECT c.path, c.size, n.fingerprint IS NULL OR n.fingerprint <> o.fingerprint AS changed
FROM c JOIN oldf o USING (path) LEFT JOIN newf n ON n.path = c.path""")
def duplicate_recheck(spark, sf):
    candidates = D.duplicate_candidates(V.old_files(spark, sf))
    return D.recheck(candidates, V.new_files(spark, sf)).select("path", "size", "changed")


@query("read_budget", "G2", ("candidates",), """
SELECT size, bytes, read_bytes FROM (SELECT size, bytes, CAST(sum(bytes) OVER (ORDER BY size) AS BIGINT) AS read_bytes
  FROM (SELECT size, CAST(sum(size) AS BIGINT) AS bytes FROM candidates GROUP BY size)) WHERE read_bytes <= 500000""")
def read_budget(spark, sf):
    return D.within_budget(D.candidate_bytes(V.new_files(spark, sf)), 500_000)


@query("log_read_budget", "G2", ("logs",), """
SELECT size, bytes, read_bytes FROM (SELECT size, bytes, CAST(sum(bytes) OVER (ORDER BY size) AS BIGINT) AS read_bytes
  FROM (SELECT size, CAST(sum(size) AS BIGINT) AS bytes FROM logs WHERE size > 0 GROUP BY size HAVING count(*) > 1))
WHERE read_bytes <= 10737418240""")
def log_read_budget(spark, sf):
    return D.within_budget(D.candidate_bytes(V.log_files(spark, sf)), 10 * 1024**3)


@query("duplicate_review", "N5 E9 F9 G2", ("candidates", "newf"), """
SELECT sum(size) <= 500000 AS complete, CAST(0 AS BIGINT) AS errors,
  (SELECT CAST(coalesce(max(read_bytes), 0) AS BIGINT) FROM (SELECT sum(bytes) OVER (ORDER BY size) AS read_bytes FROM
    (SELECT size, sum(size) AS bytes FROM candidates GROUP BY size)) WHERE read_bytes <= 500000) AS read_bytes,
  CASE WHEN sum(size) > 500000 THEN 'read budget reached' END AS reason,
  CAST(0 AS BIGINT) AS left_out FROM candidates""")
def duplicate_review(spark, sf):
    files = V.new_files(spark, sf)
    return find_duplicates(files, lambda rows: _digests_of(files, rows), files, 500_000).meta
