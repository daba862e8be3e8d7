"""The tree as intervals of a depth-first order."""

from pyspark.sql import functions as F

from treeledger.operators import rollup as R
from treeledger.operators import tree as T
from treeledger.workload import views as V
from treeledger.workload.registry import query


@query("interval_rollup", "F4 C2", ("dirsizes",), """
SELECT path, CASE WHEN parent = '' THEN '/' ELSE parent END AS parent, name, size FROM dirsizes""")
def interval_rollup(spark, sf):
    files = V.new_files(spark, sf)
    spans = T.directory_intervals(R.direct_bytes(files), V.ROOT, V.registered(files, V.EMPTY))
    return R.describe_directories(spans)


@query("tree_intervals", "F4 C6", ("dirs",), """
WITH k AS (SELECT path, replace(path, '/', chr(1)) AS key FROM dirs),
p AS (SELECT path, row_number() OVER (ORDER BY key) - 1 AS first FROM k)
SELECT path, first, first + (SELECT count(*) FROM dirs d WHERE starts_with(d.path, p.path || '/')) AS last FROM p""")
def tree_intervals(spark, sf):
    """A directory's interval of places covers exactly the directories beneath it."""
    files = V.new_files(spark, sf)
    spans = T.directory_intervals(R.direct_bytes(files), V.ROOT, V.registered(files, V.EMPTY))
    return spans.select("path", "first", "last")


@query("traversal_limit", "D2 H3", ("wh_new",), """
SELECT path, place FROM (SELECT path, row_number() OVER (ORDER BY replace(path, '/', chr(1))) - 1 AS place FROM wh_new)
WHERE place < (SELECT count(*) // 3 FROM wh_new)""")
def traversal_limit(spark, sf):
    """A third of the files, as a depth-first walk comes to them."""
    files = V.new_orders(spark, sf)
    return T.limit_traversal(files.select("path"), files.count() // 3)


@query("under_many_roots", "E7", ("logs",), """
SELECT path, size FROM logs WHERE CAST(substr(split_part(path, '/', 4), 2) AS BIGINT) % 3 = 1""")
def under_many_roots(spark, sf):
    """Every third user's directories of logs as roots, and files in them as roots too, which hold nothing."""
    files = V.log_files(spark, sf)
    user = F.substring(F.split_part("path", F.lit("/"), F.lit(4)), 2, 20).cast("bigint")
    roots = files.where((user % 3) == 1).select(F.col("parent").alias("path"))
    return T.rows_under(files, roots.unionByName(files.where((user % 3) == 2).select("path")), "left_semi").select("path", "size")
