"""Directory pages, search and page arithmetic."""

from pyspark.sql import functions as F

from treeledger.functions import text as X
from treeledger.operators import browse as B
from treeledger.operators import rollup as R
from treeledger.operators.paging import ordered_slice
from treeledger.workload import views as V
from treeledger.workload.registry import query

_ROW = "path, name, size, allocated, extension, modified, kind"


def _tables(spark, sf):
    files = V.mixed_files(spark, sf)
    sizes = R.directory_totals(R.direct_bytes(files), V.ROOT, V.registered(files, V.EMPTY))
    return files, R.describe_directories(sizes)


def _page(spark, sf, **options):
    return B.browse(*_tables(spark, sf), V.ROOT, V.SCOPE, **options)


def _items(page):
    return page.items.withColumn("modified", F.col("modified").cast("bigint"))


@query("browse_size", "H4 D7 E8 I1 C14", ("page",), f"SELECT {_ROW} FROM page ORDER BY size DESC, path LIMIT 30 OFFSET 10")
def browse_size(spark, sf):
    return _items(_page(spark, sf, offset=10, limit=30))


@query("browse_allocated", "H4 C13", ("page",), f"""
SELECT {_ROW} FROM page ORDER BY coalesce(allocated, -1) DESC, path LIMIT 30 OFFSET 2""")
def browse_allocated(spark, sf):
    return _items(_page(spark, sf, sort="allocated", offset=2, limit=30))


@query("browse_name", "H4 C7", ("page",), f"""
SELECT {_ROW} FROM page ORDER BY translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), path LIMIT 30 OFFSET 3""")
def browse_name(spark, sf):
    return _items(_page(spark, sf, sort="name", offset=3, limit=30))


@query("browse_modified", "H4", ("page",), f"SELECT {_ROW} FROM page ORDER BY modified DESC NULLS LAST, path LIMIT 500")
def browse_modified(spark, sf):
    return _items(_page(spark, sf, sort="modified", limit=500))


@query("browse_search", "H4 D7 C7", ("page",), f"""
SELECT {_ROW} FROM page WHERE contains(lower(name), 'top-doc-1') ORDER BY size DESC, path LIMIT 100""")
def browse_search(spark, sf):
    return _items(_page(spark, sf, query="TOP-Doc-1"))


@query("browse_meta", "H4 C16", ("page", "mixdirs"), """
SELECT count(*) AS total, CAST(10 AS BIGINT) AS "offset", CAST(30 AS BIGINT) AS "limit", 40 < count(*) AS has_more,
  (SELECT size FROM mixdirs WHERE path = '/data/en') AS size, '/data/en' AS path, '/data' AS parent,
  CAST(1 AS BIGINT) AS page, CAST(greatest(1, ceil(count(*) / 30.0)) AS BIGINT) AS pages FROM page""")
def browse_meta(spark, sf):
    return _page(spark, sf, offset=10, limit=30).meta


@query("browse_children", "D7 E8 I1", ("page",), f"SELECT {_ROW} FROM page")
def browse_children(spark, sf):
    found = B.entries(*_tables(spark, sf), V.SCOPE)
    return found.withColumn("modified", F.col("modified").cast("bigint")).select(*_ROW.split(", "))


@query("browse_next_page", "H4", ("page",), f"SELECT {_ROW} FROM page ORDER BY size DESC, path LIMIT 30 OFFSET 10")
def browse_next_page(spark, sf):
    """The page after a known row; the row is looked up here only to have one."""
    last = _page(spark, sf, offset=9, limit=1).items.first().asDict()
    return _items(_page(spark, sf, after=last, limit=30))


@query("search_recursive", "H5 D8 C7", ("mixf",), """
SELECT path, name, size, allocated, extension, modified, 'file' AS kind FROM mixf
WHERE contains(lower(path), 'doc-1') ORDER BY size DESC, path LIMIT 100""")
def search_recursive(spark, sf):
    return _items(_page(spark, sf, query="DOC-1", recursive=True))


@query("search_everything", "D8 C7", ("logs",), """
SELECT path, size FROM logs WHERE contains(lower(path), 'k/u1')""")
def search_everything(spark, sf):
    files = V.log_files(spark, sf)
    return files.where(X.contains_text(F.col("path"), "K/U1")).select("path", "size")


@query("ascii_search", "C7", (), """
SELECT doc_id, contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'él') AS lower_hit,
  contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'Él') AS upper_hit,
  contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th%_') AS wildcard_hit
FROM documents""")
def ascii_search(spark, sf):
    """Only A-Z fold, and nothing is a wildcard."""
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", X.contains_text(text, "éL").alias("lower_hit"), X.contains_text(text, "ÉL").alias("upper_hit"),
        X.contains_text(text, "TH%_").alias("wildcard_hit"))


@query("deep_page", "H5 H6", ("logs",), "SELECT path, size FROM logs ORDER BY size DESC, path LIMIT 100 OFFSET 700")
def deep_page(spark, sf):
    files = V.log_files(spark, sf).select("path", "size")
    return ordered_slice(files, [F.desc("size"), F.asc("path")], 700, 100)


@query("area_map", "G4 D10", ("page",), """
WITH shown AS (SELECT path, name, kind, size FROM (SELECT * FROM page ORDER BY size DESC, path LIMIT 100)
  WHERE size > 0 ORDER BY size DESC, path LIMIT 24)
SELECT path, name, kind, size,
  greatest(0.1, CAST(size AS DOUBLE) / greatest(1, (SELECT CAST(sum(size) AS BIGINT) FROM shown)) * 100) AS share FROM shown""")
def area_map(spark, sf):
    return B.area_map(_page(spark, sf).items)


@query("page_numbers", "C16", ("logs",), """
SELECT parent, count(*) AS total, CAST(floor(count(*) / 100) AS BIGINT) + 1 AS page,
  CAST(greatest(1, ceil(count(*) / 100.0)) AS BIGINT) AS pages FROM logs GROUP BY parent""")
def page_numbers(spark, sf):
    counts = V.log_files(spark, sf).groupBy("parent").agg(F.count(F.lit(1)).alias("total"))
    return counts.select("parent", "total", X.page_number(F.col("total"), 100).alias("page"),
                         X.page_count(F.col("total"), 100).alias("pages"))
