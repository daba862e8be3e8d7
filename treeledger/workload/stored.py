"""Stored snapshots that share data files, are compared by digests, and are paged through an index."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.workload.registry import query
from treeledger.workload.reports import refreshed, stored, stored_pair


@query("manifest_refresh", "B1 N3 A3 I3", ("merged",), """
SELECT path, parent, name, size, allocated, extension, modified, device, inode, fingerprint FROM merged""")
def manifest_refresh(spark, sf):
    """All files of a refreshed snapshot, from data files of its own and of its baseline."""
    files = refreshed(spark, sf).store.read("mixed", "files").drop("mtime_ns")
    return files.withColumn("modified", F.col("modified").cast("bigint"))


@query("manifest_directories", "F4 N3 I4", ("merged", "mergeddirs"), """
SELECT d.path, CAST(coalesce(sum(m.size), 0) AS BIGINT) AS size FROM mergeddirs d
LEFT JOIN merged m ON starts_with(m.path, d.path || '/') GROUP BY d.path""")
def manifest_directories(spark, sf):
    """Directory sizes after a refresh that added nothing up outside the subtree."""
    return refreshed(spark, sf).store.read("mixed", "directories").select("path", "size")


@query("digest_comparison", "E1 N2", ("changed",), """
SELECT path, kind, baseline_size, current_size, delta_bytes FROM changed""")
def digest_comparison(spark, sf):
    return stored_pair(spark, sf).compare("old", "new", digests=True).rows


@query("digest_equal_subtrees", "E1 E2 N2", ("merged", "oldf"), """
SELECT path, kind, baseline_size, current_size, delta_bytes FROM (
  SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'resized' END AS kind,
    b.size AS baseline_size, a.size AS current_size, coalesce(a.size, 0) - coalesce(b.size, 0) AS delta_bytes
  FROM oldf b FULL JOIN merged a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size)
WHERE kind = 'resized'""")
def digest_equal_subtrees(spark, sf):
    """A refreshed snapshot against its baseline: all but the scope is equal and is not looked at."""
    return refreshed(spark, sf).compare("old", "mixed", kind="resized", digests=True).rows


_DEEP = ["size", "allocated", "name", "modified"]


@query("stored_deep_page", "H4 H5 A3", ("newf",), " UNION ALL ".join(f"""
SELECT '{sort}' AS sort, path, size FROM (SELECT path, size FROM newf ORDER BY {order}, path
  LIMIT 100 OFFSET (SELECT count(*) - 130 FROM newf))""" for sort, order in zip(_DEEP, (
    "size DESC", "coalesce(allocated, -1) DESC", "lower(name)", "modified DESC"))))
def stored_deep_page(spark, sf):
    """The last full page but thirty rows, in four orders, each read through its index."""
    ledger = stored(spark, sf)
    ledger.index_pages("new", tuple(_DEEP))
    offset = ledger.store.read("new", "files").count() - 130
    pages = [ledger.browse("new", recursive=True, sort=sort, offset=offset).items.select(F.lit(sort).alias("sort"), "path", "size")
             for sort in _DEEP]
    return reduce(DataFrame.unionByName, pages)


@query("indexed_search", "C7 D8 H5", ("newf",), """
SELECT path, size FROM newf WHERE contains(lower(path), 'doc-1') UNION ALL SELECT path, size FROM newf WHERE contains(path, 'LN-') OR contains(path, 'ln-')""")
def indexed_search(spark, sf):
    """Two literal searches, one in capitals, over data files that the index lets through."""
    ledger = stored(spark, sf)
    ledger.index_search("new")
    return ledger.search("new", "Doc-1").unionByName(ledger.search("new", "LN-")).select("path", "size")
