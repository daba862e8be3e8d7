"""Inventories derived from the given tables; every view covers its whole table.

doc_id % 8 decides what happens to a document's file between the two snapshots:
0 removed, 1 added, 2 replaced, 3 resized, 4 new time only, 5-7 nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.paths import POSIX

NOW = 1704067200
ROOT = "/data"
SCOPE = "/data/en"
EMPTY = "/data/empty"
TEMP_ROOTS = ["/data/en", "/data/links"]


# A given schema saves the job that would read one from the files.
_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


_NAMES = """concat('doc-', doc_id, CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.LOG' WHEN 2 THEN '.tmp'
  WHEN 3 THEN '' WHEN 4 THEN '.tar.gz' ELSE '.md' END)"""
# A second, hard-linked name for every tenth document, from the same pass.
_PLACES = f"""explode(filter(array(struct(concat('/data/', lang, '/', source) AS parent, {_NAMES} AS name),
  IF(doc_id % 10 = 5, struct(concat('/data/links/', source) AS parent, concat('ln-', doc_id, '.txt') AS name), NULL)),
  p -> p IS NOT NULL)) AS at"""


def _documents(spark: SparkSession, sf: str, missing_class: int, size: str, inode: str, ns: str) -> DataFrame:
    rows = (table(spark, sf, "documents").where(f"doc_id % 8 <> {missing_class}")
            .selectExpr("doc_id", "text", f"{size} AS size", f"CAST({inode} AS STRING) AS inode",
                        f"{NOW} - ((doc_id * 7) % 19) * 86400 AS seconds", _PLACES)
            .selectExpr("concat(at.parent, '/', at.name) AS path", "at.parent", "at.name", "size",
                        "IF(doc_id % 50 = 49, NULL, CAST(ceil(size / 4096) * 4096 AS BIGINT)) AS allocated",
                        "CAST(seconds AS DOUBLE) AS modified", f"seconds * 1000000000 + {ns} AS mtime_ns",
                        "'1' AS device", "inode", "doc_id", "text"))
    return rows.withColumns({
        "extension": P.extension(F.col("name")),
        "fingerprint": P.fingerprint(F.col("device"), F.col("inode"), F.col("size"), F.col("mtime_ns"))})


def old_files(spark: SparkSession, sf: str) -> DataFrame:
    size = "IF(doc_id % 8 = 3 OR doc_id % 16 = 2, n_chars + 1, n_chars)"
    return _documents(spark, sf, 1, size, "doc_id + 1", "0")


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    inode = "IF(doc_id % 8 = 2, doc_id + 1000001, doc_id + 1)"
    return _documents(spark, sf, 0, "n_chars", inode, "IF(doc_id % 8 = 4, 1, 0)")


def registered(files: DataFrame, *empty: str) -> DataFrame:
    """Directories of a snapshot; empty names those that hold no file."""
    parents = files.select(F.col("parent").alias("path")).distinct()
    middle = parents.select(F.concat(F.lit("/data/"), F.split_part("path", F.lit("/"), F.lit(3))).alias("path"))
    fixed = files.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in (ROOT, *empty)])).alias("path"))
    return parents.unionByName(middle).unionByName(fixed).distinct()


def mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The current snapshot with some files right in the scope, next to its directories."""
    files = new_files(spark, sf).drop("text")
    top = files.where(f"startswith(path, '{SCOPE}/') AND doc_id % 9 = 0").withColumns({
        "parent": F.lit(SCOPE), "path": F.expr(f"concat('{SCOPE}/Top-', name)"), "name": F.expr("concat('Top-', name)")})
    return files.unionByName(top)


def raw_listing(spark: SparkSession, sf: str, quarantine: str) -> DataFrame:
    """The current tree as a lister would print it: files, links, pipes, folders, a quarantine."""
    files = new_files(spark, sf)
    aside = f"{SCOPE}/{quarantine}"

    def rows(df: DataFrame, path: str, kind: str, size: str = "0L", allocated: str = "0L",
             modified: str = "modified", device: str = "device", inode: str = "inode") -> DataFrame:
        return df.selectExpr(f"{path} AS path", f"'{kind}' AS kind", f"{size} AS size", f"{allocated} AS allocated",
                             f"{modified} AS modified", f"{device} AS device", f"{inode} AS inode")

    def folders(df: DataFrame, inode: str) -> DataFrame:
        return rows(df, "path", "d", modified=f"DOUBLE({NOW})", device="'1'", inode=f"'{inode}'")

    parts = [
        rows(files.where("doc_id % 25 = 1"), "concat(parent, '/lnk-', doc_id)", "l"),
        rows(files.where("doc_id % 60 = 7"), "concat(parent, '/pipe-', doc_id)", "p"),
        rows(files.where("doc_id % 40 = 9"), f"concat('{aside}/q-', doc_id)", "f", "size", "allocated"),
        folders(spark.range(1).selectExpr(f"'{aside}' AS path"), "900000001"),
        folders(registered(files, EMPTY), "900000002"),
    ]
    listing = rows(files, "path", "f", "size", "allocated")
    for part in parts:
        listing = listing.unionByName(part)
    return listing


def access_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every thirtieth document could not be read; its text is the (long) reason."""
    return new_files(spark, sf).where("doc_id % 30 = 7").selectExpr(
        "path", "concat('Permission denied: ', path, ' ', text) AS error")


def journal(spark: SparkSession, sf: str, quarantine: str) -> tuple[DataFrame, DataFrame]:
    """Moves of the scope's files, and what storage shows at their ends."""
    rows = old_files(spark, sf).where(POSIX.under(F.col("path"), SCOPE)).selectExpr(
        "concat('m', doc_id) AS id", "path AS source", f"concat('{SCOPE}/{quarantine}/m', doc_id) AS destination",
        "size", "fingerprint", """CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'quarantined'
          WHEN 2 THEN 'restoring' WHEN 3 THEN 'purging' WHEN 4 THEN 'restored' ELSE 'failed' END AS state""",
        f"DOUBLE({NOW} + doc_id) AS created", "concat('b', doc_id % 5) AS batch", "device", "inode",
        "floor(doc_id / 6) % 4 IN (1, 3) AS at_source", "floor(doc_id / 6) % 4 IN (2, 3) AS at_destination",
        "IF(doc_id % 7 = 0, 'changed', fingerprint) AS seen",
        # Half of the doubly present ones are two different files.
        "IF(floor(doc_id / 24) % 2 = 0, inode, concat('9', inode)) AS other")
    present = rows.selectExpr("seen AS fingerprint", "device", """explode(filter(array(
        IF(at_source, struct(source AS path, inode AS inode), NULL),
        IF(at_destination, struct(destination AS path, other AS inode), NULL)), e -> e IS NOT NULL)) AS at""")
    moves = rows.select("id", "source", "destination", "size", "fingerprint", "state", "created", "batch")
    return moves, present.select("at.path", "fingerprint", "device", "at.inode")


def _orders(spark: SparkSession, sf: str, missing: int, grown: str) -> DataFrame:
    placed = table(spark, sf, "orders").where(f"o_orderkey % 9 <> {missing}").selectExpr(
        "concat('/wh/', o_orderstatus, '/c', o_custkey % 100) AS parent", "concat('o-', o_orderkey, '.dat') AS name",
        f"floor(o_totalprice) + {grown} AS size")
    return placed.selectExpr("concat(parent, '/', name) AS path", "parent", "name", "size")


def old_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, 0, "0")


def new_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, 1, "IF(o_orderkey % 5 = 0, 2, 0)")


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """One log file per event, with the event's own time."""
    rows = table(spark, sf, "events").selectExpr(
        "concat('/logs/', event_type, '/u', user_id) AS parent", "concat('ev-', event_id, '.log') AS name",
        "floor(value * 100) AS size", "ceil(value * 100 / 512) AS blocks",
        "datediff(ts, '1970-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds",
        "'7' AS device", "CAST(event_id AS STRING) AS inode")
    files = rows.selectExpr("concat(parent, '/', name) AS path", "*", "DOUBLE(seconds) AS modified",
                            "seconds * 1000000000 AS mtime_ns")
    return files.withColumns({
        "allocated": P.allocated_bytes(F.col("blocks")), "extension": P.extension(F.col("name")),
        "fingerprint": P.fingerprint(F.col("device"), F.col("inode"), F.col("size"), F.col("mtime_ns"))})
