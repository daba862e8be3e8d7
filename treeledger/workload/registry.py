"""Where queries and their SQL counterparts are collected."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.workload.sql import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a query under a name, with the inventory rows it covers and its SQL."""
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain(function(spark, sf))
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return function
    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the SQL side has them."""
    return df.select(*[F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)
                       for name, kind in df.dtypes])
