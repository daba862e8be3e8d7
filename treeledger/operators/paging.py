"""Stable pages: top-k, keyset continuation, and jumps into rows written out in order."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.schema import MAX_PAGE_ROWS
from treeledger.sources.workspace import materialize

@dataclass(frozen=True)
class Page:
    """One page of rows and a one-row table describing it."""

    items: DataFrame
    meta: DataFrame


def check_page(offset, limit) -> None:
    if type(offset) is not int or offset < 0 or type(limit) is not int or not 1 <= limit <= MAX_PAGE_ROWS:
        raise ValueError("offset must be an int >= 0 and limit an int between 1 and 500")


def ordered_slice(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of the given total order; lazy, and one plan at every depth.

    A task keeps offset + limit rows at most: in a heap, or in a sort that spills from
    spark.sql.execution.topKSortFallbackThreshold rows on. rows_after costs the same at
    any depth, and placed_slice serves jumps into rows that are written out anyway.
    """
    return df.orderBy(*order).offset(offset).limit(limit)


def last_rows(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The last rows by ascending keys, in that order: a top-k from the far end, which sorts nothing else."""
    return df.orderBy(*[F.desc(key) for key in keys]).limit(limit).orderBy(*keys)


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows written out in a total order, each with its part and its place therein as one number, _seq."""
    return materialize(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()))


def placed_slice(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of placed rows, at the same cost for any offset.

    A count per part (as many rows as the write had tasks) turns the ranks into one
    interval of _seq, and only what lies in it is read with all its columns.
    """
    part, count = F.shiftright("_seq", 33).alias("part"), F.count(F.lit(1)).alias("rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part).agg(count).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))

    def seq_of(rank: int) -> Column:
        here = parts.where((F.col("start") <= rank) & (F.col("start") + F.col("rows") > rank))
        found = here.agg(F.max(F.shiftleft("part", 33) + (F.lit(rank) - F.col("start")))).scalar()
        return F.coalesce(found, F.lit(1 << 62))

    inside = (F.col("_seq") >= seq_of(offset)) & (F.col("_seq") < seq_of(offset + limit))
    return rows.where(inside).orderBy("_seq").drop("_seq")


def write_index(rows: DataFrame, order: list[Column], folder: str) -> None:
    """Keep rows in a total order below a folder, with an index: which places lie in which data file.

    The index has a row per data file. A jump to any place then opens the files that hold
    its page, and in these what the column _seq lets through.
    """
    rows.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()).write.mode("errorifexists").parquet(f"{folder}/rows")
    kept = rows.sparkSession.read.parquet(f"{folder}/rows")
    name = F.substring_index("_metadata.file_path", "/", -1).alias("file")
    files = kept.groupBy(name).agg(F.min("_seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    places = files.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    places.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/places")


def indexed_slice(spark: SparkSession, folder: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of an index, from the one or few data files that hold them."""
    places = spark.read.parquet(f"{folder}/places")
    hit = places.where((F.col("start") < offset + limit) & (F.col("start") + F.col("rows") > offset)).orderBy("start").collect()
    schema = spark.read.parquet(f"{folder}/rows").schema
    if not hit:
        return spark.createDataFrame([], schema).drop("_seq")
    wanted = F.lit(False)
    for place in hit:
        low = place["first"] + max(0, offset - place["start"])
        high = place["first"] + min(place["rows"], offset + limit - place["start"])
        wanted = wanted | ((F.col("_seq") >= low) & (F.col("_seq") < high))
    rows = spark.read.schema(schema).parquet(*[f"{folder}/rows/{place['file']}" for place in hit])
    return rows.where(wanted).orderBy("_seq").drop("_seq")


def rows_after(keys: list[tuple[Column, bool, object]]) -> Column:
    """Predicate for rows that come after a known row; keys are (column, descending, value)."""
    tests = []
    for i, (column, descending, value) in enumerate(keys):
        same = [other == F.lit(known) for other, _, known in keys[:i]]
        later = column < F.lit(value) if descending else column > F.lit(value)
        tests.append(reduce(lambda a, b: a & b, same, later))
    return reduce(lambda a, b: a | b, tests)
