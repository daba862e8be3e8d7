"""Which data files may hold a path that contains a text: bitmaps of three-letter sequences."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.text import ascii_lower

BITS = 1 << 20  # of one data file's bitmap; it is kept in pieces of 32,768 bits
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct sequences of three characters, A-Z as a-z; none of a shorter text."""
    low, places = ascii_lower(text), F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    found = F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)) + 1


def write_search_index(files: DataFrame, folder: str) -> None:
    """Keep file, bucket, bits for the data files of a stored table of paths.

    The sequences of one data file are told apart before anything is moved; at most BITS
    bits of a file leave the tasks that read it.
    """
    name = F.regexp_extract("_metadata.file_path", "(files/scan_id=[^/]+/[^/]+)$", 1).alias("file")
    bits = files.select(name, F.explode(_grams(F.col("path"))).alias("gram")).select("file", _place(F.col("gram")).alias("place"))
    bits = bits.groupBy("file", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits.repartition("bucket").sortWithinPartitions("bucket", "file").write.mode("errorifexists").parquet(folder)


def files_that_may_hold(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """Data files (file) whose bitmaps have every three-letter sequence of the query; None where it is shorter than that."""
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(_grams(F.col("q"))).alias("gram"))
    places = [r[0] for r in asked.select(_place(F.col("gram"))).distinct().collect()]
    if not places:
        return None
    wanted = spark.createDataFrame([(p,) for p in places], "place long").select(
        F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    held = spark.read.parquet(folder).where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "bucket")
    byte = F.expr("conv(hex(substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)), 16, 10)").cast("int")
    hit = held.where(F.bit_get(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1)
    return hit.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(places)).select("file")
