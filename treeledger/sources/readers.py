"""Readers for listings as tools print them: find -printf, and object-store inventories with a manifest.

Both read with Spark's own splittable readers from any file system. A record that cannot be
understood becomes an error row, never a lost one.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.schema import LISTING

# What to give find: fields end with a tab, records with NUL, the path comes last and may hold anything else.
FIND_FORMAT = r"%y\t%s\t%b\t%T@\t%D\t%i\t%p\0"
UNREADABLE = "unreadable record in the listing"


def _nanoseconds(seconds: Column) -> Column:
    """Exact nanoseconds of a decimal text."""
    return (seconds.try_cast("decimal(30,9)") * F.lit(1_000_000_000)).try_cast("bigint")


def _listing(rows: DataFrame, good: Column, raw: Column, **columns: Column) -> DataFrame:
    """LISTING rows; where not good, the raw record stands as the path of an error."""
    values = {"path": raw, "error": F.lit(UNREADABLE)}
    none = F.lit(None)
    return rows.select(*[F.when(good, columns.get(f.name, none)).otherwise(values.get(f.name, none)).cast(f.dataType).alias(f.name)
                         for f in LISTING.fields])


def read_find_listing(spark: SparkSession, path: str) -> DataFrame:
    """A listing printed with FIND_FORMAT. Blocks, time, device and inode may be empty; kind, size and path may not."""
    lines = spark.read.option("lineSep", "\x00").text(path)
    cells = F.split("value", "\t", 7)
    rows = lines.select("value", *[F.get(cells, F.lit(i)).alias(f"c{i}") for i in range(7)])
    size = F.col("c1").try_cast("bigint")
    good = F.coalesce((F.length("c0") == 1) & size.isNotNull() & (F.length("c6") > 0), F.lit(False))
    text = [F.nullif(F.col(f"c{i}"), F.lit("")) for i in range(7)]
    return _listing(rows, good, F.col("value"), path=F.col("c6"), kind=F.col("c0"), size=size, blocks=F.col("c2").try_cast("bigint"),
                    mtime_ns=_nanoseconds(F.col("c3")), device=text[4], inode=text[5])


def read_inventory(spark: SparkSession, manifest: str, base: str) -> DataFrame:
    """An object-store inventory: a JSON manifest that names CSV data files below base and their columns.

    Keys are percent-encoded there; the path of an object is /bucket/key. A key that ends
    with a slash stands for a directory. Bucket, Key and Size must be among the columns,
    LastModifiedDate may be.
    """
    about = spark.read.option("multiLine", True).json(manifest).select("fileFormat", "fileSchema", "files.key").first()
    if about["fileFormat"] != "CSV":
        raise ValueError(f"inventories in {about['fileFormat']} are not read")
    names = [name.strip() for name in about["fileSchema"].split(",")]
    missing = {"Bucket", "Key", "Size"} - set(names)
    if missing:
        raise ValueError(f"the inventory has no {sorted(missing)}")
    schema = ", ".join(f"`{name}` STRING" for name in [*names, "_raw"])
    files = [f"{base.rstrip('/')}/{key}" for key in about["key"]]
    if not files:
        return spark.createDataFrame([], LISTING)
    rows = (spark.read.schema(schema).option("columnNameOfCorruptRecord", "_raw").option("escape", '"').option("mode", "PERMISSIVE")
            .csv(files))
    key = F.try_url_decode("Key")
    size = F.col("Size").try_cast("bigint")
    folder = key.endswith("/")
    time = F.try_to_timestamp("LastModifiedDate") if "LastModifiedDate" in names else F.lit(None).cast("timestamp")
    good = F.coalesce(F.col("_raw").isNull() & (F.length("Bucket") > 0) & (F.length(key) > 0) & (size.isNotNull() | folder), F.lit(False))
    path = F.concat(F.lit("/"), "Bucket", F.lit("/"), F.when(folder, F.left(key, F.length(key) - 1)).otherwise(key))
    record = F.coalesce("_raw", F.concat_ws(",", *[F.col(name) for name in names]))
    return _listing(rows, good, record, path=path, kind=F.when(folder, "d").otherwise("f"), size=F.coalesce(size, F.lit(0)),
                    mtime_ns=F.unix_micros(time) * 1000)
