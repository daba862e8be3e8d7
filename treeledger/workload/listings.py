"""Listings written as other tools print them, and read again."""

import json

from pyspark.sql import functions as F

from treeledger.schema import QUARANTINE_NAME
from treeledger.sources import ingest as I
from treeledger.sources.readers import UNREADABLE, read_find_listing, read_inventory
from treeledger.sources.workspace import new_folder
from treeledger.workload import space, views as V
from treeledger.workload.registry import SQL, query


def _printed(spark, sf, broken=False) -> str:
    """The raw listing as find prints it; broken adds records that are cut short."""
    rows = V.raw_listing(spark, sf, QUARANTINE_NAME)
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (
        F.col("kind"), F.col("size"), F.expr("allocated div 512"), F.col("modified").cast("decimal(20,10)"), F.col("device"),
        F.col("inode"), F.col("path"))]
    lines = rows.select(F.concat_ws("\t", *text).alias("value"))
    if broken:
        lines = lines.unionByName(V.access_errors(spark, sf).select(F.concat(F.lit("f\t12\t"), "path").alias("value")))
    folder = new_folder(spark, "listing")
    lines.write.option("lineSep", "\x00").text(folder)
    return folder


@query("read_find_listing", "A1", (), SQL["ingest_listing"])
def read_printed(spark, sf):
    return space.whole_seconds(I.ingest(read_find_listing(spark, _printed(spark, sf)), V.ROOT).files)


@query("find_listing_errors", "A1 A6", ("errors",), f"SELECT 'f' || chr(9) || '12' || chr(9) || path AS path, '{UNREADABLE}' AS reason FROM errors")
def find_listing_errors(spark, sf):
    """Records without all fields come out as errors, by their text."""
    listing = read_find_listing(spark, _printed(spark, sf, broken=True))
    return listing.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


@query("read_inventory_listing", "A1 F1", ("wh_new",), """
SELECT '/bucket' || path || ' ä%2C,"' AS path, size FROM wh_new""")
def read_inventory_listing(spark, sf):
    """The warehouse tree as an object-store inventory with its manifest; keys hold what has to be encoded and quoted."""
    files, folder = V.new_orders(spark, sf), new_folder(spark, "inventory")
    key = F.url_encode(F.concat(F.substring("path", 2, 1000), F.lit(' ä%2C,"')))
    rows = files.select(F.lit("bucket").alias("Bucket"), key.alias("Key"), F.col("size").cast("string").alias("Size"),
                        F.lit("2024-01-01T00:00:00.000Z").alias("LastModifiedDate"))
    rows.write.option("escape", '"').option("quoteAll", True).csv(f"{folder}/data")
    names = [r[0] for r in spark.read.text(f"{folder}/data").select(F.substring_index("_metadata.file_path", "/", -1)).distinct().collect()]
    about = {"fileFormat": "CSV", "fileSchema": "Bucket, Key, Size, LastModifiedDate", "files": [{"key": f"data/{n}"} for n in names]}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    listing = read_inventory(spark, f"{folder}/manifest", folder)
    return I.ingest(listing, "/bucket").files.select("path", "size")
