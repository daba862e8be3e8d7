"""Durable intermediate results in the folder the cluster names for them."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: spark.checkpoint.dir, or a local one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="treeledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below one for this application, which can be dropped when that has ended."""
    return f"{work_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute a frame once and go on from files that outlive any executor."""
    spark = df.sparkSession
    folder = new_folder(spark, "stage")
    df.write.mode("errorifexists").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
