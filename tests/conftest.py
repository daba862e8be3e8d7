import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("treeledger-tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def files(spark):
    """Build a files table from {path: size} or {path: (size, inode, seconds)}."""
    from pyspark.sql import functions as F

    from treeledger.sources.ingest import classify, files_of

    def build(content, root="/"):
        rows = []
        for i, (path, fact) in enumerate(content.items()):
            size, inode, seconds = fact if isinstance(fact, tuple) else (fact, i + 1, 0)
            rows.append((path, "f", size, 1, seconds * 1_000_000_000, "1", str(inode)))
        listing = spark.createDataFrame(
            rows, "path string, kind string, size bigint, blocks bigint, mtime_ns bigint, device string, inode string")
        return files_of(classify(listing, root)).where(F.lit(True))
    return build
