"""Content digests for duplicate review."""

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import UNKNOWN

_CHUNK = 1 << 20


def digest_column(rows: DataFrame, content: Column, key: str = "path") -> DataFrame:
    """Digest content that lies in a table column. Runs in the scan: only digests are ever shuffled."""
    return rows.select(key, F.sha2(content, 256).alias("sha256"))


def digest_binary_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """Digest every visible file below a folder with the built-in reader.

    The length filter reaches the reader, so other files are never opened. The
    reader leaves out names starting with '.' or '_'; digest_files does not.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    wanted = F.col("length") > 0 if max_bytes is None else F.col("length").between(1, max_bytes)
    return (found.where(wanted)
            .select(F.regexp_replace("path", "^file:(//)?", "").alias("path"),
                    F.sha2("content", 256).alias("sha256")))


def digest_files(candidates: DataFrame, partitions: int | None = None) -> DataFrame:
    """Digest exactly the candidate files (path, fingerprint), streamed in chunks on the executors.

    Spark has no reader that takes its file list from a table, hence the Arrow
    function. Size and time are compared with the fingerprint before and after
    reading, as far as it has them; a file that changed or cannot be read gets a null
    digest. Files are dealt to the tasks from the largest to the smallest, so that all
    tasks read about the same number of bytes.
    """
    spark = candidates.sparkSession
    partitions = partitions or 4 * spark.sparkContext.defaultParallelism
    size = F.element_at(F.split("fingerprint", ":"), -2).try_cast("bigint")
    ranked = candidates.select("path", "fingerprint").orderBy(size.desc_nulls_last(), "path")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = ranked.withColumn("_task", F.pmod(place, F.lit(partitions)).cast("int")).repartitionById(partitions, "_task")
    return dealt.select("path", "fingerprint").mapInArrow(_digest_batches, "path string, sha256 string")


def digest_ranges(asked: DataFrame, partitions: int | None = None) -> DataFrame:
    """Digest ranges (path, fingerprint, size, start, length) of files: path, start, sha256, null where the file changed.

    A range that reaches the size goes on to the end of the file. Ranges are dealt like
    whole files, from the longest to the shortest.
    """
    partitions = partitions or 4 * asked.sparkSession.sparkContext.defaultParallelism
    ranked = asked.select("path", "fingerprint", "size", "start", "length").orderBy(
        F.desc(F.least("length", F.col("size") - F.col("start"))), "path", "start")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = ranked.withColumn("_task", F.pmod(place, F.lit(partitions)).cast("int")).repartitionById(partitions, "_task")
    return dealt.drop("_task").mapInArrow(_digest_range_batches, "path string, start long, sha256 string")


def digest_column_ranges(asked: DataFrame, rows: DataFrame, content: Column, key: str = "path") -> DataFrame:
    """The same of content that lies in a table column; ranges and sizes count its bytes.

    Content is read where it lies and only digests are moved, for one range a file and stage.
    """
    ranges = asked.select("start", "length").distinct()
    raw = F.encode(content, "UTF-8")
    whole = rows.select(F.col(key).alias("path"), raw.alias("_raw"), F.octet_length(raw).alias("_bytes"))
    cut = whole.join(F.broadcast(ranges), F.col("start") < F.col("_bytes"))
    part = F.when(F.col("start") + F.col("length") >= F.col("_bytes"), F.substring("_raw", F.col("start").cast("int") + 1, F.lit(0x7FFFFFFF)))
    part = part.otherwise(F.substring("_raw", F.col("start").cast("int") + 1, F.col("length").cast("int")))
    return cut.select("path", "start", F.sha2(part, 256).alias("sha256"))


def _digest_range_batches(batches):
    for batch in batches:
        rows = [column.to_pylist() for column in batch.columns]
        digests = [_digest(path, known, start, None if start + length >= size else length)
                   for path, known, size, start, length in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[3], pa.int64()), pa.array(digests, pa.string())],
                                         names=["path", "start", "sha256"])


def _digest_batches(batches):
    for batch in batches:
        paths, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        digests = [_digest(path, known) for path, known in zip(paths, prints, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests, pa.string())],
                                         names=["path", "sha256"])


def _digest(path: str, fingerprint: str, start: int = 0, length: int | None = None) -> str | None:
    """Digest of a file, or of `length` bytes from start on, or null if it is not as its fingerprint says."""
    expected = [None if part == UNKNOWN else int(part) for part in fingerprint.split(":")[-2:]]
    try:
        store, inner = (pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path))

        def observed():
            info = store.get_file_info(inner)
            return (info.size, info.mtime_ns) if info.type == pafs.FileType.File else None

        before = observed()
        if before is None or any(known not in (None, now) for known, now in zip(expected, before)):
            return None
        digest = hashlib.sha256()
        with (store.open_input_file(inner) if start else store.open_input_stream(inner)) as source:
            if start:
                source.seek(start)
            left = length
            while chunk := source.read(_CHUNK if left is None else min(_CHUNK, left)):
                digest.update(chunk)
                left = None if left is None else left - len(chunk)
        return digest.hexdigest() if observed() == before else None
    except (OSError, pa.ArrowException):
        return None
