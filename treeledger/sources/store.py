"""Immutable snapshots in Parquet, one folder per table and scan."""

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger import schema as S
from treeledger.functions.paths import POSIX, PathRules

TABLES = {"files": S.FILES, "directories": S.DIRECTORIES, "digests": S.DIGESTS, "errors": S.ERRORS,
          "extensions": S.EXTENSIONS, "candidates": S.CANDIDATES}
# Tables laid out by parent, whose data files a later snapshot may refer to.
SHAREABLE = ("files", "directories", "digests")
_SCAN_ID = re.compile(r"^[A-Za-z0-9._-]{1,128}$")


class SnapshotMissing(KeyError):
    """No complete snapshot has this id."""


class SnapshotStore:
    """Snapshots below one root folder: <root>/<table>/scan_id=<id>/.

    The summary is written last and is what makes a snapshot exist. A writer claims its id
    first, by a file that only one can create. Data files never change: a snapshot's
    manifest lists them with the range of parents in each, and the manifest of a refreshed
    snapshot (table shared) lists files of its baseline beside its own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, table: str, scan_id: str) -> str:
        if not _SCAN_ID.match(scan_id):
            raise ValueError("a scan id is made of letters, digits, dots, dashes and underscores")
        return f"{self.root}/{table}/scan_id={scan_id}"

    def _exists(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def exists(self, path: str) -> bool:
        return self._exists(path)

    def claim(self, scan_id: str) -> None:
        """Take an id for one writer, or FileExistsError. The file system's exclusive create decides a race.

        discard gives up the claim of a scan that failed.
        """
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder("claims", scan_id))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        taken = FileExistsError(f"snapshot {scan_id} is being written by another, or was left unfinished")
        if fs.getUri().getScheme() == "file":  # Hadoop's own create looks first and writes then
            if not jvm.java.io.File(path.toUri().getPath()).createNewFile():
                raise taken
            return
        try:
            fs.create(path, False).close()
        except Py4JJavaError as error:
            if fs.exists(path):
                raise taken from error
            raise

    def check_new(self, scan_id: str) -> None:
        for table in (*TABLES, "summary"):
            if self._exists(self._folder(table, scan_id)):
                raise FileExistsError(f"snapshot {scan_id} exists already and is not overwritten")

    def discard(self, scan_id: str) -> None:
        """Drop what a scan left behind that was never published, so that its id can be used again."""
        jvm = self.spark.sparkContext._jvm
        if self._exists(self._folder("summary", scan_id) + "/_SUCCESS"):
            raise FileExistsError(f"snapshot {scan_id} is published and is not dropped")
        for table in (*TABLES, "manifest", "shared", "summary", "claims"):
            path = jvm.org.apache.hadoop.fs.Path(self._folder(table, scan_id))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def write_table(self, scan_id: str, table: str, df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """Write one table of a snapshot and return it as read back from storage.

        Files are laid out by (parent, name): a directory page or a subtree then
        touches few row groups, and a directory holding much of the tree is still
        split, since its names are unique. Rows of stored have that layout already, as
        part of another snapshot, and are copied without a shuffle.
        """
        columns = TABLES[table].fieldNames()
        out = df.select(*columns)
        if "parent" in columns:
            order = ["parent", "name" if "name" in columns else "path"]
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
        if stored is not None:
            out = stored.select(*columns).unionByName(out)
        out.write.mode("errorifexists").parquet(self._folder(table, scan_id))
        return self._read(scan_id, table)

    def write_tables(self, scan_id: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write several tables at once: the tail of one job leaves slots the next can use."""
        with ThreadPoolExecutor(len(tables)) as pool:
            write = inheritable_thread_target(self.spark)(lambda item: self.write_table(scan_id, *item))
            return dict(zip(tables, pool.map(write, tables.items()), strict=True))

    def _described(self, scan_id: str, tables: list[str]) -> DataFrame:
        """The manifest of the data files in a snapshot's own folders."""
        parts = [self.spark.read.schema(TABLES[table]).parquet(self._folder(table, scan_id)).groupBy(
            F.lit(table).alias("table"),
            F.regexp_extract("_metadata.file_path", f"({table}/scan_id=[^/]+/[^/]+)$", 1).alias("file")).agg(
            F.min("parent").alias("first"), F.max("parent").alias("last"), F.count(F.lit(1)).alias("rows"),
            F.max("_metadata.file_size").alias("bytes")) for table in tables if self._exists(self._folder(table, scan_id))]
        none = self.spark.createDataFrame([], S.MANIFEST)
        return reduce(DataFrame.unionByName, parts, none).select(*S.MANIFEST.fieldNames())

    def manifest(self, scan_id: str) -> DataFrame:
        """One row per data file of the shareable tables; worked out anew for a snapshot that has none."""
        for table in ("shared", "manifest"):
            if self._exists(self._folder(table, scan_id) + "/_SUCCESS"):
                return self.spark.read.schema(S.MANIFEST).parquet(self._folder(table, scan_id))
        return self._described(scan_id, list(SHAREABLE))

    def write_manifest(self, scan_id: str, shared: DataFrame | None = None) -> DataFrame:
        """List the data files of a snapshot, its own ones and those of others that it shares."""
        own = self._described(scan_id, list(SHAREABLE))
        rows = own if shared is None else own.unionByName(shared)
        rows.coalesce(1).write.mode("errorifexists").parquet(self._folder("manifest" if shared is None else "shared", scan_id))
        return self.manifest(scan_id)

    def parted(self, scan_id: str, table: str, selected: str, single: list[str] = (),
               rules: PathRules = POSIX) -> tuple[DataFrame, DataFrame]:
        """Manifest rows of a table's data files that a subtree does not touch, and the rows of those that it may.

        Touched is a file that may hold rows whose parent is selected, below it, or one of single.
        """
        first, last, prefix = F.col("first"), F.col("last"), rules.prefix(selected)
        behind = prefix[:-1] + chr(ord(rules.sep) + 1)
        touched = (last >= prefix) & (first < behind)
        for place in (selected, *single):
            touched = touched | ((first <= place) & (last >= place))
        files = self.manifest(scan_id).where(F.col("table") == table)
        names = [r["file"] for r in files.where(touched).select("file").collect()]
        return files.where(~touched), self.data_files(table, names)

    def data_files(self, table: str, names: list[str]) -> DataFrame:
        """The rows of some data files of a table, named as the manifest names them."""
        if not names:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{name}" for name in names])

    def read_directories_of(self, scan_id: str, table: str, directories: DataFrame, most: int = 100_000) -> DataFrame:
        """The data files of a table in which rows of the given directories (parent) may lie.

        The manifest is broadcast if it has at most `most` rows; a larger table is read whole.
        """
        files = self.manifest(scan_id).where(F.col("table") == table).select("file", "first", "last")
        if files.count() > most:
            return self._read(scan_id, table)
        hit = directories.join(F.broadcast(files), F.col("parent").between(F.col("first"), F.col("last")))
        return self.data_files(table, [r["file"] for r in hit.select("file").distinct().collect()])

    def bucket(self, scan_id: str, table: str, buckets: int) -> DataFrame:
        """Keep a snapshot's comparable columns as a catalog table bucketed by path.

        Snapshots bucketed alike compare without moving a row: pass colocated=True to
        changes or classify. Worth it for a baseline that many others are held against;
        the catalog must be a shared one for the table to outlive the session.
        """
        columns = ["path", "size", "device", "inode", "fingerprint"]
        rows = self.read(scan_id, "files").select(*columns).repartition(buckets, "path")
        (rows.write.mode("errorifexists").bucketBy(buckets, "path").sortBy("path")
         .option("path", self._folder("bucketed", scan_id)).saveAsTable(table))
        return self.spark.table(table)

    def publish(self, scan_id: str, summary: DataFrame) -> DataFrame:
        """Write the one summary row, which commits the snapshot."""
        target = self._folder("summary", scan_id)
        if not self._exists(self._folder("shared", scan_id)) and not self._exists(self._folder("manifest", scan_id)):
            self.write_manifest(scan_id)
        summary.select(*S.SUMMARY.fieldNames()).coalesce(1).write.mode("errorifexists").parquet(target)
        return self.summary(scan_id)

    def _read(self, scan_id: str, table: str) -> DataFrame:
        if table in SHAREABLE and self._exists(self._folder("shared", scan_id) + "/_SUCCESS"):
            files = self.manifest(scan_id).where(F.col("table") == table)
            return self.data_files(table, [r["file"] for r in files.select("file").collect()])
        return self.spark.read.schema(TABLES[table]).parquet(self._folder(table, scan_id))

    def unpublished(self, scan_id: str, table: str) -> DataFrame:
        """A table of a snapshot that is still being written, as it will be read."""
        return self._read(scan_id, table)

    def read(self, scan_id: str, table: str) -> DataFrame:
        """A table of a committed snapshot."""
        if not self._exists(self._folder("summary", scan_id) + "/_SUCCESS"):
            raise SnapshotMissing(scan_id)
        if table == "directories":
            return repair_directories(self._read(scan_id, table), self.summary(scan_id))
        return self._read(scan_id, table)

    def summary(self, scan_id: str) -> DataFrame:
        target = self._folder("summary", scan_id)
        if not self._exists(target + "/_SUCCESS"):
            raise SnapshotMissing(scan_id)
        return repair_summary(self.spark.read.schema(S.SUMMARY).parquet(target))

    def summaries(self) -> DataFrame:
        """All summaries with their scan_id; unreadable files are passed over."""
        columns = T.StructType([*S.SUMMARY.fields, T.StructField("scan_id", T.StringType())])
        if not self._exists(f"{self.root}/summary"):
            return self.spark.createDataFrame([], columns)
        reader = self.spark.read.schema(columns).option("ignoreCorruptFiles", True)
        return repair_summary(reader.parquet(f"{self.root}/summary"))

    def catalog(self) -> DataFrame:
        return catalog(self.summaries())


def catalog(summaries: DataFrame) -> DataFrame:
    """Id, state, root and time of every snapshot, newest first."""
    state = F.when(F.col("complete"), "completed").otherwise("partial")
    return (summaries.select(F.col("scan_id").alias("id"), state.alias("state"), "root", "finished_at")
            .orderBy(F.desc("finished_at"), F.desc("id")))


def default_pair(history: DataFrame) -> DataFrame:
    """One row: the newest finished scan as current and the one before it as baseline."""
    usable = history.where(F.col("finished_at").isNotNull() & F.col("state").isin("completed", "partial"))
    newest = usable.orderBy(F.desc("finished_at"), F.desc("id")).limit(2).select("finished_at", "id")
    picked = newest.agg(F.max(F.struct("finished_at", "id")).alias("current"),
                        F.min(F.struct("finished_at", "id")).alias("baseline"))
    return picked.select(F.col("baseline.id").alias("baseline"), F.col("current.id").alias("current"))


def _is_volume_root(root):
    return root.rlike(r"^(/|[A-Za-z]:\\)$")


def repair_summary(summaries: DataFrame) -> DataFrame:
    """Old snapshots of a volume root listed a wrong size for it; the total is the right one."""
    fixed = F.transform("directories", lambda d: F.when(d["path"] == F.col("root"), F.struct(
        d["path"].alias("path"), F.col("bytes").alias("size"))).otherwise(d))
    return summaries.withColumn("directories", F.when(_is_volume_root(F.col("root")), fixed)
                                .otherwise(F.col("directories")))


def repair_directories(directories: DataFrame, summary: DataFrame) -> DataFrame:
    """The same for the directory table; summary is one row."""
    root = summary.where(_is_volume_root(F.col("root"))).select(F.struct("root", "bytes")).scalar()
    size = F.when(F.col("path") == root["root"], root["bytes"]).otherwise(F.col("size"))
    return directories.withColumn("size", size)
