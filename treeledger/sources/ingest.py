"""Raw listings to inventory tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.links import rows_by_marked_parent
from treeledger.operators.paging import placed, placed_slice
from treeledger.operators.joins import lookup_join
from treeledger.schema import FILES, QUARANTINE_NAME
from treeledger.sources.workspace import materialize


@dataclass(frozen=True)
class Ingest:
    """What one listing amounts to. rows is the classified listing, counts one row: files, bytes, errors, skipped."""

    rows: DataFrame
    files: DataFrame
    directories: DataFrame
    errors: DataFrame
    counts: DataFrame


def _column(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def normalize_listing(listing: DataFrame) -> DataFrame:
    """Accept blocks or allocated, mtime_ns or modified; a missing error column means none."""
    modified = _column(listing, "modified", F.lit(None)).cast("double")
    ns = _column(listing, "mtime_ns", (F.col("modified") * 1_000_000_000 if "modified" in listing.columns
                                       else F.lit(None)).cast("bigint"))
    blocks = _column(listing, "blocks", F.lit(None)).cast("bigint")
    return listing.select(
        "path", "kind", F.col("size").cast("bigint").alias("size"),
        _column(listing, "allocated", P.allocated_bytes(blocks)).cast("bigint").alias("allocated"),
        F.coalesce(modified, ns / 1_000_000_000).alias("modified"), ns.alias("mtime_ns"),
        F.col("device").cast("string").alias("device"), F.col("inode").cast("string").alias("inode"),
        _column(listing, "error", F.lit(None)).cast("string").alias("error"))


def classify(listing: DataFrame, root: str, exclude_paths=(), quarantine: str = QUARANTINE_NAME,
             links_followed: bool = False, rules: PathRules = POSIX) -> DataFrame:
    """Listing rows of root and below with entry = file, directory, skipped, ignored or error.

    Root's own row says only whether root could be read. registered marks directories,
    also those that could not be read.

    Links, the quarantine and excluded paths count as skipped once, at the top;
    whatever lies beneath them is dropped. A lister that follows links needs
    links_followed, which matches every directory's ancestors against the links.
    """
    path = F.col("path")
    rows = normalize_listing(listing).where(rules.inside(path, root))
    below = path != root
    excluded = [rules.normalize(p) for p in exclude_paths]
    beneath = rules.has_component_below(path, root, quarantine) | rules.under_any(path, excluded)
    rows = rows.where(~beneath).withColumn("parent", rules.parent(path)).withColumn("name", rules.name(path))
    if links_followed:
        links = rows.where("kind = 'l'").select("path")
        rows = rows_by_marked_parent(rows, links, root, "left_anti", rules)
    stop = below & ((F.col("kind") == "l") | (F.col("name") == quarantine))
    if excluded:
        stop = stop | (below & path.isin(*excluded))
    entry = (F.when(F.col("error").isNotNull(), "error").when(stop, "skipped").when(below & (F.col("kind") == "f"), "file")
             .when(F.col("kind") == "d", "directory").otherwise("ignored"))
    registered = F.coalesce((F.col("kind") == "d") & ~stop, F.lit(False))
    return rows.withColumn("entry", entry).withColumn("registered", registered)


def files_of(classified: DataFrame) -> DataFrame:
    found = (classified.where("entry = 'file'")
             .withColumn("extension", P.extension(F.col("name")))
             .withColumn("fingerprint", P.fingerprint(F.col("device"), F.col("inode"), F.col("size"), F.col("mtime_ns"))))
    return found.select(*FILES.fieldNames())


def directories_of(classified: DataFrame, root: str) -> DataFrame:
    """Registered directories: those listed, whether or not they could be read, and the root itself."""
    start = classified.sparkSession.range(1).select(F.lit(root).alias("path"))
    return classified.where("registered").select("path").unionByName(start).distinct()


def errors_of(classified: DataFrame) -> DataFrame:
    return classified.where("entry = 'error'").select("path", F.col("error").alias("reason"))


def counts_of(classified: DataFrame) -> DataFrame:
    entry = F.col("entry")
    return classified.agg(
        F.count_if(entry == "file").alias("files"),
        F.coalesce(F.sum(F.when(entry == "file", F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(entry == "error").alias("errors"), F.count_if(entry == "skipped").alias("skipped"))


def check_root(listing: DataFrame, root: str) -> None:
    """Refuse a listing whose root is a link, or anything else than a directory."""
    if not listing.where((F.col("path") == root) & (F.col("kind") != "d")).isEmpty():
        raise ValueError("the root of the listing is no directory")


def ingest(listing: DataFrame, root: str, exclude_paths=(), quarantine: str = QUARANTINE_NAME,
           links_followed: bool = False, rules: PathRules = POSIX, written: bool = False) -> Ingest:
    """All of a listing. written keeps the classified rows in the work folder, so the listing is read once."""
    rows = classify(listing, root, exclude_paths, quarantine, links_followed, rules)
    if written:
        rows = materialize(rows)
    return Ingest(rows, files_of(rows), directories_of(rows, root), errors_of(rows), counts_of(rows))


def limit_scan(files: DataFrame, directories: DataFrame, max_files: int | None = None,
               max_dirs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bounded scan in path order: files, directories, and a one-row table (complete, cut).

    cut says that files were left out, complete that nothing was. What a limit applies to is
    written out in path order, so that a large limit gathers in no single task.
    """
    for limit in (max_files, max_dirs):
        if limit is not None and limit < 1:
            raise ValueError("scan limits must be at least 1")
    complete, cut = F.lit(True), F.lit(False)
    path = [F.col("path")]
    if max_dirs is not None:
        complete = complete & (directories.agg(F.count(F.lit(1))).scalar() <= max_dirs)
        directories = placed_slice(placed(directories, path), 0, max_dirs)
        files = lookup_join(files, directories.select(F.col("path").alias("parent")), ["parent"], "left_semi", ["path"])
    if max_files is not None:
        cut = files.agg(F.count(F.lit(1))).scalar() > max_files
        complete = complete & ~cut
        files = placed_slice(placed(files, path), 0, max_files)
    return files, directories, files.sparkSession.range(1).select(complete.alias("complete"), cut.alias("cut"))


def seen_by(rows: DataFrame, files: DataFrame, directories: DataFrame, state: DataFrame, root: str) -> DataFrame:
    """Classified rows that a bounded scan came by: the root's own, and those in its directories; where files
    were cut, up to the last it kept."""
    below = F.col("path") != root
    inside = lookup_join(rows.where(below), directories.select(F.col("path").alias("parent")), ["parent"], "left_semi",
                         ["path"]).select(*rows.columns)
    last = files.agg(F.max("path")).scalar()
    reached = inside.where(~state.select("cut").scalar() | (F.col("path") <= last))
    return reached.unionByName(rows.where(~below))
