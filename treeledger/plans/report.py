"""Exports and the shareable summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions import text as X
from treeledger.operators.rollup import rank_extensions

BOM = "\ufeff"
INVENTORY_HEADER = "path,logical_bytes,allocated_bytes,modified_epoch,extension"
COMPARISON_HEADER = ("path,kind,baseline_size,current_size,delta_bytes,"
                     "baseline_coverage_complete,current_coverage_complete")
NOTICE = "contains names and paths of this machine; no file content"


def inventory_lines(files: DataFrame) -> DataFrame:
    """CSV records (path, line) of a whole inventory."""
    line = X.csv_line(X.formula_guard(F.col("path")), F.col("size"), F.col("allocated"),
                      X.float_text(F.col("modified")), F.col("extension"))
    return files.select("path", line.alias("line"))


def comparison_lines(rows: DataFrame) -> DataFrame:
    """CSV records (path, line) of comparison rows that carry both coverage flags."""
    line = X.csv_line(X.strict_formula_guard(F.col("path")), F.col("kind"), F.col("baseline_size"),
                      F.col("current_size"), F.col("delta_bytes"),
                      X.flag_text(F.col("baseline_coverage_complete")),
                      X.flag_text(F.col("current_coverage_complete")))
    return rows.select("path", line.alias("line"))


def write_csv(lines: DataFrame, header: str, folder: str) -> None:
    """Write records in path order as part files; one after the other they are the whole CSV.

    The header sorts first, so only the first part has it, behind the byte order
    mark. The sort is by ranges and no task sees more than its share.
    """
    first = lines.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"),
                                               F.lit(BOM + header).alias("line"))
    ordered = lines.unionByName(first).orderBy(F.asc_nulls_first("path")).select("line")
    ordered.write.mode("errorifexists").option("lineSep", "\r\n").text(folder)


def json_report(summary: DataFrame) -> DataFrame:
    """The summary row as JSON text."""
    return summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def whole_report(summary: DataFrame, extensions: DataFrame, candidates: DataFrame) -> DataFrame:
    """JSON records (part, report): one summary, then every extension and every candidate.

    Lists without a bound are rows here, so a report of any size is written in parts.
    """
    parts = [json_report(rows).select(F.lit(part).alias("part"), "report")
             for part, rows in (("summary", summary), ("extension", extensions), ("candidate", candidates))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_report(reports: DataFrame, schema) -> DataFrame:
    return reports.select(F.from_json("report", schema).alias("s")).select("s.*")


def share_summary(summary: DataFrame, extensions: DataFrame, include_paths: bool = False,
                  path_chars: int | None = None) -> DataFrame:
    """What may be shown to others: totals and sizes, paths only on request, cut for display with path_chars.

    Both inputs are stored tables: a one-row summary and the extension totals.
    """
    top = rank_extensions(extensions).limit(30)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("_k"), "extension", "files", "bytes")))
    listed = top.agg(F.transform(packed, lambda r: F.struct(r["extension"].alias("extension"),
                                                            r["files"].alias("files"), r["bytes"].alias("bytes"))))
    columns = [
        F.col("bytes").alias("logical_bytes"), F.col("files").alias("file_count"),
        F.col("errors").alias("unreadable_count"),
        F.col("candidate_files").alias("temporary_candidate_count"),
        F.col("candidate_bytes").alias("temporary_candidate_bytes"),
        F.transform(F.slice("largest", 1, 10), lambda f: f["size"]).alias("largest_file_bytes"),
        F.lit(include_paths).alias("paths_included"),
        F.coalesce("coverage_complete", F.lit(False)).alias("coverage_complete"),
        listed.scalar().alias("extensions"), "allocated_bytes", "unique_bytes",
    ]
    if include_paths:
        def named(column: str, n: int):
            return F.transform(F.slice(column, 1, n), lambda r: F.struct(
                (r["path"] if path_chars is None else X.truncated(r["path"], path_chars)).alias("path"), r["size"].alias("logical_bytes")))

        columns += [named("largest", 30).alias("largest_files"), named("directories", 20).alias("largest_directories"),
                    F.lit(NOTICE).alias("notice")]
    return summary.select(*columns)
