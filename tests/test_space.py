from tables import as_dicts
from pyspark.sql import functions as F

from treeledger.functions.paths import WINDOWS
from treeledger.operators import rollup as R
from treeledger.sources import ingest as I

LISTING = "path string, kind string, size bigint, blocks bigint, mtime_ns bigint, device string, inode string, error string"


def listing(spark, rows):
    return spark.createDataFrame([(p, k, s, 8, 5_000_000_000, "1", str(i), e)
                                  for i, (p, k, s, e) in enumerate(rows)], LISTING)


def test_rollup_literal(spark):
    direct = spark.createDataFrame([("/", 5), ("/nested", 10), ("/nested/deeper", 20)], "path string, size bigint")
    totals = {r["path"]: r["size"] for r in R.directory_totals(direct, "/").collect()}
    assert totals == {"/": 35, "/nested": 30, "/nested/deeper": 20}


def test_rollup_keeps_empty_directories(spark):
    direct = spark.createDataFrame([("/r/a/b", 7)], "path string, size bigint")
    known = spark.createDataFrame([("/r",), ("/r/a",), ("/r/empty",)], "path string")
    totals = {r["path"]: r["size"] for r in R.directory_totals(direct, "/r", known).collect()}
    assert totals == {"/r": 7, "/r/a": 7, "/r/a/b": 7, "/r/empty": 0}


def test_rollup_windows(spark):
    direct = spark.createDataFrame([("C:\\x\\y", 4), ("C:\\", 1)], "path string, size bigint")
    totals = {r["path"]: r["size"] for r in R.directory_totals(direct, "C:\\", rules=WINDOWS).collect()}
    assert totals == {"C:\\": 5, "C:\\x": 4, "C:\\x\\y": 4}


def test_hard_links_count_once(spark, files):
    table = files({"/r/first.bin": (8192, 1, 0), "/r/second.bin": (8192, 1, 0)})
    assert R.file_totals(table).first().asDict() == {"files": 2, "bytes": 16384}
    assert R.identity_sizes(table).first()["unique_bytes"] == 8192
    assert R.identities(table).count() == 1


def test_allocation_failures_count_identities(spark, files):
    table = files({"/r/a": (1, 1, 0), "/r/b": (1, 1, 0), "/r/c": (1, 2, 0)})
    table = table.withColumn("allocated", F.when(F.col("path") == "/r/a", 512))
    assert R.identity_sizes(table).first().asDict() == {"unique_bytes": 2, "allocated_bytes": 512, "allocation_errors": 1}


def test_ingest_rules(spark):
    rows = listing(spark, [
        ("/r", "d", 0, None), ("/r/a.TXT", "f", 10, None), ("/r/d", "d", 0, None), ("/r/link", "l", 0, None),
        ("/r/pipe", "p", 0, None), ("/r/d/.quarantine", "d", 0, None), ("/r/d/.quarantine/x", "f", 9, None),
        ("/r/d/.quarantine/.quarantine", "d", 0, None), ("/r/skip", "d", 0, None), ("/r/skip/y", "f", 9, None),
        ("/r/skip/link", "l", 0, None), ("/r/skip-not", "f", 1, None), ("/r/denied", "d", 0, "no " * 400),
        ("/other/z", "f", 5, None)])
    found = I.ingest(rows, "/r", exclude_paths=["/r/./skip"])
    assert {r["path"]: r["size"] for r in found.files.collect()} == {"/r/a.TXT": 10, "/r/skip-not": 1}
    assert {r["path"] for r in found.directories.collect()} == {"/r", "/r/d", "/r/denied"}
    assert found.counts.first().asDict() == {"files": 2, "bytes": 11, "errors": 1, "skipped": 3}
    errors = found.errors.collect()
    assert [e["path"] for e in errors] == ["/r/denied"] and errors[0]["reason"] == "no " * 400
    row = next(r for r in as_dicts(found.files) if r["path"] == "/r/a.TXT")
    assert row["extension"] == ".txt" and row["parent"] == "/r" and row["allocated"] == 4096
    assert row["fingerprint"] == "1:1:10:5000000000" and row["modified"] == 5.0


def test_quarantine_above_the_root_is_not_skipped(spark):
    rows = listing(spark, [("/q/.quarantine/r/a", "f", 3, None)])
    assert I.ingest(rows, "/q/.quarantine/r").counts.first()["files"] == 1


def test_followed_links_are_dropped(spark):
    rows = listing(spark, [("/r/link", "l", 0, None), ("/r/link/deep/a", "f", 3, None), ("/r/link2/b", "f", 4, None),
                           ("/r/link/inner", "l", 0, None)])
    found = I.ingest(rows, "/r", links_followed=True)
    assert [r["path"] for r in found.files.collect()] == ["/r/link2/b"]
    assert found.counts.first()["skipped"] == 1


def test_scan_limits(spark, files):
    table = files({f"/r/{i:02}.txt": 10 for i in range(20)})
    folders = spark.createDataFrame([("/r",)], "path string")
    kept, _, state = I.limit_scan(table, folders, max_files=5)
    assert R.file_totals(kept).first()["bytes"] == 50 and state.first()["complete"] is False
    kept, _, state = I.limit_scan(table, folders, max_files=20, max_dirs=1)
    assert kept.count() == 20 and state.first()["complete"] is True


def test_many_files_are_all_kept(spark):
    rows = spark.range(50_005).select(
        F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("path"), F.lit("f").alias("kind"),
        F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("blocks"),
        F.lit(0).cast("bigint").alias("mtime_ns"), F.lit("1").alias("device"), F.col("id").cast("string").alias("inode"))
    assert I.ingest(rows, "/r").counts.first()["files"] == 50_005
