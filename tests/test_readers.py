import json
import os
import random

import pytest
from pyspark.sql import functions as F

from treeledger.ledger import Ledger
from treeledger.operators.paging import indexed_slice, write_index
from treeledger.sources.readers import FIND_FORMAT, UNREADABLE, read_find_listing, read_inventory


def test_find_listing(spark, tmp_path):
    assert FIND_FORMAT.endswith("%p\\0")
    names = ["/r/a", "/r/tab\there", "/r/line\nbreak", "/r/é 日本", "/r/=x"]
    records = [f"f\t{i}\t{8 * i}\t1704067200.{i}234567890\t7\t{90 + i}\t{n}" for i, n in enumerate(names)]
    records += ["d\t4096\t8\t0.0000000000\t7\t1\t/r", "l\t3\t0\t-5.5000000000\t7\t2\t/r/link", "s\t0\t\t\t\t\t/r/socket"]
    bad = ["f\t12\t8", "f\tmany\t8\t0\t7\t1\t/r/bad", "", "f\t1\t8\t0\t7\t1\t"]
    (tmp_path / "listing").write_bytes("".join(r + "\0" for r in records + bad[:3] + bad[3:]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # records run across the splits
    try:
        rows = read_find_listing(spark, str(tmp_path / "listing")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = {r["path"]: r for r in rows if r["error"] is None}
    assert set(good) == {*names, "/r", "/r/link", "/r/socket"}
    assert (good["/r/line\nbreak"]["size"], good["/r/line\nbreak"]["blocks"], good["/r/line\nbreak"]["mtime_ns"]) == (2, 16, 1704067200223456789)
    assert good["/r/link"]["mtime_ns"] == -5_500_000_000 and good["/r/socket"]["inode"] is None
    assert sorted(r["path"] for r in rows if r["error"] == UNREADABLE) == sorted(bad)


def test_inventory_with_a_manifest(spark, tmp_path):
    os.makedirs(tmp_path / "data")
    (tmp_path / "data/one.csv").write_text('"b","dir/","0","2024-01-01T00:00:00.000Z"\n"b","dir/a%20%C3%A9","5","2024-01-01T00:00:01.000Z"\n')
    (tmp_path / "data/two.csv").write_text('"b","dir/q%22","x","2024-01-01T00:00:00.000Z"\n"b","cut"\n"b","dir/b+c","7",""\n')
    about = {"fileFormat": "CSV", "fileSchema": "Bucket, Key, Size, LastModifiedDate", "files": [{"key": "data/one.csv"}, {"key": "data/two.csv"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(about, indent=1))
    rows = read_inventory(spark, str(tmp_path / "manifest.json"), str(tmp_path)).collect()
    good = {r["path"]: (r["kind"], r["size"], r["mtime_ns"]) for r in rows if r["error"] is None}
    assert good == {"/b/dir": ("d", 0, 1704067200 * 10**9), "/b/dir/a é": ("f", 5, 1704067201 * 10**9), "/b/dir/b c": ("f", 7, None)}
    assert len(rows) == 5 and all(r["error"] in (None, UNREADABLE) for r in rows)
    (tmp_path / "manifest.json").write_text(json.dumps(about | {"fileFormat": "ORC"}))
    with pytest.raises(ValueError):
        read_inventory(spark, str(tmp_path / "manifest.json"), str(tmp_path))


def test_an_index_reads_one_data_file(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"/p{i}", rng.randrange(50)) for i in range(4000)], "path string, size long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        write_index(rows, [F.desc("size"), F.asc("path")], str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(((r["path"], r["size"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    for offset, limit in ((0, 10), (399, 5), (2000, 1), (3960, 100), (3999, 1), (4000, 5), (0, 4000)):
        page = indexed_slice(spark, str(tmp_path / "index"), offset, limit)
        assert [tuple(r) for r in page.collect()] == want[offset:offset + limit]
        if 0 < limit <= 100:
            assert len(page.inputFiles()) <= 2
    last = indexed_slice(spark, str(tmp_path / "index"), 3960, 30)
    read = spark.read.parquet(*last.inputFiles()).count()
    assert read < 1200  # of 4000


def test_stored_pages_use_it(spark, tmp_path):
    from pyspark.sql import Row
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    listing = spark.range(300).select(F.concat(F.lit("/r/F"), "id").alias("path"), F.lit("f").alias("kind"), (F.col("id") % 7).alias("size"),
                                      F.lit(1).cast("bigint").alias("blocks"), F.lit(0).cast("bigint").alias("mtime_ns"),
                                      F.lit("1").alias("device"), F.col("id").cast("string").alias("inode"))
    ledger.scan("s", listing, "/r", 0.0)
    before = {sort: ledger.browse("s", recursive=True, sort=sort, offset=250).items.collect() for sort in ("size", "name", "allocated", "modified")}
    ledger.index_pages("s")
    for sort, rows in before.items():
        page = ledger.browse("s", recursive=True, sort=sort, offset=250)
        assert page.items.collect() == rows and isinstance(rows[0], Row)
        assert all("/pages/" in name for name in page.items.inputFiles())
        assert page.meta.first()["total"] == 300
