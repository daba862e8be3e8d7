"""The shape of the physical plans that scale depends on."""

import re

import pytest
from pyspark.sql import functions as F

from treeledger.ledger import Ledger
from treeledger.operators import browse as B
from treeledger.operators import cleanup as K
from treeledger.operators import compare as C
from treeledger.operators import rollup as R
from treeledger.operators import scope_changes as S
from treeledger.schema import FILES


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An inventory in Parquet, large enough by estimate not to be broadcast."""
    folder = str(tmp_path_factory.mktemp("plans") / "files")
    path = F.concat(F.lit("/r/d"), (F.col("id") % 9).cast("string"), F.lit("/f"), F.col("id").cast("string"))
    rows = spark.range(2000).select(path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("parent"),
                                    F.lit("f").alias("name"), F.col("id").alias("size"), F.lit("1").alias("device"),
                                    F.col("id").cast("string").alias("inode"), F.lit(".tmp").alias("extension"),
                                    F.lit(0.0).alias("modified"))
    for field in FILES.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    rows.select(*FILES.fieldNames()).write.parquet(folder)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark.read.schema(FILES).parquet(folder)
    for key in settings:
        spark.conf.unset(key)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (hash|range|single)", text, re.I))


def test_comparison_reads_two_columns_filters_both_sides_and_shuffles_once_each(stored):
    text = plan(C.changes(stored, stored.withColumn("size", F.col("size") + 1), "/r/d1"))
    assert text.count("StringStartsWith(path,/r/d1/)") == 2
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<path:string,size:bigint>"}
    assert exchanges(text) == 2 and "FullOuter" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_single_kinds_use_narrower_joins(stored):
    assert "LeftAnti" in plan(C.changes(stored, stored, kind="removed"))
    assert "LeftAnti" in plan(C.changes(stored, stored, kind="added"))
    assert "Inner" in plan(C.changes(stored, stored.withColumn("size", F.col("size") + 1), kind="resized"))


def test_rankings_and_pages_are_bounded(stored):
    text = plan(R.largest_files(stored))
    assert "TakeOrderedAndProject" in text and "struct<path:string,size:bigint>" in text
    folders = R.describe_directories(R.directory_totals(R.direct_bytes(stored), "/r"))
    text = plan(B.browse(stored, folders, "/r", "/r/d3", offset=200, limit=100).items)
    assert "TakeOrderedAndProject(limit=300" in text and "EqualTo(parent,/r/d3)" in text


def test_rollup_combines_before_both_shuffles_and_joins_nothing(stored):
    known = stored.select(F.col("parent").alias("path")).distinct()
    text = plan(R.directory_totals(R.direct_bytes(stored), "/r", known))
    assert "Join" not in text and "partial_sum" in text
    assert exchanges(text) == 3  # files by parent, registered by path, all by ancestor


def test_cleanup_filters_reach_the_scan(stored):
    text = plan(K.eligible(stored, 1e9, ["/r/d1", "/r/d2"], "/r"))
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", text).group(1)
    assert "In(extension" in pushed and "LessThanOrEqual(modified" in pushed and "StringStartsWith(path,/r/d2/)" in pushed
    assert exchanges(text) == 0


def test_no_python_in_any_plan(stored):
    for df in (C.change_counts(C.changes(stored, stored)), R.by_extension(stored), R.identity_sizes(stored)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_bucketed_snapshots_compare_without_a_shuffle(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.range(500).select(
        F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("path"), F.lit("f").alias("kind"),
        F.col("id").alias("size"), F.lit(1).cast("bigint").alias("blocks"), F.lit(0).cast("bigint").alias("mtime_ns"),
        F.lit("1").alias("device"), F.col("id").cast("string").alias("inode"))
    ledger.scan("one", rows.where("size <> 7"), "/r", 0)
    ledger.scan("two", rows.where("size <> 9").withColumn("size", F.col("size") * 2), "/r", 0)
    names = ["bucketed_one", "bucketed_two"]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = ledger.store.bucket("one", names[0], 4), ledger.store.bucket("two", names[1], 4)
        changed = C.changes(old, new, colocated=True)
        assert exchanges(plan(changed)) == 0
        counts = C.change_counts(changed).first()
        assert (counts["added"], counts["removed"], counts["resized"]) == (1, 1, 497)
        assert exchanges(plan(S.classify(old, new, "/r", colocated=True))) == 0
        found = ledger.compare("one", "two", bucketed=tuple(names))
        assert exchanges(plan(found._rows)) == 0 and found.counts().first()["total"] == 499
        assert [r["path"] for r in found.page(498, 5).items.collect()] == [r["path"] for r in found.rows.collect()][498:]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
