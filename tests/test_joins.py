from pyspark.sql import functions as F

from treeledger.operators.joins import heavy_keys, lookup_join, only_paths, path_join


def test_heavy_keys_are_cut_and_results_stay_whole(spark):
    """A third of all rows under one key: same result, several tasks."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = rows.where("k % 2 <> 0").select("k").distinct().withColumn("w", F.col("k") * 10)
    expected = sorted(map(tuple, rows.join(lookup, "k").select("k", "v", "w").collect()))
    spread = lookup_join(rows, lookup, ["k"], "inner", ["v"], slices=8, at_least=100)
    assert sorted(map(tuple, spread.select("k", "v", "w").collect())) == expected
    for how in ("left_semi", "left_anti"):
        got = lookup_join(rows, lookup, ["k"], how, ["v"], slices=8, at_least=100)
        want = rows.join(lookup, "k", how)
        assert sorted(r["v"] for r in got.collect()) == sorted(r["v"] for r in want.collect())
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy_keys(counts, ["k"], slices=8, at_least=100).collect()
    assert [(r["k"], r["_slices"]) for r in heavy] == [(-1, 3)]


def test_nothing_is_heavy_in_small_data(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    assert heavy_keys(rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")), ["k"]).count() == 0


def test_path_join_keeps_outer_rows(spark):
    a = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, x int")
    b = spark.createDataFrame([("/b", 3), ("/c", 4)], "path string, y int")
    rows = {r["path"]: (r["x"], r["y"]) for r in path_join(a, b, "full_outer").collect()}
    assert rows == {"/a": (1, None), "/b": (2, 3), "/c": (None, 4)}


def test_only_paths(spark):
    table = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    some = spark.createDataFrame([("/a", "/c"), (None, "/c")], "s string, d string")
    assert sorted(r["path"] for r in only_paths(table, some.select("s"), some.select("d")).collect()) == ["/a", "/c"]


def test_marked_rows_read_their_table_once_more(spark, tmp_path):
    """Behind the marking of parents, the rows themselves are scanned once."""
    from treeledger.operators.links import rows_by_marked_parent
    rows = [(f"/r/{i % 7}/{i}", f"/r/{i % 7}") for i in range(100)]
    spark.createDataFrame(rows, "path string, parent string").write.parquet(f"{tmp_path}/rows")
    marks = spark.createDataFrame([("/r/3",), ("/r/5",)], "path string")
    clear = rows_by_marked_parent(spark.read.parquet(f"{tmp_path}/rows"), marks, "/r", "left_anti")
    assert {r["path"] for r in clear.collect()} == {p for p, parent in rows if parent not in ("/r/3", "/r/5")}
    plan = clear._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [path") == 1
