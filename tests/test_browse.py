import pytest
from tables import as_dicts
from pyspark.sql import functions as F

from treeledger.operators import browse as B
from treeledger.operators import rollup as R
from treeledger.operators.paging import ordered_slice, placed, placed_slice


@pytest.fixture
def tree(spark, files):
    table = files({"/r/b.txt": (10, 1, 50), "/r/A.txt": (10, 2, 70), "/r/sub/c.bin": (30, 3, 60),
                   "/r/sub/deep/d": (0, 4, 10), "/r/z%_.txt": (1, 5, 20)})
    table = table.withColumn("allocated", F.when(F.col("name") != "A.txt", F.col("allocated")))
    sizes = R.directory_totals(R.direct_bytes(table), "/r")
    return table, R.describe_directories(sizes)


def names(page):
    return [r["name"] for r in page.items.collect()]


def test_children_in_one_order(tree):
    page = B.browse(*tree, "/r")
    assert names(page) == ["sub", "A.txt", "b.txt", "z%_.txt"]
    assert as_dicts(page.items)[0] == {"path": "/r/sub", "name": "sub", "size": 30, "allocated": None,
                                       "extension": "", "modified": None, "kind": "directory"}
    assert page.meta.first().asDict() == {
        "total": 4, "offset": 0, "limit": 100, "has_more": False, "size": 51, "path": "/r", "parent": None,
        "page": 1, "pages": 1}
    assert B.browse(*tree, "/r", "/r/sub").meta.first()["parent"] == "/r"


def test_sorts(tree):
    assert names(B.browse(*tree, "/r", sort="name")) == ["A.txt", "b.txt", "sub", "z%_.txt"]
    assert names(B.browse(*tree, "/r", sort="modified")) == ["A.txt", "b.txt", "z%_.txt", "sub"]
    assert names(B.browse(*tree, "/r", sort="allocated"))[2:] == ["A.txt", "sub"]
    with pytest.raises(ValueError):
        B.browse(*tree, "/r", sort="size; drop")


def test_search(tree):
    assert names(B.browse(*tree, "/r", query="%_")) == ["z%_.txt"]
    assert names(B.browse(*tree, "/r", query="SUB")) == ["sub"]
    found = B.browse(*tree, "/r", "/r/sub", query="r/A", recursive=True)
    assert names(found) == ["A.txt"]
    everything = B.browse(*tree, "/r", "/r/sub", recursive=True)
    assert everything.meta.first()["total"] == 5 and names(everything)[0] == "c.bin"


def test_volume_root_is_not_its_own_child(files):
    table = files({"/a": 1, "/d/b": 2})
    folders = R.describe_directories(R.directory_totals(R.direct_bytes(table), "/"))
    page = B.browse(table, folders, "/")
    assert names(page) == ["d", "a"] and page.meta.first()["size"] == 3


@pytest.mark.parametrize("sort", ["size", "allocated", "name", "modified"])
def test_pages_and_continuation_cover_everything_once(tree, sort):
    whole = [r["path"] for r in B.browse(*tree, "/r", sort=sort).items.collect()]
    by_offset, by_row, last = [], [], None
    for i in range(len(whole)):
        by_offset += [r["path"] for r in B.browse(*tree, "/r", sort=sort, offset=i, limit=1).items.collect()]
        row = B.browse(*tree, "/r", sort=sort, after=last, limit=1).items.first()
        by_row.append(row["path"])
        last = row.asDict()
    assert by_offset == whole and by_row == whole
    assert B.browse(*tree, "/r", sort=sort, after=last).items.count() == 0


def test_slices_and_jumps_into_placed_rows_agree(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("size"), F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path"))
    order = [F.desc("size"), F.asc("path")]
    whole = [r["path"] for r in df.orderBy(*order).collect()]
    stored = placed(df.repartition(5), order)
    for offset, limit in ((0, 5), (1234, 300), (4990, 100), (6000, 5), (0, 6000)):
        for rows in (ordered_slice(df, order, offset, limit), placed_slice(stored, offset, limit)):
            assert [r["path"] for r in rows.collect()] == whole[offset:offset + limit]
    assert placed_slice(placed(df.limit(0), order), 0, 5).count() == 0


def test_area_map(spark):
    items = spark.createDataFrame([(f"/{i}", str(i), "file", i) for i in range(30)],
                                  "path string, name string, kind string, size bigint")
    rows = B.area_map(items).collect()
    assert len(rows) == 24 and min(r["size"] for r in rows) == 6
    assert abs(sum(r["share"] for r in rows) - 100) < 1e-9
    assert B.area_map(items.where("size = 0")).count() == 0


def test_error_page(spark):
    errors = spark.createDataFrame([(f"/{i:03}", "no") for i in range(130)], "path string, reason string")
    page = B.error_page(errors, 100)
    assert [r["path"] for r in page.items.collect()] == [f"/{i:03}" for i in range(100, 130)]
    assert page.meta.first()["total"] == 130
