import hashlib
import os
import random

from tables import as_dicts
from pyspark.sql import functions as F

from treeledger.operators import duplicates as D
from treeledger.plans.duplicates import find_duplicates
from treeledger.sources.content import digest_binary_files, digest_files


def listed(spark, folder):
    """A files table of a small real tree."""
    rows = []
    for base, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(base, name)
            info = os.lstat(path)
            rows.append((path, info.st_size, f"{info.st_dev}:{info.st_ino}:{info.st_size}:{info.st_mtime_ns}",
                         str(info.st_dev), str(info.st_ino)))
    return spark.createDataFrame(rows, "path string, size bigint, fingerprint string, device string, inode string")


def test_equal_content_in_real_files(spark, tmp_path):
    """Two triples of one size, a lone file of that size, empty files and names the built-in reader skips."""
    content = {"north/one": b"amber-07", "north/two": b"basil-07", "south/three": b"amber-07", "four": b"basil-07",
               "south/five": b"cedar-07", ".six": b"amber-07", "_seven": b"basil-07", "void": b"", "south/void": b"", "big": b"x" * 99}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    review = find_duplicates(listed(spark, tmp_path), digest_files)
    want = {hashlib.sha256(data).hexdigest(): {str(tmp_path / n) for n, d in content.items() if d == data}
            for data in (b"amber-07", b"basil-07")}
    assert {r["sha256"]: (r["copies"], r["potential_bytes"]) for r in as_dicts(review.groups)} == dict.fromkeys(want, (3, 16))
    for digest, names in want.items():
        assert {r["path"] for r in review.members.collect() if r["sha256"] == digest} == names
    assert review.meta.first().asDict() == {"complete": True, "errors": 0, "read_bytes": 56, "reason": None, "left_out": 0}
    bounded = find_duplicates(listed(spark, tmp_path), digest_files, max_bytes=50).meta.first()
    assert (bounded["complete"], bounded["left_out"]) == (False, 1)
    visible = {r["path"]: r["sha256"] for r in digest_binary_files(spark, str(tmp_path)).collect()}
    assert visible == {str(tmp_path / n): hashlib.sha256(d).hexdigest() for n, d in content.items() if d and n[0] not in "._"}


def test_files_behind_links_are_never_read(spark, files):
    table = files({"/r/a/x": 5, "/r/b/x": 5, "/r/b/c/x": 5, "/r/d/x": 5})
    links = spark.createDataFrame([("/r/b",)], "path string")
    asked = []

    def digest(rows):
        asked.extend(r["path"] for r in rows.collect())
        return rows.select("path", F.lit("same").alias("sha256"))

    review = find_duplicates(table, digest, links=links, top="/r")
    assert sorted(asked) == ["/r/a/x", "/r/d/x"] and review.meta.first()["errors"] == 2
    assert {r["path"] for r in review.members.collect()} == {"/r/a/x", "/r/d/x"}


def pair_of_files(folder):
    """Two files of equal content."""
    for name in ("left.dat", "right.dat"):
        (folder / name).write_bytes(b"twelve bytes")
    return folder / "right.dat"


def test_changed_file_is_not_trusted(spark, tmp_path):
    second = pair_of_files(tmp_path)
    scanned = listed(spark, tmp_path).cache()
    scanned.count()
    second.write_bytes(b"something else")
    for observed in (None, listed(spark, tmp_path)):
        review = find_duplicates(scanned, digest_files, observed)
        assert review.groups.count() == 0 and review.meta.first()["errors"] == 1


def test_files_without_a_known_time_are_read(spark, tmp_path):
    pair_of_files(tmp_path)
    parts = F.split("fingerprint", ":")
    unknown = F.concat_ws(":", F.lit("?"), F.lit("?"), parts[2], F.lit("?"))
    scanned = listed(spark, tmp_path).withColumn("fingerprint", unknown)
    assert digest_files(scanned).where("sha256 IS NOT NULL").count() == 2
    wrong = scanned.withColumn("fingerprint", F.lit("?:?:1:?"))
    assert digest_files(wrong).where("sha256 IS NOT NULL").count() == 0


def test_tasks_read_about_as_many_bytes(spark, tmp_path):
    sizes = [1000] * 3 + [10] * 300
    for i, size in enumerate(sizes):
        (tmp_path / f"{i:03}").write_bytes(b"x" * size)
    tasks = digest_files(listed(spark, tmp_path), partitions=3).withColumn("task", F.spark_partition_id())
    read = {}
    for row in tasks.collect():
        read[row["task"]] = read.get(row["task"], 0) + sizes[int(row["path"][-3:])]
    assert sum(read.values()) == sum(sizes) and max(read.values()) - min(read.values()) <= 1000


def test_vanished_file_is_an_error(spark, tmp_path):
    second = pair_of_files(tmp_path)
    scanned = listed(spark, tmp_path).cache()
    scanned.count()
    second.unlink()
    assert find_duplicates(scanned, digest_files).meta.first()["errors"] == 1
    assert find_duplicates(scanned, digest_files, listed(spark, tmp_path)).meta.first()["errors"] == 1


def test_class_filter_loses_nothing(spark):
    rows = spark.range(5000).selectExpr("id * 7919 AS size", "repeat('content', 9) AS text")
    classes = rows.where("size % 13 = 0").select("size")
    kept = D.possibly_of_classes(rows, classes)
    assert kept.columns == rows.columns
    sizes = {r["size"] for r in kept.collect()}
    want = {r["size"] for r in classes.collect()}
    assert want <= sizes and len(sizes) < len(want) + 50
    assert D.possibly_of_classes(rows, classes.limit(0)).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "text" in line]


def test_hard_links_are_no_copies(files):
    table = files({"/r/n1": (300, 21, 0), "/r/n2": (300, 21, 0), "/r/n3": (300, 22, 0), "/r/n4": (301, 23, 0), "/r/n5": (301, 23, 0)})
    assert [r["path"] for r in D.duplicate_candidates(table).orderBy("path").collect()] == ["/r/n1", "/r/n3"]


def test_unknown_inodes_are_no_hard_links(files):
    table = files({f"/r/{i}": (40, 0, 0) for i in range(3)} | {f"/r/n{i}": (50, 1, 0) for i in range(3)})
    for unknown in ("0", None):
        some = table.withColumn("inode", F.when(F.col("size") == 50, F.lit("1")).otherwise(F.lit(unknown)))
        assert D.duplicate_candidates(some).count() == 3
        assert D.candidate_bytes(some).collect()[0]["bytes"] == 120


def test_budget_equals_plain_running_total(spark):
    rng = random.Random(5)
    sizes = {rng.randrange(1, 2**30) for _ in range(300)} | set(range(1, 400)) | {2**30, 2**15, 2**15 - 1}
    classes = spark.createDataFrame([(s, s * rng.randrange(2, 9)) for s in sizes], "size bigint, bytes bigint")
    costs = {r["size"]: r["bytes"] for r in classes.collect()}
    for budget in (0, 1, 500, 10**6, 10**11, 10**13):
        total, expected = 0, {}
        for size in sorted(costs):
            total += costs[size]
            if total <= budget:
                expected[size] = total
        got = {r["size"]: r["read_bytes"] for r in D.within_budget(classes, budget).collect()}
        assert got == expected


def test_budget_keeps_whole_classes_only(spark, files):
    table = files({"/r/a": 2, "/r/b": 2, "/r/c": 3, "/r/d": 3})

    def digest(rows):
        return rows.select("path", F.lit("x").alias("sha256"))

    review = find_duplicates(table, digest, budget=9)
    assert [r["size"] for r in review.groups.collect()] == [2]
    assert review.meta.first().asDict() == {"complete": False, "errors": 0, "read_bytes": 4,
                                            "reason": "read budget reached", "left_out": 0}
    assert find_duplicates(table, digest, budget=10).groups.count() == 2
    assert find_duplicates(table, digest, budget=None).meta.first()["complete"] is True


def test_huge_group_has_a_row_per_path(spark):
    hashed = spark.range(3000).select(
        F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path"), F.lit(7).cast("bigint").alias("size"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sha256"))
    assert D.duplicate_members(hashed).count() == 1000
    assert D.duplicate_groups(hashed).first()["potential_bytes"] == 999 * 7
