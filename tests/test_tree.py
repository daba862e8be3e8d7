import random

from pyspark.sql import functions as F

from treeledger.functions.paths import WINDOWS
from treeledger.operators import rollup as R
from treeledger.operators import tree as T


def random_tree(rng, files=300, sep="/"):
    folders = ["/r"]
    for _ in range(40):
        folders.append(rng.choice(folders) + sep + rng.choice(["a", "a-b", "a b", "B", "é", "z", "x.y", "\x02"]) + str(rng.randrange(3)))
    return sorted(set(folders)), {f"{rng.choice(folders)}{sep}f{rng.choice('-./ é')}{i}".replace("./", "."): rng.randrange(90)
                                  for i in range(files)}


def walk(folder, folders, files):
    """A depth-first walk over entries by name."""
    prefix = folder + "/"
    entries = [p for p in [*folders, *files] if p.startswith(prefix) and "/" not in p[len(prefix):]]
    for path in sorted(entries, key=lambda p: p.encode()):
        if path in files:
            yield path
        else:
            yield from walk(path, folders, files)


def tables(spark, folders, files):
    rows = spark.createDataFrame([(p, p.rsplit("/", 1)[0], s) for p, s in files.items()], "path string, parent string, size bigint")
    return rows, spark.createDataFrame([(p,) for p in folders], "path string")


def test_places_follow_a_walk(spark):
    for seed in range(3):
        folders, files = random_tree(random.Random(seed))
        files = {p: s for p, s in files.items() if p.rsplit("/", 1)[0] in set(folders)}
        rows, _ = tables(spark, folders, files)
        want = list(walk("/r", folders, files))
        assert len(want) == len(files)
        got = sorted((r["place"], r["path"]) for r in T.depth_first(rows.repartition(3)).collect())
        assert got == list(enumerate(want))
        assert sorted(r["path"] for r in T.limit_traversal(rows, 17).collect()) == sorted(want[:17])


def test_intervals_add_up_like_the_rollup(spark):
    for seed in range(3):
        folders, files = random_tree(random.Random(10 + seed))
        rows, registered = tables(spark, folders, files)
        known = registered.unionByName(R.directory_totals(R.direct_bytes(rows), "/r").select("path")).distinct()
        want = {r["path"]: r["size"] for r in R.directory_totals(R.direct_bytes(rows), "/r", known).collect()}
        spans = {r["path"]: r for r in T.directory_intervals(R.direct_bytes(rows), "/r", known).collect()}
        assert {p: r["size"] for p, r in spans.items()} == want
        assert sorted(r["first"] for r in spans.values()) == list(range(len(spans)))
        for p, r in spans.items():
            below = [q for q, other in spans.items() if r["first"] <= other["first"] <= r["last"]]
            assert sorted(below) == sorted(q for q in spans if q == p or q.startswith(p + "/"))


def test_volume_root_and_windows(spark):
    rows = spark.createDataFrame([("/", 5), ("/nested", 10), ("/nested/deeper", 20)], "path string, size bigint")
    assert {r["path"]: r["size"] for r in T.directory_intervals(rows, "/").collect()} == {"/": 35, "/nested": 30, "/nested/deeper": 20}
    rows = spark.createDataFrame([("C:\\", 5), ("C:\\a", 10), ("C:\\a-b", 1), ("C:\\a\\x", 20)], "path string, size bigint")
    got = {r["path"]: r["size"] for r in T.directory_intervals(rows, "C:\\", None, WINDOWS).collect()}
    assert got == {"C:\\": 36, "C:\\a": 30, "C:\\a-b": 1, "C:\\a\\x": 20}


def test_sweep_against_prefixes(spark):
    for seed in range(3):
        rng = random.Random(20 + seed)
        folders, files = random_tree(rng)
        rows, registered = tables(spark, folders, files)
        marks = rng.sample(folders, 5) + ["/r/nowhere", "/elsewhere"] + rng.sample(sorted(files), 2)
        table = spark.createDataFrame([(m,) for m in marks + marks[:2]], "path string")
        under = [p for p in files if any(p.startswith(m + "/") for m in marks)]
        assert sorted(r["path"] for r in T.rows_under(rows, table, "left_semi").collect()) == sorted(under)
        assert sorted(r["path"] for r in T.rows_under(rows, table, "left_anti").collect()) == sorted(set(files) - set(under))
        inside = [p for p in folders if any(p == m or p.startswith(m + "/") for m in marks)]
        assert sorted(r["path"] for r in T.marked(registered, table).collect()) == sorted(inside)
    none = table.limit(0)
    assert T.rows_under(rows, none, "left_semi").count() == 0 and T.rows_under(rows, none, "left_anti").count() == len(files)


def test_a_hundred_thousand_roots(spark):
    """Every root holds three files at some depth; the sweep makes no row per ancestor and root."""
    ids = spark.range(100_000)
    roots = ids.where("id % 2 = 0").select(F.concat(F.lit("/r/d"), "id").alias("path"))
    roots = roots.unionByName(ids.where("id % 4 = 0").select(F.concat(F.lit("/r/d"), "id", F.lit("/e")).alias("path")))
    parents = ids.select(F.explode(F.array(*[F.concat(F.lit("/r/d"), "id", F.lit(tail)) for tail in ("", "/e", "/e/g")])).alias("parent"))
    files = parents.withColumn("path", F.concat("parent", F.lit("/f")))
    assert T.rows_under(files, roots, "left_semi").count() == 150_000
