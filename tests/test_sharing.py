import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from treeledger.ledger import Ledger
from treeledger.operators import digest as D
from treeledger.plans import budget as B
from treeledger.schema import LISTING


def listing(spark, content, folders=()):
    rows = [(p, "f", s, 1, 0, "1", str(i + 1), None) for i, (p, s) in enumerate(sorted(content.items()))]
    rows += [(p, "d", 0, 0, 0, "1", "0", None) for p in folders]
    return spark.createDataFrame(rows, LISTING)


def content_of(ledger, ident):
    return {r["path"]: r["size"] for r in ledger.store.read(ident, "files").collect()}


def sizes_of(ledger, ident):
    return {r["path"]: r["size"] for r in ledger.store.read(ident, "directories").collect()}


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Forty directories of fifty files, in many data files."""
    ledger = Ledger(spark, str(tmp_path_factory.mktemp("wide")))
    content = {f"/r/d{i:02}/f{j}": i + j for i in range(40) for j in range(50)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ledger.scan("base", listing(spark, content, ["/r", "/r/empty"]), "/r", 0.0, finished_at=1.0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return ledger, content


def test_manifest_lists_every_row_once(wide):
    ledger, content = wide
    rows = ledger.store.manifest("base").where("table = 'files'").collect()
    assert len(rows) > 8 and sum(r["rows"] for r in rows) == len(content) and all(r["bytes"] > 0 for r in rows)


def test_refresh_writes_what_its_subtree_touches(wide, spark):
    ledger, content = wide
    for ident, selected, count in (("small", "/r/d07", 1), ("gone", "/r/d20", 0), ("more", "/r/empty", 70)):
        fresh = {f"{selected}/n{j}": 1000 + j for j in range(count)}
        row = ledger.refresh("base", selected, ident, listing(spark, fresh, [selected]), finished_at=2.0)
        want = {p: s for p, s in content.items() if not p.startswith(selected + "/")} | fresh
        assert content_of(ledger, ident) == want
        assert (row["files"], row["bytes"]) == (len(want), sum(want.values()))
        assert (row["refresh"]["reused_files"], row["refresh"]["scanned_files"]) == (len(want) - count, count)
        sizes = {p: sum(s for q, s in want.items() if q.startswith(p + "/")) for p in sizes_of(ledger, ident)}
        assert sizes_of(ledger, ident) == sizes
        files = ledger.store.manifest(ident).where("table = 'files'")
        own = files.where(F.col("file").contains(f"scan_id={ident}/")).agg(F.sum("rows"), F.sum("bytes")).first()
        whole = ledger.store.manifest("base").where("table = 'files'").agg(F.sum("bytes")).first()[0]
        assert files.agg(F.sum("rows")).first()[0] == len(want)
        # At most two data files of the sixteen are touched, and they are written again.
        assert (own[0] or 0) <= count + 2 * 200 and (own[1] or 0) < 0.35 * whole
    again = Ledger(spark, ledger.store.root)
    assert content_of(again, "small") == content_of(ledger, "small")
    assert again.compare("base", "gone").counts().first()["removed"] == 50


def test_digests_find_the_same_changes(wide, spark):
    ledger, _ = wide
    for ident in ("small", "gone", "more"):
        plain, quick = ledger.compare("base", ident), ledger.compare("base", ident, digests=True)
        assert sorted(map(tuple, quick.rows.collect())) == sorted(map(tuple, plain.rows.collect()))
        assert quick.counts().first() == plain.counts().first()
        # One directory differs: the rows that meet in the join are its own, from few data files.
        assert quick.differing.count() == 1
        assert sum(f.count() for f in quick._files) <= 120
        read = ledger.store.read_directories_of("base", "files", quick.differing).inputFiles()
        assert len(read) < len(ledger.store.read("base", "files").inputFiles()) / 3
    same = ledger.compare("base", "small", "/r/d08", digests=True)
    assert same.rows.count() == 0 and not hasattr(same, "differing")


def test_digest_comparison_on_random_trees(spark, tmp_path):
    rng = random.Random(912)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for case in range(3):
        trees = []
        folders = ["/r"] + [f"/r/{a}" for a in "abc"] + [f"/r/{a}/{b}" for a in "abc" for b in "xy"]
        old = {f"{rng.choice(folders)}/f{i}": rng.randrange(5) for i in range(40)}
        new = {p: s + (rng.random() < 0.1) for p, s in old.items() if rng.random() < 0.95}
        new[f"{rng.choice(folders)}/extra"] = 3
        for name, tree in (("old", old), ("new", new)):
            ledger.scan(f"{name}{case}", listing(spark, tree, folders), "/r", 0.0, finished_at=1.0)
        for kind in ("all", "resized", "removed"):
            rows = [ledger.compare(f"old{case}", f"new{case}", kind=kind, digests=d).rows.collect() for d in (False, True)]
            assert sorted(map(tuple, rows[0])) == sorted(map(tuple, rows[1]))
        digests = {r["path"]: r for r in ledger.store.read(f"new{case}", "digests").collect()}
        assert digests["/r"]["all_files"] == len(new) and set(digests) == set(sizes_of(ledger, f"new{case}"))


def test_refreshed_digests_are_those_of_a_scan(wide, spark):
    ledger, _ = wide
    content = content_of(ledger, "small")
    ledger.scan("anew", listing(spark, content, ["/r", "/r/empty", "/r/d07"]), "/r", 0.0, finished_at=3.0)
    rows = [sorted(map(tuple, ledger.store.read(i, "digests").select("path", "own_a", "own_b", "own_files", "all_a", "all_b",
                                                                    "all_files").collect())) for i in ("small", "anew")]
    assert rows[0] == rows[1]


def test_pages_behind_a_path_write_nothing_in_order(wide):
    ledger, _ = wide
    found = ledger.compare("base", "gone")
    page = found.page(limit=3, after="/r/d20/f10")
    rows = [r["path"] for r in page.items.collect()]
    assert found._stored is None
    assert rows == sorted(f"/r/d20/f{j}" for j in range(50) if f"/r/d20/f{j}" > "/r/d20/f10")[:3]
    assert page.meta.first()["total"] == 50 and found._stored is None


def test_one_of_two_racing_writers_is_refused(spark, tmp_path):
    outcome = {}

    def write(name):
        ledger = Ledger(spark, str(tmp_path / "ledger"))
        try:
            ledger.scan("same", listing(spark, {f"/r/{name}{i}": 1 for i in range(20)}), "/r", 0.0)
            outcome[name] = "published"
        except FileExistsError:
            outcome[name] = "refused"

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome.values()) == ["published", "refused"]
    winner = next(n for n, o in outcome.items() if o == "published")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert set(content_of(ledger, "same")) == {f"/r/{winner}{i}" for i in range(20)}
    with pytest.raises(FileExistsError):
        ledger.store.claim("same")


def slow(listing_rows):
    """The same rows, late: every one waits a while in its task."""
    return listing_rows.repartition(4).where(F.expr("java_method('java.lang.Thread', 'sleep', 1500L) IS NULL OR true"))


@pytest.mark.parametrize("how", ["timeout", "cancel"])
def test_a_running_stage_is_stopped(spark, tmp_path, how):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = slow(listing(spark, {f"/r/f{i}": 1 for i in range(400)}))
    stop, started = threading.Event(), time.monotonic()
    options = {"timeout_seconds": 3} if how == "timeout" else {"cancel": stop}
    if how == "cancel":
        threading.Timer(3, stop.set).start()
    with pytest.raises(B.TimedOut if how == "timeout" else B.Cancelled):
        ledger.scan("late", rows, "/r", 0.0, **options)
    assert time.monotonic() - started < 60  # whole, it would take minutes
    assert ledger.scans().count() == 0
    assert spark.range(10).count() == 10  # others' jobs go on
    ledger.discard("late")
    ledger.scan("late", listing(spark, {"/r/x": 1}), "/r", 0.0, timeout_seconds=600)


def test_the_first_reason_is_kept():
    stop = threading.Event()
    budget = B.Budget(0.05, stop)
    time.sleep(0.1)
    assert isinstance(budget.look(), B.TimedOut)
    stop.set()
    assert isinstance(budget.look(), B.TimedOut)
    other = B.Budget(0.05, stop)
    time.sleep(0.1)
    assert isinstance(other.look(), B.Cancelled)
