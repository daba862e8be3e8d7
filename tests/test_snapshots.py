import csv
import glob
import io
import json
import random
import types

import pytest
from pyspark.sql import functions as F

from treeledger.ledger import Ledger
from treeledger.operators import journal as J
from treeledger.operators import rollup as R
from treeledger.plans import refresh as N
from treeledger.plans.comparison import ComparisonError, ScopeNotFound
from treeledger.schema import LISTING, MOVES
from treeledger.sources.store import SnapshotMissing, default_pair, repair_directories, repair_summary

NOW = 1_000_000_000


def listing(spark, content, folders=()):
    """content: {path: size or (size, inode)}; paths are listed in the given order."""
    rows = [(path, "d", 0, 0, 0, "1", "0", None) for path in folders]
    for i, (path, fact) in enumerate(content.items()):
        size, inode = fact if isinstance(fact, tuple) else (fact, i + 1)
        rows.append((path, "f", size, 8, 5, "1", str(inode), None))
    return spark.createDataFrame(rows, LISTING)


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    """before and after as in the worked comparison, plus a partial scan and another root."""
    made = Ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    folders = ["/r/folder", "/r/folder2"]
    before = {"/r/folder/resize.txt": (3, 1), "/r/removed.txt": (5, 2), "/r/unchanged.tmp": (4, 3)}
    after = {"/r/folder/resize.txt": (8, 1), "/r/folder2/added.txt": (2, 9), "/r/unchanged.tmp": (4, 3),
             "/r/=danger,\n.txt": (0, 10)}
    made.scan("before", listing(spark, before, folders), "/r", NOW, temp_roots=["/r"], finished_at=1.0)
    made.scan("after", listing(spark, after, folders), "/r/", NOW, finished_at=3.0)
    made.scan("partial", listing(spark, before, folders), "/r", NOW, max_files=1, finished_at=2.0)
    made.scan("other", listing(spark, {"/elsewhere/x": 1}), "/elsewhere", NOW, finished_at=0.5)
    return made


def test_summary(ledger):
    row = ledger.summary("before")
    assert (row["root"], row["files"], row["bytes"], row["complete"], row["coverage_complete"]) == ("/r", 3, 12, True, True)
    assert row["directories"] == [{"path": "/r", "size": 12}, {"path": "/r/folder", "size": 3}, {"path": "/r/folder2", "size": 0}]
    assert [r["path"] for r in row["largest"]] == ["/r/removed.txt", "/r/unchanged.tmp", "/r/folder/resize.txt"]
    assert [tuple(r) for r in ledger.extensions("before").collect()] == [(".txt", 2, 8), (".tmp", 1, 4)]
    assert [c["path"] for c in ledger.candidates("before").collect()] == ["/r/unchanged.tmp"]
    assert (row["candidate_files"], row["candidate_bytes"]) == (1, 4)
    assert row["unique_bytes"] == 12 and row["allocated_bytes"] == 3 * 4096 and row["refresh"] is None
    partial = ledger.summary("partial")
    assert partial["complete"] is False and partial["coverage_complete"] is False and partial["files"] == 1


def test_catalog_and_default_pair(ledger):
    assert [(r["id"], r["state"]) for r in ledger.scans().collect()] == [
        ("after", "completed"), ("partial", "partial"), ("before", "completed"), ("other", "completed")]
    assert ledger.default_pair().first().asDict() == {"baseline": "partial", "current": "after"}
    one = ledger.scans().where("id = 'before'")
    assert default_pair(one).first().asDict() == {"baseline": "before", "current": "before"}


def test_nothing_is_overwritten(ledger, spark):
    before = ledger.summary("before")
    with pytest.raises(FileExistsError):
        ledger.scan("before", listing(spark, {"/r/x": 1}), "/r", NOW)
    assert ledger.summary("before") == before
    with pytest.raises(ValueError):
        ledger.scan("../escape", listing(spark, {"/r/x": 1}), "/r", NOW)


def test_unfinished_snapshots_do_not_exist(ledger, spark):
    files = ledger.store.read("before", "files")
    ledger.store.write_table("unfinished", "files", files)
    with pytest.raises(SnapshotMissing):
        ledger.store.read("unfinished", "files")
    with pytest.raises(ComparisonError):
        ledger.compare("before", "unfinished")
    assert "unfinished" not in {r["id"] for r in ledger.scans().collect()}


def test_browse(ledger):
    page = ledger.browse("before")
    assert [r["name"] for r in page.items.collect()] == ["removed.txt", "unchanged.tmp", "folder", "folder2"]
    with pytest.raises(KeyError):
        ledger.browse("before", "/r/nowhere")


def test_comparison(ledger):
    found = ledger.compare("before", "after")
    assert found.counts().first().asDict() == {"added": 2, "removed": 1, "resized": 1, "total": 4, "delta_bytes": 2}
    assert found.coverage_complete and not found.warnings
    first, second = found.page(0, 1), found.page(1, 1)
    assert first.meta.first()["has_more"] is True
    assert first.items.first()["path"] < second.items.first()["path"]
    assert found.page(999).items.count() == 0
    for other in (found, ledger.compare("before", "after")):
        for rows in (2, 100):
            far = other.last_page(rows)
            assert [r["path"] for r in far.items.collect()] == [r["path"] for r in found.rows.collect()][-rows:]
            meta = far.meta.first()
            assert meta["total"] == 4 and meta["offset"] == max(0, 4 - rows) and not meta["has_more"]
    with pytest.raises(ComparisonError):
        found.last_page(0)
    assert ledger.compare("before", "after", "/r/folder").counts().first()["total"] == 1
    partial = ledger.compare("before", "partial")
    assert not partial.coverage_complete and partial.warnings and partial.current["complete"] is False


@pytest.mark.parametrize("arguments, error", [
    (("before", "unknown"), ComparisonError), (("before", "other"), ComparisonError),
    (("before", "after", "/"), ComparisonError), (("before", "after", "/r/nowhere"), ScopeNotFound),
    (("before", "after", "", "", "SQL"), ComparisonError)])
def test_refused_comparisons(ledger, arguments, error):
    with pytest.raises(error):
        ledger.compare(*arguments)


def read_csv(folder):
    parts = sorted(glob.glob(folder + "/part-*"))
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in parts)
    assert text.startswith("\ufeff") and text.count("\ufeff") == 1
    return list(csv.reader(io.StringIO(text[1:], newline="")))


def test_csv_exports(ledger, tmp_path):
    ledger.export_inventory("after", str(tmp_path / "files"))
    rows = read_csv(str(tmp_path / "files"))
    assert rows[0] == ["path", "logical_bytes", "allocated_bytes", "modified_epoch", "extension"]
    assert [r[0] for r in rows[1:]] == sorted(r[0] for r in rows[1:]) and len(rows) == 5
    assert rows[1] == ["/r/=danger,\n.txt", "0", "4096", "5e-09".replace("5e-09", "0.000000005"), ".txt"]
    ledger.export_comparison(ledger.compare("before", "after", kind="added"), str(tmp_path / "changes"))
    rows = read_csv(str(tmp_path / "changes"))
    assert rows[0][-2:] == ["baseline_coverage_complete", "current_coverage_complete"]
    assert [r[1:] for r in rows[1:]] == [["added", "", "0", "0", "True", "True"], ["added", "", "2", "2", "True", "True"]]


def test_reports(ledger):
    parts = [(r["part"], json.loads(r["report"])) for r in ledger.report("before").collect()]
    value = dict(parts)["summary"]
    assert value["bytes"] == 12 and value["refresh"] is None
    assert [v["path"] for p, v in parts if p == "candidate"] == ["/r/unchanged.tmp"]
    assert sorted(v["extension"] for p, v in parts if p == "extension") == [".tmp", ".txt"]
    shared = ledger.share_summary("before")
    assert shared["largest_file_bytes"] == [5, 4, 3] and shared["temporary_candidate_bytes"] == 4
    assert "/r" not in json.dumps(shared)
    assert ledger.share_summary("before", True)["largest_files"][0] == {"path": "/r/removed.txt", "logical_bytes": 5}


def test_refresh(ledger, spark):
    inside = listing(spark, {"/r/folder/new.bin": (6, 77), "/outside/x": (9, 78)}, ["/r/folder/empty"])
    row = ledger.refresh("before", "/r/folder", "mixed", inside, finished_at=4.0)
    assert (row["files"], row["bytes"], row["coverage_complete"], row["candidate_files"]) == (3, 15, False, 0)
    note = row["refresh"]
    assert (note["baseline_id"], note["reused_files"], note["scanned_files"], note["path"]) == ("before", 2, 1, "/r/folder")
    assert note["changes"]["counts"] == {"added": 1, "removed": 1, "replaced": 0, "resized": 0, "metadata_changed": 0,
                                         "unchanged": 0}
    assert note["changes"]["delta_bytes"] == 3 and note["changes"]["content_verified"] is False
    sizes = {r["path"]: r["size"] for r in ledger.store.read("mixed", "directories").collect()}
    assert sizes == {"/r": 15, "/r/folder": 6, "/r/folder/empty": 0, "/r/folder2": 0}
    assert {r["path"] for r in ledger.store.read("mixed", "files").collect()} == {
        "/r/folder/new.bin", "/r/removed.txt", "/r/unchanged.tmp"}
    assert ledger.summary("before")["bytes"] == 12
    with pytest.raises(ValueError):  # a refresh is no baseline
        ledger.refresh("mixed", "/r/folder", "again", inside)


@pytest.mark.parametrize("baseline, selected", [
    ("before", "/r"), ("before", "/"), ("before", "/r/unknown"), ("before", "/r/folder/.."), ("before", "folder"),
    ("partial", "/r/folder")])
def test_refused_refreshes(ledger, spark, baseline, selected):
    with pytest.raises(ValueError):
        ledger.refresh(baseline, selected, "never", listing(spark, {"/r/folder/x": 1}))


def test_refresh_needs_a_complete_observation(ledger, spark):
    broken = listing(spark, {"/r/folder/x": 1}).withColumn("error", F.lit("denied"))
    with pytest.raises(ValueError):
        ledger.refresh("before", "/r/folder", "never", broken)
    with pytest.raises(ValueError):
        ledger.refresh("before", "/r/folder", "never", listing(spark, {"/r/folder": 1}))
    with pytest.raises(ValueError):
        ledger.refresh("before", "/r/folder", "never", listing(spark, {}), timeout_seconds=0)
    with pytest.raises(FileExistsError):
        ledger.refresh("before", "/r/folder", "after", listing(spark, {}))
    assert "never" not in {r["id"] for r in ledger.scans().collect()}


def test_refresh_past_its_budget_publishes_nothing(ledger, spark, monkeypatch):
    clock = iter([0.0, 10.0])
    monkeypatch.setattr(N, "time", types.SimpleNamespace(monotonic=lambda: next(clock), time=lambda: 5.0))
    with pytest.raises(N.RefreshTimedOut):
        ledger.refresh("before", "/r/folder", "late", listing(spark, {"/r/folder/x": 1}), timeout_seconds=5)
    assert "late" not in {r["id"] for r in ledger.scans().collect()}
    ledger.store.discard("late")
    ledger.store.check_new("late")
    with pytest.raises(FileExistsError):
        ledger.store.discard("before")


def test_a_merge_swaps_one_subtree(spark, files):
    """Whatever lies in the subtree comes from the observation, all else from the baseline, and sums follow."""
    rng = random.Random(4411)
    tree = [f"/r/{a}/{b}{c}" for a in ("keep", "keep.old", "swap", "swap~") for b in ("", "x/", "x/y/") for c in "pqrs"]
    for _ in range(3):
        old, new = ({p: rng.randrange(1, 90) for p in rng.sample(tree, 30)} for _ in range(2))
        merged = N.merge_files(files(old), files(new), "/r/swap")
        got = {r["path"]: r["size"] for r in merged.collect()}
        inside = {p for p in tree if p.split("/")[2] == "swap"}
        assert {p: n for p, n in got.items() if p in inside} == {p: n for p, n in new.items() if p in inside}
        assert got.keys() - inside == old.keys() - inside and all(got[p] == old[p] for p in got.keys() - inside)
        sizes = {r["path"]: r["size"] for r in R.directory_totals(R.direct_bytes(merged), "/r").collect()}
        assert sizes["/r"] - sizes.get("/r/swap", 0) == sum(old[p] for p in old.keys() - inside)


def test_hard_link_across_the_scope(spark, files):
    merged = N.merge_files(files({"/r/sibling/a": (4, 7, 0), "/r/part/old": (3, 8, 0)}),
                           files({"/r/part/linked": (4, 7, 0)}), "/r/part")
    assert R.file_totals(merged).first()["bytes"] == 8
    assert R.identity_sizes(merged).first()["unique_bytes"] == 4


def test_cleanup_and_journal(ledger, spark):
    ident = ledger.candidates("before").first()["id"]

    def ids(*some):
        return spark.createDataFrame([(i,) for i in some], "id string")

    fresh, none = ledger.store.read("before", "files"), spark.createDataFrame([], MOVES)
    plan = ledger.plan_cleanup("before", ids(ident), fresh, none, NOW, ["/r"], "b1")
    move = plan.moves.first()
    assert (move["source"], move["destination"]) == ("/r/unchanged.tmp", f"/r/.quarantine/{ident}")
    assert ledger.plan_cleanup("before", ids(ident, "x"), fresh, none, NOW, ["/r"], "b1").moves.count() == 0
    assert ledger.plan_cleanup("before", ids(ident, *map(str, range(700))), fresh, none, NOW, ["/r"], "b1").moves.count() == 0
    present = spark.createDataFrame([(move["destination"], move["fingerprint"], "1", "3")],
                                    "path string, fingerprint string, device string, inode string")
    settled = J.transitions(ledger.reconcile(plan.moves, present))
    log = plan.moves.withColumn("version", F.lit(1)).unionByName(settled.withColumn("version", F.lit(2)))
    moves = J.current(log)
    assert [r["state"] for r in moves.collect()] == ["quarantined"]
    assert [r["verdict"] for r in ledger.restore_batch(moves, present, "b1", ["/r"]).collect()] == ["ok"]
    assert [r["released_bytes"] for r in ledger.purge(moves, present, ["/r"]).collect()] == [4]
    links = spark.createDataFrame([("/r/.quarantine",)], "path string")
    assert [r["verdict"] for r in ledger.restore_batch(moves, present, "b1", ["/r"], links).collect()] == ["unsafe_path"]
    assert [r["verdict"] for r in ledger.purge(moves, present, ["/r"], links=links).collect()] == ["unsafe_path"]
    assert ledger.errors("before").meta.first()["total"] == 0
    assert ledger.extensions("before").first()["extension"] == ".txt"


def test_bounded_scans_count_only_what_they_came_by(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = listing(spark, {"/r/a/1": 1, "/r/a/2": 2, "/r/b/3": 4, "/r/b/4": 8}, ["/r", "/r/a", "/r/b"])
    more = spark.createDataFrame([(f"/r/{place}", kind, None, None, None, None, None, error) for place, kind, error in (
        ("a/0", "f", "denied"), ("a/1l", "l", None), ("b/3l", "l", None), ("b/5", "f", "denied"))], LISTING)
    def facts(ident, **limits):
        row = ledger.scan(ident, rows.unionByName(more), "/r", NOW, **limits)
        return row["files"], row["errors"], row["skipped"], ledger.errors(ident).items.count(), row["complete"]
    assert facts("whole") == (4, 2, 2, 2, True)
    assert facts("all", max_files=4) == (4, 2, 2, 2, True)
    assert facts("three", max_files=3) == (3, 1, 1, 1, False)
    assert facts("two", max_files=2) == (2, 1, 1, 1, False)
    assert facts("folders", max_dirs=2) == (2, 1, 1, 1, False)


def test_pages_say_whether_details_are_whole(ledger):
    assert ledger.browse("before").meta.first()["details_complete"] is True
    assert ledger.errors("before", after={"path": "/r", "reason": ""}).items.count() == 0


def test_listing_without_directories(spark, tmp_path):
    """Object stores list files only; directories follow from them."""
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    row = ledger.scan("flat", listing(spark, {"/r/a/b/c.txt": 5, "/r/x": 1}), "/r", NOW, finished_at=1.0)
    assert row["directories"] == [{"path": "/r", "size": 6}, {"path": "/r/a", "size": 5}, {"path": "/r/a/b", "size": 5}]
    assert ledger.browse("flat", "/r/a").meta.first()["size"] == 5


def test_root_repair(spark):
    for root, right in (("/", 10), ("C:\\", 10), ("/r", 20)):
        summary = spark.createDataFrame(
            [(root, 10, [(root, 20), (root + "x", 3)])], "root string, bytes bigint, directories array<struct<path string, size bigint>>")
        listed = repair_summary(summary).first()["directories"]
        assert [d["size"] for d in listed] == [right, 3]
        folders = spark.createDataFrame([(root, 20), (root + "x", 3)], "path string, size bigint")
        assert sorted(r["size"] for r in repair_directories(folders, summary).collect()) == sorted([right, 3])


def test_long_lists_are_whole(spark, tmp_path):
    """More extensions and candidates than any summary should carry."""
    content = {f"/r/f{i}.e{i}": 1 for i in range(10_001)} | {f"/r/t{i}.tmp": 2 for i in range(700)}
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    row = ledger.scan("many", listing(spark, content), "/r", NOW, temp_roots=["/r"], finished_at=1.0)
    assert (row["candidate_files"], row["candidate_bytes"]) == (700, 1400)
    assert ledger.extensions("many").count() == 10_002 and ledger.candidates("many").count() == 700
    parts = {r["part"]: r["count"] for r in ledger.report("many").groupBy("part").count().collect()}
    assert parts == {"summary": 1, "extension": 10_002, "candidate": 700}
    assert ledger.share_summary("many")["temporary_candidate_count"] == 700


def test_denied_root_is_no_complete_scan(ledger, spark, tmp_path):
    denied = spark.createDataFrame([("/r/folder", "d", 0, 0, 0, "1", "0", "Permission denied")], LISTING)
    with pytest.raises(ValueError):
        ledger.refresh("before", "/r/folder", "unseen", denied)
    assert "unseen" not in {r["id"] for r in ledger.scans().collect()}
    other = Ledger(spark, str(tmp_path / "ledger"))
    row = other.scan("denied", denied, "/r/folder", NOW)
    assert (row["errors"], row["coverage_complete"], row["files"]) == (1, False, 0)
    linked = spark.createDataFrame([("/r/folder", "l", 0, 0, 0, "1", "0", None)], LISTING)
    with pytest.raises(ValueError):
        other.scan("linked", linked, "/r/folder", NOW)
