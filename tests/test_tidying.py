import pytest
from tables import as_dicts
from pyspark.sql import functions as F

from treeledger.operators import cleanup as K
from treeledger.operators import journal as J
from treeledger.schema import MOVES

NOW = 100 * 86400
ROOTS = ["/r/tmp", "/r/cache"]
OLD = NOW - 9 * 86400


@pytest.fixture
def table(files):
    return files({"/r/tmp/old.tmp": (3, 1, OLD), "/r/tmp/a/OLD.LOG": (4, 2, NOW - 7 * 86400),
                  "/r/tmp/fresh.tmp": (5, 3, NOW - 7 * 86400 + 1), "/r/tmp/old.txt": (6, 4, OLD),
                  "/r/tmp-not/old.tmp": (7, 5, OLD), "/r/cache/x.log": (8, 6, OLD)})


def eligible(table, **options):
    return K.eligible(table, NOW, ROOTS, "/r", **options)


def test_eligibility(table):
    found = K.candidates(eligible(table), NOW)
    assert {r["path"]: r["age_days"] for r in found.collect()} == {
        "/r/tmp/old.tmp": 9, "/r/tmp/a/OLD.LOG": 7, "/r/cache/x.log": 9}
    assert K.candidate_totals(found).first().asDict() == {"candidates": 3, "bytes": 15}
    assert len({r["id"] for r in found.collect()}) == 3


def test_roots_as_a_table(spark, table):
    roots = spark.createDataFrame([(r,) for r in ROOTS], "path string")
    assert sorted(map(tuple, K.eligible(table, NOW, roots, "/r").select("path").collect())) == sorted(
        map(tuple, eligible(table).select("path").collect()))


def test_links_on_the_way_disqualify(spark, table):
    links = spark.createDataFrame([("/r/tmp/a",), ("/elsewhere",)], "path string")
    assert {r["path"] for r in eligible(table, links=links).collect()} == {"/r/tmp/old.tmp", "/r/cache/x.log"}


def selection(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_revalidation_verdicts(spark, files, table):
    found = K.candidates(eligible(table), NOW)
    ids = {r["path"]: r["id"] for r in found.collect()}
    fresh = files({"/r/tmp/old.tmp": (3, 1, OLD), "/r/tmp/a/OLD.LOG": (5, 2, NOW - 7 * 86400),
                   f"/r/cache/.quarantine-x/{ids['/r/cache/x.log']}": 1, "/r/cache/x.log": (8, 6, OLD)})
    rows = K.revalidate(selection(spark, [*ids.values(), "nobody", ids["/r/cache/x.log"]]), found, fresh, NOW, ROOTS)
    verdicts = {r["path"]: r["verdict"] for r in rows.collect()}
    assert verdicts == {"/r/tmp/a/OLD.LOG": "changed", "/r/cache/x.log": "repeated", None: "unknown",
                        "/r/tmp/old.tmp": "ok"}
    again = K.revalidate(selection(spark, ids.values()), found, table, NOW, ROOTS)
    assert {r["verdict"] for r in again.collect()} == {"ok"}
    assert K.batch_allowed(again).first().asDict() == {"selected": 3, "ok": 3, "allowed": True}
    late = K.revalidate(selection(spark, ids.values()), found, table, NOW - 5 * 86400, ROOTS)
    assert {r["verdict"] for r in late.collect()} == {"ineligible"}
    blocked = K.revalidate(selection(spark, ids.values()), found, table.unionByName(
        table.limit(1).withColumn("path", F.lit("/r/cache/.quarantine/" + ids["/r/cache/x.log"]))), NOW, ROOTS)
    assert {r["path"]: r["verdict"] for r in blocked.collect()}["/r/cache/x.log"] == "collision"
    bad = K.bad_ids(selection(spark, ["nobody", "nobody", ids["/r/cache/x.log"]]), found)
    assert sorted(map(tuple, bad.collect())) == [("nobody", "repeated"), ("nobody", "unknown")]


def moves(spark, *rows):
    return spark.createDataFrame([(i, s, d, n, f, st, c, b) for i, s, d, n, f, st, c, b in rows], MOVES)


def test_plan_is_all_or_nothing_and_bounded(spark, table):
    found = K.candidates(eligible(table), NOW)
    verdicts = K.revalidate(found.select("id"), found, table, NOW, ROOTS)
    empty = moves(spark)
    plan = K.selection_plan(verdicts, empty, NOW, "b1").collect()
    assert len(plan) == 3 and {r["state"] for r in plan} == {"pending"}
    assert all(r["destination"].endswith("/.quarantine/" + r["id"]) for r in plan)
    full = moves(spark, ("q", "s", "d", 2 * 1024**3, "f", "quarantined", 1.0, "b0"))
    assert K.quota(full, verdicts).first()["allowed"] is False
    assert K.selection_plan(verdicts, full, NOW, "b1").count() == 0
    settled = moves(spark, ("q", "s", "d", 2 * 1024**3, "f", "purged", 1.0, "b0"))
    assert K.selection_plan(verdicts, settled, NOW, "b1").count() == 3
    bad = K.revalidate(found.select("id").unionByName(selection(spark, ["x"])), found, table, NOW, ROOTS)
    assert K.selection_plan(bad, empty, NOW, "b1").count() == 0


def end(path, inode, fingerprint="f"):
    return (path, fingerprint, "1", inode)


CASES = [  # state, source, destination -> reconciled, restore, purge
    ("pending", None, end("d", "1"), "quarantined", "not_in_quarantine", "not_in_quarantine"),
    ("pending", end("s", "1"), None, "failed", "not_in_quarantine", "not_in_quarantine"),
    ("pending", end("s", "1"), end("d", "1"), "pending", "not_in_quarantine", "not_in_quarantine"),
    ("restoring", end("s", "1"), None, "restored", "unsafe_path", "not_in_quarantine"),
    ("restoring", end("s", "1", "other"), None, "restoring", "unsafe_path", "not_in_quarantine"),
    ("restoring", end("s", "1"), end("d", "1"), "restoring", "ok", "not_in_quarantine"),
    ("restoring", end("s", "2"), end("d", "1"), "restoring", "conflict", "not_in_quarantine"),
    ("purging", None, end("d", "1"), "quarantined", "not_in_quarantine", "not_in_quarantine"),
    ("purging", None, None, "purged", "not_in_quarantine", "not_in_quarantine"),
    ("quarantined", None, end("d", "1"), "quarantined", "ok", "ok"),
    ("quarantined", end("s", "1"), end("d", "1"), "quarantined", "source_occupied", "ok"),
    ("quarantined", None, end("d", "1", "other"), "quarantined", "changed", "changed"),
    ("quarantined", None, None, "quarantined", "unsafe_path", "unsafe_path"),
    ("restored", None, None, "restored", "not_in_quarantine", "not_in_quarantine"),
]


def test_presence_looks_up_all_ends_at_once(spark):
    journal = moves(spark, ("1", "/r/a", "/r/q/1", 7, "f", "pending", 1.0, "b"), ("2", "/r/b", None, 7, "f", "pending", 1.0, "b"),
                    ("3", None, None, 7, "f", "pending", 1.0, "b"), ("4", "/r/a", "/r/b", 7, "f", "pending", 1.0, "b"))
    present = spark.createDataFrame([("/r/a", "x", "1", "5"), ("/r/b", "y", None, "6"), ("/r/q/1", None, "1", "7"), (None, "n", "1", "8")],
                                    "path string, fingerprint string, device string, inode string")
    checked = J.presence(journal, present)
    got = {r["id"]: (r["source_fingerprint"], r["source_inode"], r["destination_fingerprint"], r["destination_inode"]) for r in checked.collect()}
    assert got == {"1": ("x", "5", None, "7"), "2": ("y", "6", None, None), "3": (None,) * 4, "4": ("x", "5", "y", "6")}
    assert checked.columns[:len(journal.columns)] == journal.columns
    assert J.presence(journal.limit(0), present).count() == 0 and J.presence(journal, present.limit(0)).count() == 4
    scans = J.presence(journal, spark.range(9).select(
        F.col("id").cast("string").alias("path"), *[F.lit("x").alias(c) for c in ("fingerprint", "device", "inode")]))
    assert scans._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1


def test_journal_against_storage(spark):
    rows, present = [], []
    for i, (state, source, destination, *_) in enumerate(CASES):
        paths = (f"/r/tmp/f{i}", f"/r/tmp/.quarantine/{i}")
        rows.append((str(i), *paths, 7, "f", state, float(i), "b"))
        present += [(path, *fact[1:]) for path, fact in zip(paths, (source, destination)) if fact]
    journal = moves(spark, *rows)
    checked = J.presence(journal, spark.createDataFrame(
        present, "path string, fingerprint string, device string, inode string"))
    new = {int(r["id"]): r["new_state"] for r in J.reconcile(checked).collect()}
    assert new == {i: case[3] for i, case in enumerate(CASES)}
    restore = {int(r["id"]): r["verdict"] for r in J.restore_verdict(checked, ROOTS).collect()}
    assert restore == {i: case[4] for i, case in enumerate(CASES)}
    purge = {int(r["id"]): (r["verdict"], r["released_bytes"]) for r in J.purge_verdict(checked, ROOTS).collect()}
    assert purge == {i: (case[5], 7 if case[5] == "ok" else 0) for i, case in enumerate(CASES)}
    assert {r["verdict"] for r in J.purge_verdict(checked, ["/elsewhere"]).where("state = 'quarantined'").collect()} == {"unsafe_path"}
    linked = journal.select("id")
    assert "ok" not in {r["verdict"] for r in J.restore_verdict(checked, ROOTS, linked).collect()}
    assert {r["id"] for r in J.batch_plan(journal, "b").collect()} == {
        str(i) for i, case in enumerate(CASES) if case[0] in ("quarantined", "restoring")}
    assert [r["id"] for r in J.history_page(journal).collect()] == [str(i) for i in reversed(range(len(CASES)))]
    assert as_dicts(J.batch_plan(journal, "none")) == []
