import random

import pytest
from tables import as_dicts
from pyspark.sql import functions as F

from treeledger.operators import compare as C
from treeledger.operators import scope_changes as S
from treeledger.operators.paging import check_page

BEFORE = {"/r/docs/plan-A.odt": 40, "/r/docs/old/notes": 7, "/r/docs-2/plan": 11, "/r/pics/1.png": 900, "/r/pics/2.png": 901}
AFTER = {"/r/docs/plan-A.odt": 31, "/r/docs-2/plan": 11, "/r/pics/1.png": 900, "/r/pics/2.png": 1000, "/r/pics/3.png": 50, "/r/z": 0}


def test_counts_and_signed_delta(files):
    old, new = files(BEFORE), files(AFTER)
    net = sum(AFTER.values()) - sum(BEFORE.values())
    assert C.change_counts(C.changes(old, new)).first().asDict() == {
        "added": 2, "removed": 1, "resized": 2, "total": 5, "delta_bytes": net}
    back = C.change_counts(C.changes(new, old)).first()
    assert (back["added"], back["removed"], back["delta_bytes"]) == (1, 2, -net)
    assert set(C.change_counts(C.changes(new, new)).first().asDict().values()) == {0}
    rows = {r["path"]: (r["baseline_size"], r["current_size"], r["delta_bytes"]) for r in as_dicts(C.changes(old, new))}
    assert rows == {"/r/docs/plan-A.odt": (40, 31, -9), "/r/docs/old/notes": (7, None, -7), "/r/pics/2.png": (901, 1000, 99),
                    "/r/pics/3.png": (None, 50, 50), "/r/z": (None, 0, 0)}


@pytest.mark.parametrize("options, expected", [
    ({"scope": "/r/docs"}, 2), ({"scope": "/r/docs-2"}, 0), ({"scope": "/r/pics", "kind": "resized"}, 1), ({"kind": "added"}, 2),
    ({"query": "PLAN-a"}, 1), ({"query": ".p_g"}, 0), ({"query": "%"}, 0), ({"scope": "/r/pics", "kind": "removed"}, 0)])
def test_filters(files, options, expected):
    assert C.changes(files(BEFORE), files(AFTER), **options).count() == expected


def test_removed_zero_length_file(files):
    rows = as_dicts(C.changes(files({"/r/d/zero.txt": 0, "/r/x": 1}), files({"/r/x": 1})))
    assert rows == [{"path": "/r/d/zero.txt", "kind": "removed", "baseline_size": 0, "current_size": None,
                     "delta_bytes": 0}]


def test_unknown_kind_and_bad_pages():
    with pytest.raises(ValueError):
        C.check_kind("SQL")
    for offset, limit in ((-1, 10), (0, 0), (0, 501), (True, 10), (0, 1.0)):
        with pytest.raises(ValueError):
            check_page(offset, limit)


def test_132_changes(files):
    old = {f"/r/f{i}": 3 for i in range(130)} | {"/r/gone": 5}
    new = {f"/r/f{i}": 8 for i in range(130)} | {"/r/new": 2}
    counts = C.change_counts(C.changes(files(old), files(new))).first()
    assert (counts["resized"], counts["total"], counts["delta_bytes"]) == (130, 132, 647)


def test_changes_are_set_algebra(files):
    """Added, removed and resized paths by operations on sets of (path, size) pairs."""
    rng = random.Random(77)
    names = [f"/r/{d}/{n}" for d in ("a", "a b", "a-b", "é") for n in range(60)]
    one, two = ({(p, rng.choice((1, 2, 3, 500))) for p in rng.sample(names, 160)} for _ in range(2))
    left, right = {p for p, _ in one}, {p for p, _ in two}
    want = {"added": right - left, "removed": left - right, "resized": {p for p, _ in one - two} & {p for p, _ in two - one}}
    rows = C.changes(files(dict(one)), files(dict(two))).collect()
    assert len(rows) == len({r["path"] for r in rows})
    for kind, paths in want.items():
        assert {r["path"] for r in rows if r["kind"] == kind} == paths
        assert {r["path"] for r in C.changes(files(dict(one)), files(dict(two)), kind=kind).collect()} == paths
    assert sum(r["delta_bytes"] for r in rows) == sum(n for _, n in two) - sum(n for _, n in one)


SCOPE_ROWS = "path string, size bigint, device string, inode string, fingerprint string"


def scope_table(spark, rows):
    return spark.createDataFrame([(p, s, str(d), str(i), f) for p, s, d, i, f in rows], SCOPE_ROWS)


def test_one_class_each_and_only_below_the_scope(spark):
    """A letter of the name says what happens to the file; the neighbour folder shares the scope's beginning."""
    old = [("/lib/n", 10, 1, 5, "u"), ("/lib/m", 20, 1, 6, "u"), ("/lib/z", 30, 1, 7, "u"), ("/lib/i", 40, 1, 8, "u"),
           ("/lib/x", 50, 1, 9, "u"), ("/library/x", 60, 1, 10, "u")]
    new = [("/lib/n", 10, 1, 5, "u"), ("/lib/m", 20, 1, 6, "v"), ("/lib/z", 31, 1, 7, "v"), ("/lib/i", 41, 2, 8, "v"),
           ("/lib/y", 51, 1, 11, "u"), ("/library/x", 61, 1, 12, "v")]
    classified = S.classify(scope_table(spark, old), scope_table(spark, new), "/lib")
    assert {r["path"][-1]: r["kind"] for r in classified.collect()} == {
        "n": "unchanged", "m": "metadata_changed", "z": "resized", "i": "replaced", "x": "removed", "y": "added"}
    row = S.summarize(classified).first()
    assert (row["before_bytes"], row["after_bytes"], row["delta_bytes"]) == (150, 153, 3)
    assert row["content_verified"] is False


def test_inodes_that_no_side_knows_replace_nothing(spark):
    """Every mixture of known and unknown inodes, on the same device and on another one."""
    cases = [(one, two, device) for one in (0, 70, 71) for two in (0, 70, 71) for device in (5, 6)]
    old = [(f"/part/c{i}", 12, 5, one, "f") for i, (one, _, _) in enumerate(cases)]
    new = [(f"/part/c{i}", 12, device, two, "g") for i, (_, two, device) in enumerate(cases)]
    got = {r["path"]: r["kind"] for r in S.classify(scope_table(spark, old), scope_table(spark, new), "/part").collect()}
    for i, (one, two, device) in enumerate(cases):
        told_apart = one and two and (one != two or device != 5)
        assert got[f"/part/c{i}"] == ("replaced" if told_apart else "metadata_changed")


def test_large_inodes_stay_apart(spark):
    rows = S.classify(scope_table(spark, [("/part/x", 1, 1, 2**64 - 1, "a")]),
                      scope_table(spark, [("/part/x", 1, 1, 2**64 - 2, "a")]), "/part")
    assert [r["kind"] for r in rows.collect()] == ["replaced"]


def test_empty_scope(spark):
    row = S.summarize(S.classify(scope_table(spark, []), scope_table(spark, []), "/part")).first().asDict(True)
    assert set(row["counts"].values()) == {0} and row["delta_bytes"] == 0


def test_classes_are_set_algebra(spark):
    """Each class as a set of paths, from sets of (path, property) pairs on both sides."""
    rng = random.Random(90210)
    paths = [f"/part/{i:03}" for i in range(700)]

    def side():
        return {p: (rng.choice((0, 5, 9)), rng.choice((1, 2)), rng.choice((0, 3, 4)), rng.choice("fgh")) for p in paths if rng.random() < .8}

    before, after = side(), side()
    both = before.keys() & after.keys()
    identity = [{(p, *rows[p][1:3]) for p in both} for rows in (before, after)]
    known = {p for p in both if before[p][2] and after[p][2]}
    moved = {p for p, *_ in identity[0] - identity[1]} & known
    grown = {p for p, _ in {(p, before[p][0]) for p in both} - {(p, after[p][0]) for p in both}} - moved
    touched = {p for p, _ in {(p, before[p][3]) for p in both} - {(p, after[p][3]) for p in both}} - moved - grown
    want = {"added": after.keys() - both, "removed": before.keys() - both, "replaced": moved, "resized": grown,
            "metadata_changed": touched, "unchanged": both - moved - grown - touched}
    classified = S.classify(scope_table(spark, [(p, *r) for p, r in before.items()]),
                            scope_table(spark, [(p, *r) for p, r in after.items()]), "/part").collect()
    assert len(classified) == len(before.keys() | after.keys())
    for kind, expected in want.items():
        assert {r["path"] for r in classified if r["kind"] == kind} == set(expected)


def test_pair_coverage(spark):
    one = spark.createDataFrame([(True,)], "coverage_complete boolean")
    two = one.select((~F.col("coverage_complete")).alias("coverage_complete"))
    assert C.pair_coverage(one, two).first().asDict() == {
        "baseline_coverage_complete": True, "current_coverage_complete": False, "coverage_complete": False}
