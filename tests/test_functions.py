import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions import text as X


def evaluate(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_extension(spark):
    names = ["a.tar.gz", ".bashrc", "foo.", "..foo", "A.TXT", "none", "", ".", "..", "x.é", "a.b ", "ÄB.ÄB"]
    none = "(无扩展名)"
    assert evaluate(spark, names, "string", P.extension) == [
        ".gz", none, none, ".foo", ".txt", none, none, none, none, ".é", ".b ", ".äb"]


def test_parent_and_name(spark):
    paths = ["/a/b.txt", "/a", "/", "/a/b/c"]
    assert evaluate(spark, paths, "string", P.POSIX.parent) == ["/a", "/", "/", "/a/b"]
    assert evaluate(spark, paths, "string", P.POSIX.name) == ["b.txt", "a", "", "c"]
    paths = ["C:\\a\\b.txt", "C:\\a", "C:\\"]
    assert evaluate(spark, paths, "string", P.WINDOWS.parent) == ["C:\\a", "C:\\", "C:\\"]
    assert evaluate(spark, paths, "string", P.WINDOWS.name) == ["b.txt", "a", ""]


def test_lineage(spark):
    assert evaluate(spark, ["/d", "/d/a", "/d/a/b"], "string", lambda c: P.POSIX.lineage(c, "/d")) == [
        ["/d"], ["/d", "/d/a"], ["/d", "/d/a", "/d/a/b"]]
    assert evaluate(spark, ["/", "/d", "/d/a"], "string", lambda c: P.POSIX.lineage(c, "/")) == [
        ["/"], ["/", "/d"], ["/", "/d", "/d/a"]]
    assert evaluate(spark, ["C:\\", "C:\\x\\y"], "string", lambda c: P.WINDOWS.lineage(c, "C:\\")) == [
        ["C:\\"], ["C:\\", "C:\\x", "C:\\x\\y"]]


def test_component_boundary(spark):
    paths = ["/p/part/x", "/p/part-two/x", "/p/part", "/p/partx", "/p/PART/x"]
    assert evaluate(spark, paths, "string", lambda c: P.POSIX.under(c, "/p/part")) == [True, False, False, False, False]
    assert evaluate(spark, paths, "string", lambda c: P.POSIX.inside(c, "/p/part")) == [True, False, True, False, False]
    assert evaluate(spark, ["/x"], "string", lambda c: P.POSIX.under(c, "/")) == [True]


def test_lexical_arguments():
    assert P.POSIX.normalize("/a//b/../c/") == "/a/c"
    assert P.POSIX.contains("/a", "/a/b") and P.POSIX.contains("/a", "/a") and not P.POSIX.contains("/a", "/ab")
    assert P.WINDOWS.normalize("C:/a/b") == "C:\\a\\b"
    assert P.POSIX.parent_of("/") == "/" and P.WINDOWS.parent_of("C:\\a") == "C:\\"


def test_search_is_literal_and_folds_ascii_only(spark):
    values = ["RESIZE.txt", "100%_'", "ÄB", "äb", ""]
    assert evaluate(spark, values, "string", lambda c: X.contains_text(c, "resize")) == [True, False, False, False, False]
    assert evaluate(spark, values, "string", lambda c: X.contains_text(c, "%_'")) == [False, True, False, False, False]
    assert evaluate(spark, values, "string", lambda c: X.contains_text(c, "Äb")) == [False, False, True, False, False]
    assert evaluate(spark, values, "string", lambda c: X.contains_text(c, "")) == [True] * 5


def expected_size(n):
    """Exact half-up rounding in whole numbers."""
    power = 0
    while n >= 1024 ** (power + 1) and power < 4:
        power += 1
    if not power:
        return f"{n} B"
    unit = 1024 ** power
    tenths = (n * 20 + unit) // (2 * unit)
    return f"{tenths // 10}.{tenths % 10} {['B', 'KiB', 'MiB', 'GiB', 'TiB'][power]}"


def test_human_size(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1075, 1126, 1048575, 1048576, 5 * 1024**3, 1024**4 - 1, 1024**4, 1024**5, 2**62]
    shown = evaluate(spark, sizes, "bigint", X.human_size)
    assert shown[:6] == ["0 B", "1 B", "1023 B", "1.0 KiB", "1.3 KiB", "1.0 KiB"]
    assert shown[7] == "1024.0 KiB"
    assert shown == [expected_size(n) for n in sizes]
    assert evaluate(spark, [0, 5, -1536], "bigint", X.signed_size) == ["0 B", "+5 B", "−1.5 KiB"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**60), min_size=50, max_size=200))
def test_human_size_on_any_size(spark, sizes):
    assert evaluate(spark, sizes, "bigint", X.human_size) == [expected_size(n) for n in sizes]


def test_formula_guards(spark):
    """Path, guarded in the inventory, guarded in the comparison."""
    answers = [("=x", "'=x", "'=x"), ("+x", "'+x", "'+x"), ("-x", "'-x", "'-x"), ("@x", "'@x", "'@x"), ("x=", "x=", "x="),
               (" =x", " =x", "' =x"), ("\t", "\t", "'\t"), ("\rx", "\rx", "'\rx"), ("\nx", "\nx", "'\nx"),
               ("\u3000=", "\u3000=", "'\u3000="), ("\x1c+x", "\x1c+x", "'\x1c+x"), (" x", " x", " x"), ("", "", "")]
    paths = [path for path, _, _ in answers]
    assert evaluate(spark, paths, "string", X.formula_guard) == [plain for _, plain, _ in answers]
    assert evaluate(spark, paths, "string", X.strict_formula_guard) == [strict for _, _, strict in answers]


def test_guard_covers_all_python_white_space(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    paths = [s + "=1" for s in spaces]
    assert evaluate(spark, paths, "string", X.strict_formula_guard) == ["'" + p for p in paths]


def test_float_text(spark):
    values = [0.0, 1704067200.0, 1704067200.5, 1704067200.1234567, 12345.000001]
    assert evaluate(spark, values, "double", X.float_text) == [repr(v) for v in values]


def test_csv_line_matches_python(spark):
    import csv
    import io
    rows = [('a,b', None), ('q"x', 1), ("n\nl", 2), ("r\rz", 3), (" sp ", 4), ("", 5), ("é", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b bigint")
    got = [r[0] for r in df.orderBy("i").select(X.csv_line(F.col("a"), F.col("b"))).collect()]
    for line, row in zip(got, rows):
        out = io.StringIO()
        csv.writer(out).writerow(row)
        assert line + "\r\n" == out.getvalue()


@pytest.mark.parametrize("age", [0, 86399, 86400, 7 * 86400, 7.5 * 86400, -1.5 * 86400])
def test_age_truncates(spark, age):
    assert evaluate(spark, [1000.0 - age], "double", lambda c: X.age_days(c, 1000.0)) == [int(age / 86400)]


def test_page_numbers(spark):
    totals = [0, 1, 100, 101, 250]
    assert evaluate(spark, totals, "bigint", lambda c: X.page_count(c, 100)) == [max(1, math.ceil(t / 100)) for t in totals]
    assert evaluate(spark, [0, 99, 100], "bigint", lambda c: X.page_number(c, 100)) == [1, 1, 2]
