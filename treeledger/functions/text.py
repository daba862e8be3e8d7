"""Search, presentation and CSV expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.schema import DAY_SECONDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_FOLD = str.maketrans(_UPPER, _LOWER)


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only; other letters keep their case, as the search rules ask."""
    return F.translate(text, _UPPER, _LOWER)


def contains_text(text: Column, query: str) -> Column:
    """Literal search without wildcards. An empty query matches everything."""
    if not query:
        return F.lit(True)
    return ascii_lower(text).contains(query.translate(_FOLD))


def age_days(modified: Column, now: float) -> Column:
    return ((F.lit(float(now)) - modified) / DAY_SECONDS).cast("bigint")


def truncated(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def human_size(size: Column) -> Column:
    """1024-based size with one decimal above bytes, rounded half up in whole numbers."""

    def scaled(power: int) -> Column:
        unit = 1 << (10 * power)
        whole = F.shiftright(size, 10 * power)
        rest = size - F.shiftleft(whole, 10 * power)
        tenths = F.shiftright(rest * 20 + unit, 10 * power + 1)
        return F.concat(
            (whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."),
            F.when(tenths == 10, F.lit(0)).otherwise(tenths).cast("string"), F.lit(" " + _UNITS[power]))

    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power in (1, 2, 3):
        text = text.when(size < 1 << (10 * (power + 1)), scaled(power))
    return text.otherwise(scaled(4))


def signed_size(size: Column) -> Column:
    """The same with a sign; the minus is U+2212 and zero has none."""
    sign = F.when(size < 0, F.lit("−")).when(size > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, human_size(F.abs(size)))


def formula_guard(path: Column) -> Column:
    """Keep spreadsheets from running a path that looks like a formula."""
    return F.when(path.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), path)).otherwise(path)


def strict_formula_guard(path: Column) -> Column:
    """The same, also behind leading white space of any script and after TAB, CR or LF."""
    risky = path.rlike(r"(?U)^[\s\x1c-\x1f]*[=+\-@]") | path.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), path)).otherwise(path)


def float_text(number: Column) -> Column:
    """A float in plain notation with at least one decimal, never with an exponent."""
    plain = number.cast("decimal(38,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")


def csv_line(*fields: Column) -> Column:
    """One CSV record: quotes only where needed, doubled inside, nothing for null.

    The built-in CSV writer rewrites line breaks inside fields, and a path may hold one.
    """
    cells = []
    for field in fields:
        text = F.coalesce(field.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text))
    return F.concat_ws(",", *cells)


def flag_text(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


def page_number(offset: Column, rows: int) -> Column:
    return (F.floor(offset / rows) + 1).cast("bigint")


def page_count(total: Column, rows: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / rows).cast("bigint"))
