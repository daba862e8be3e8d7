"""Directory pages and whole-snapshot search."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.functions.text import ascii_lower, contains_text, page_count, page_number, truncated
from treeledger.operators.paging import Page, check_page, ordered_slice, rows_after
from treeledger.schema import PAGE_ROWS

# (key, descending) per sort name; path always breaks ties.
_SORTS = {
    "size": (lambda: F.col("size"), True),
    "allocated": (lambda: F.coalesce("allocated", F.lit(-1)), True),
    "name": (lambda: ascii_lower(F.col("name")), False),
    # Directories carry no time and come last, as nulls do in a descending order.
    "modified": (lambda: F.coalesce("modified", F.lit(float("-inf"))), True),
}


def _keys(sort: str) -> list[tuple[Column, bool]]:
    if sort not in _SORTS:
        raise ValueError(f"sort must be one of {sorted(_SORTS)}")
    key, descending = _SORTS[sort]
    return [(key(), descending), (F.col("path"), False)]


def sort_order(sort: str) -> list[Column]:
    return [key.desc() if descending else key.asc() for key, descending in _keys(sort)]


def entries(files: DataFrame, directories: DataFrame, selected: str, query: str = "",
            recursive: bool = False) -> DataFrame:
    """Everything a page is cut from: children of selected, or any file whose path matches."""
    as_file = [F.col(c) for c in ("path", "name", "size", "allocated", "extension", "modified")]
    if recursive:
        return files.where(contains_text(F.col("path"), query)).select(*as_file, F.lit("file").alias("kind"))
    child = (F.col("parent") == selected) & contains_text(F.col("name"), query)
    folders = directories.where(child & (F.col("path") != selected)).select(
        "path", "name", "size", F.lit(None).cast("bigint").alias("allocated"), F.lit("").alias("extension"),
        F.lit(None).cast("double").alias("modified"), F.lit("directory").alias("kind"))
    return files.where(child).select(*as_file, F.lit("file").alias("kind")).unionByName(folders)


def browse(files: DataFrame, directories: DataFrame, root: str, selected: str = "", query: str = "",
           offset: int = 0, limit: int = PAGE_ROWS, recursive: bool = False, sort: str = "size",
           after: dict | None = None, rules: PathRules = POSIX) -> Page:
    """A page of entries and its description.

    meta.size is null when selected is not a directory of the snapshot. after takes
    the last row of the page before and costs the same at any depth; offset is kept
    for direct jumps.
    """
    check_page(offset, limit)
    selected = selected or root
    keys, order = _keys(sort), sort_order(sort)
    found = entries(files, directories, selected, query, recursive)
    page = found
    if after is not None:
        page = found.where(rows_after([(key, down, value) for (key, down), value
                                       in zip(keys, _after_values(after, sort), strict=True)]))
    items = ordered_slice(page, order, offset, limit)
    size = directories.where(F.col("path") == selected).agg(F.max("size")).scalar()
    parent = None if selected == root else rules.parent_of(selected)
    total = F.col("total")
    meta = found.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(offset).cast("bigint").alias("offset"), F.lit(limit).cast("bigint").alias("limit"),
        (F.lit(offset + limit) < total).alias("has_more"), size.alias("size"),
        F.lit(selected).alias("path"), F.lit(parent).cast("string").alias("parent"),
        page_number(F.lit(offset), limit).alias("page"), page_count(total, limit).alias("pages"))
    return Page(items, meta)


def _after_values(after: dict, sort: str) -> list:
    value = after[sort]
    if sort == "allocated":
        value = -1 if value is None else value
    elif sort == "modified":
        value = float("-inf") if value is None else float(value)
    elif sort == "name":
        value = "".join(c.lower() if "A" <= c <= "Z" else c for c in value)
    return [value, after["path"]]


def area_map(items: DataFrame, tiles: int = 24) -> DataFrame:
    """The first positive-size items of a page with their share of those shown.

    items is a page, so at most 500 rows reach the sum over the tiles.
    """
    shown = items.where(F.col("size") > 0).orderBy(F.desc("size"), "path").limit(tiles)
    whole = F.greatest(shown.agg(F.sum("size")).scalar(), F.lit(1))
    return shown.select("path", "name", "kind", "size",
                        F.greatest(F.lit(0.1), F.col("size") / whole * 100).alias("share"))


def error_page(errors: DataFrame, offset: int = 0, after: dict | None = None, reason_chars: int | None = None) -> Page:
    """A page of errors; after continues from the last row of the page before, reason_chars cuts for display."""
    page = errors.select("path", "reason")
    if after is not None:
        page = page.where(rows_after([(F.col("path"), False, after["path"]), (F.col("reason"), False, after["reason"])]))
    items = ordered_slice(page, [F.col("path"), F.col("reason")], offset, PAGE_ROWS)
    if reason_chars is not None:
        items = items.withColumn("reason", truncated(F.col("reason"), reason_chars))
    return Page(items, errors.agg(F.count(F.lit(1)).alias("total")))
