"""The tree as intervals: places in depth-first order, running sums over them, and marks swept in that order.

Paths sorted with the separator lowest stand in depth-first order, siblings by name: a
directory's content follows it without a gap. A directory is then an interval of places,
and whether a path lies under a mark, or how much lies under a directory, comes from
running sums, without a row per ancestor.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.links import rows_by_parent
from treeledger.sources.workspace import materialize

LOWEST, BEHIND = "\x00", "\x01"  # a path has no NUL; BEHIND follows it and precedes all else


def tree_key(path: Column, rules: PathRules = POSIX) -> Column:
    """Sorts paths depth-first. A root's trailing separator does not count."""
    bare = F.when(path.endswith(rules.sep), F.left(path, F.length(path) - len(rules.sep))).otherwise(path)
    return F.replace(bare, F.lit(rules.sep), F.lit(LOWEST))


def end_key(path: Column, rules: PathRules = POSIX) -> Column:
    """Sorts behind all that lies in a directory and before what follows it."""
    return F.concat(tree_key(path, rules), F.lit(BEHIND))


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows written out in a total order, with running sums up to and including each row.

    Two passes: sums within the parts of a range sort, and the sums of the parts before
    them, which are as many as the sort has tasks and may therefore be broadcast.
    """
    values = rows.withColumns({f"_{name}": value for name, value in sums.items()})
    laid = materialize(values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    whole = laid.groupBy("_part").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumns({name: F.sum(f"_{name}").over(within) for name in sums}).join(F.broadcast(starts), "_part")
    return summed.select(*[c for c in rows.columns if c not in sums],
                         *[(F.col(name) + F.col(f"_start_{name}")).alias(name) for name in sums])


def depth_first(entries: DataFrame, rules: PathRules = POSIX) -> DataFrame:
    """Entries (path, ...) with place, their number from 0 in depth-first order."""
    keyed = entries.withColumn("_key", tree_key(F.col("path"), rules))
    return running(keyed, ["_key", "path"], {"place": F.lit(1)}).drop("_key").withColumn("place", F.col("place") - 1)


def directory_intervals(direct: DataFrame, root: str, registered: DataFrame | None = None,
                        rules: PathRules = POSIX) -> DataFrame:
    """Directories with first and last, their interval of places among directories, and size, the bytes beneath them.

    direct holds the bytes that lie immediately in each directory (path, size); unlike in
    directory_totals, a directory between root and these must be registered to be known.
    Every directory is two rows, where it starts and where it ends; the sums between them
    are its total. Nothing fans out with the depth.
    """
    inside = rules.inside(F.col("path"), root)
    known = direct.where(inside).select("path", F.col("size").cast("bigint").alias("size"))
    if registered is not None:
        known = known.unionByName(registered.where(inside).select("path", F.lit(0).cast("bigint").alias("size")))
    known = known.groupBy("path").agg(F.sum("size").alias("size"))
    path, size = F.col("path"), F.col("size")
    ends = F.explode(F.array(F.struct(tree_key(path, rules).alias("key"), size.alias("bytes"), F.lit(1).alias("one")),
                             F.struct(end_key(path, rules).alias("key"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("one"))))
    rows = known.select("path", "size", ends.alias("at")).select("path", "size", "at.*")
    at = running(rows, ["key", "path"], {"bytes": F.col("bytes"), "one": F.col("one")})
    spans = at.groupBy("path").agg(F.min("one").alias("first"), F.max("one").alias("last"), F.min("bytes").alias("low"),
                                   F.max("bytes").alias("high"), F.max("size").alias("own"))
    return spans.select("path", (F.col("first") - 1).alias("first"), (F.col("last") - 1).alias("last"),
                        (F.col("high") - F.col("low") + F.col("own")).alias("size"))


def marked(paths: DataFrame, marks: DataFrame, rules: PathRules = POSIX) -> DataFrame:
    """Those of the paths (path, unique) that equal or lie below a mark (path, of any number).

    A sweep in depth-first order: a mark opens at its own path and closes behind its content;
    the number of open marks is a running sum that goes on across the parts of the sort.
    """
    path = F.col("path")
    opened = F.explode(F.array(F.struct(tree_key(path, rules).alias("key"), F.lit(0).alias("turn"), F.lit(1).alias("open")),
                               F.struct(end_key(path, rules).alias("key"), F.lit(0).alias("turn"), F.lit(-1).alias("open"))))
    events = marks.select("path").distinct().select("path", opened.alias("e")).select("path", "e.*")
    asked = paths.select("path", tree_key(path, rules).alias("key"), F.lit(1).alias("turn"), F.lit(0).alias("open"))
    swept = running(events.unionByName(asked), ["key", "turn", "path"], {"open": F.col("open")})
    return swept.where("turn = 1 AND open > 0").select("path")


def rows_under(rows: DataFrame, marks: DataFrame, how: str, rules: PathRules = POSIX) -> DataFrame:
    """Keep (left_semi) or drop (left_anti) rows (path, parent) whose parent equals or lies below a mark."""
    return rows_by_parent(rows, lambda parents: marked(parents, marks, rules), how)


def limit_traversal(files: DataFrame, max_files: int, rules: PathRules = POSIX) -> DataFrame:
    """The first files of a depth-first walk that takes the entries of a directory by name."""
    if max_files < 1:
        raise ValueError("scan limits must be at least 1")
    placed = depth_first(files, rules)
    return placed.where(F.col("place") < max_files)
