"""Which directories lie at or below a link, and rows kept clear of them."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.joins import lookup_join
from treeledger.sources.workspace import materialize


def directories_under(directories: DataFrame, marks: DataFrame, root: str, rules: PathRules = POSIX) -> DataFrame:
    """Those of the given directories (path, unique) that equal or lie below a marked path.

    Ancestors are matched by equality, on directories only. The root is an ancestor
    of everything, hence the join that splits heavy keys.
    """
    chains = (directories.where(rules.inside(F.col("path"), root))
              .select("path", F.explode(rules.lineage(F.col("path"), root)).alias("mark")))
    marked = marks.select(F.col("path").alias("mark")).distinct()
    return lookup_join(chains, marked, ["mark"], "left_semi", ["path"]).select("path").distinct()


def ids_under(rows: DataFrame, ends: list[str], links: DataFrame, top: str, rules: PathRules = POSIX) -> DataFrame:
    """Ids, one each, of rows with a link on the way down to any of the paths in the columns ends."""
    paths = rows.select("id", F.explode(F.array(*ends)).alias("path")).where("path IS NOT NULL")
    paths = paths.withColumn("parent", rules.parent(F.col("path")))
    return rows_by_marked_parent(paths, links, top, "left_semi", rules).select("id").distinct()


def rows_by_marked_parent(rows: DataFrame, marks: DataFrame, root: str, how: str,
                          rules: PathRules = POSIX) -> DataFrame:
    """Keep (left_semi) or drop (left_anti) rows whose parent equals or lies below a mark."""
    return rows_by_parent(rows, lambda parents: directories_under(parents, marks, root, rules), how)


def rows_by_parent(rows: DataFrame, choose: Callable[[DataFrame], DataFrame], how: str) -> DataFrame:
    """Keep (left_semi) or drop (left_anti) rows whose parent is one that choose picks from the parents (path).

    The rows are read twice: for the parents they have, which are kept in the work folder
    with their numbers of rows and picked there, and for the join with the picked ones.
    """
    parents = materialize(rows.groupBy("parent").agg(F.count(F.lit(1)).alias("_rows")))
    hit = choose(parents.select(F.col("parent").alias("path")))
    return lookup_join(rows, materialize(hit.select(F.col("path").alias("parent"))), ["parent"], how, ["path"], parents)
