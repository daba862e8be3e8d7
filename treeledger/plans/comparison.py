"""Compare two stored snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators import compare as C
from treeledger.operators import digest as D
from treeledger.operators.paging import Page, check_page, last_rows, ordered_slice, placed, placed_slice
from treeledger.schema import PAGE_ROWS
from treeledger.sources.store import SnapshotStore
from treeledger.sources.workspace import materialize

NOT_COVERED = ("at least one scan did not cover everything: added and removed may come from cancellation, "
               "permissions or scope and prove no real change")
MEASUREMENT = "observed logical size by path; removed means no longer observed, equal size means nothing about content"
_HEADER = ("finished_at", "complete", "coverage_complete", "files", "errors", "skipped")


class ComparisonError(ValueError):
    """The two snapshots cannot be compared as asked."""


class ScopeNotFound(ComparisonError):
    """Neither snapshot registered the directory."""


class Comparison:
    """A validated comparison. Its rows are computed once; counts, pages and exports share them.

    bucketed names the catalog tables that SnapshotStore.bucket made of both snapshots,
    baseline first; with them no row is moved for the join. digests compares the digests of
    directories first and reads only data files, and joins only rows, of directories that differ.
    """

    def __init__(self, store: SnapshotStore, baseline: str, current: str, selected: str = "", query: str = "",
                 kind: str = "all", rules: PathRules = POSIX, bucketed: tuple[str, str] | None = None,
                 digests: bool = False):
        try:
            C.check_kind(kind)
        except ValueError as error:
            raise ComparisonError(str(error)) from None
        old, new = (_header(store, ident) for ident in (baseline, current))
        self.root = rules.normalize(old["root"])
        if self.root != rules.normalize(new["root"]):
            raise ComparisonError("only snapshots of the same root can be compared")
        self.path = rules.normalize(selected) if selected else self.root
        if not rules.contains(self.root, self.path):
            raise ComparisonError("the directory must lie inside the scanned root")
        folders = [store.read(ident, "directories") for ident in (baseline, current)]
        if not C.scope_known(folders, self.path).first()["known"]:
            raise ScopeNotFound("the directory is in neither snapshot")
        self.baseline = {key: old[key] for key in _HEADER}
        self.current = {key: new[key] for key in _HEADER}
        self.coverage_complete = bool(old["coverage_complete"]) and bool(new["coverage_complete"])
        self.warnings = [] if self.coverage_complete else [NOT_COVERED]
        self.measurement = MEASUREMENT
        files = ([store.spark.table(name) for name in bucketed] if bucketed
                 else [store.read(ident, "files") for ident in (baseline, current)])
        if digests and not bucketed:
            files = self._unlike(store, (baseline, current), files, rules)
        self._files, self._args = files, (self.path, query, kind, rules, bool(bucketed))
        self._rows = C.changes(*files, *self._args)
        self._stored: DataFrame | None = None
        self._unordered: DataFrame | None = None

    def _unlike(self, store: SnapshotStore, idents: tuple[str, str], files: list[DataFrame], rules: PathRules) -> list[DataFrame]:
        """Both sides' files in directories whose digests differ; empty without reading any if the scope's digests agree."""
        tables = [store.read(ident, "digests") for ident in idents]
        whole = [t.where(F.col("path") == self.path).select("all_a", "all_b", "all_files").first() for t in tables]
        if whole[0] == whole[1]:
            return [f.limit(0) for f in files]
        unlike = materialize(D.differing(*tables, self.path, rules))
        self.differing = unlike
        return [D.files_of(store.read_directories_of(ident, "files", unlike), unlike.where(F.col(rows) > 0), rows)
                for ident, rows in zip(idents, ("old_files", "new_files"))]

    def _placed(self) -> DataFrame:
        if self._stored is None:
            self._stored = placed(self._rows if self._unordered is None else self._unordered, [F.col("path")])
        return self._stored

    @property
    def rows(self) -> DataFrame:
        """All matching changes. The join runs on first use; its result is kept in the work folder, in path order."""
        return self._placed().drop("_seq")

    def counts(self) -> DataFrame:
        """One row of totals; they need no order and are counted straight from the join unless the rows are kept already."""
        kept = [rows for rows in (self._stored, self._unordered) if rows is not None]
        return C.change_counts(kept[0] if kept else self._rows)

    def _after(self, path: str) -> DataFrame:
        """The changes behind a path. Both sides are cut before they are joined."""
        if self._stored is not None:
            return self.rows.where(F.col("path") > path)
        return C.changes(*[f.where(F.col("path") > path) for f in self._files], *self._args)

    def page(self, offset: int = 0, limit: int = PAGE_ROWS, after: str | None = None) -> Page:
        """A page in path order. after takes the last path of the page before: only what follows it is joined, and the
        top of it kept. A jump by offset writes all rows in order, once, and then costs the same at any depth."""
        try:
            check_page(offset, limit)
        except ValueError as error:
            raise ComparisonError(str(error)) from None
        meta = self.counts().select(
            "*", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"),
            (F.lit(offset + limit) < F.col("total")).alias("has_more"),
            F.lit(self.coverage_complete).alias("coverage_complete"))
        if after is None:
            return Page(placed_slice(self._placed(), offset, limit), meta)
        return Page(ordered_slice(self._after(after), [F.col("path")], offset, limit), meta)

    def last_page(self, limit: int = PAGE_ROWS) -> Page:
        """The last rows in path order. The join runs once and its rows are kept; only the far end of them is sorted."""
        try:
            check_page(0, limit)
        except ValueError as error:
            raise ComparisonError(str(error)) from None
        if self._stored is None and self._unordered is None:
            self._unordered = materialize(self._rows)
        rows = self.rows if self._stored is not None else self._unordered
        counts = C.change_counts(rows)
        meta = counts.select(
            "*", F.greatest(F.col("total") - limit, F.lit(0)).alias("offset"), F.lit(limit).alias("limit"),
            F.lit(False).alias("has_more"), F.lit(self.coverage_complete).alias("coverage_complete"))
        return Page(last_rows(rows, ["path"], limit), meta)

    def export_rows(self) -> DataFrame:
        """Every change with both coverage flags, as the CSV has them."""
        return self.rows.select(
            "*", F.lit(bool(self.baseline["coverage_complete"])).alias("baseline_coverage_complete"),
            F.lit(bool(self.current["coverage_complete"])).alias("current_coverage_complete"))


def _header(store: SnapshotStore, ident: str):
    try:
        row = store.summary(ident).select("root", "details_complete", *_HEADER).first()
    except KeyError:
        raise ComparisonError(f"scan {ident} is unknown or was not finished") from None
    if row is None:
        raise ComparisonError(f"scan {ident} was not finished")
    if not row["details_complete"]:
        raise ComparisonError(f"scan {ident} did not keep every observed file")
    return row
