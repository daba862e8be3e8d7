"""One object with every question a user can ask about stored snapshots."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.functions.text import contains_text
from treeledger.operators import browse as B
from treeledger.operators import cleanup as K
from treeledger.operators import journal as J
from treeledger.operators.paging import Page, indexed_slice, write_index
from treeledger.operators.rollup import rank_extensions
from treeledger.operators.search_index import files_that_may_hold, write_search_index
from treeledger.plans import report
from treeledger.plans.comparison import Comparison
from treeledger.plans.duplicates import DuplicateReview, find_duplicates
from treeledger.plans.refresh import refresh
from treeledger.plans.snapshot import build_snapshot
from treeledger.schema import PAGE_ROWS, QUARANTINE_NAME
from treeledger.sources.content import digest_files
from treeledger.sources.store import SnapshotStore, default_pair


@dataclass(frozen=True)
class CleanupPlan:
    """A verdict per selected id, and the journal rows to append if all are ok."""

    verdicts: DataFrame
    moves: DataFrame


class Ledger:
    """Snapshots below a folder. Tables come back as DataFrames, one-row facts as dicts."""

    def __init__(self, spark: SparkSession, root: str, rules: PathRules = POSIX):
        self.store = SnapshotStore(spark, root)
        self.rules = rules

    def scan(self, scan_id: str, listing: DataFrame, root: str, now: float, **options) -> dict:
        """Store a listing as a snapshot; options are those of build_snapshot."""
        return build_snapshot(self.store, scan_id, listing, root, now, rules=self.rules, **options).first().asDict(True)

    def refresh(self, baseline: str, selected: str, target: str, listing: DataFrame, **options) -> dict:
        """Store baseline with one subtree observed again; options are those of refresh."""
        return refresh(self.store, baseline, selected, target, listing, rules=self.rules, **options).first().asDict(True)

    def _root(self, scan_id: str) -> str:
        return self.store.summary(scan_id).first()["root"]

    def scans(self) -> DataFrame:
        return self.store.catalog()

    def default_pair(self) -> DataFrame:
        return default_pair(self.store.catalog())

    def summary(self, scan_id: str) -> dict:
        return self.store.summary(scan_id).first().asDict(True)

    def extensions(self, scan_id: str) -> DataFrame:
        """The whole extension ranking."""
        return rank_extensions(self.store.read(scan_id, "extensions"))

    def browse(self, scan_id: str, selected: str = "", query: str = "", offset: int = 0, limit: int = PAGE_ROWS,
               recursive: bool = False, sort: str = "size", after: dict | None = None) -> Page:
        """A page of a directory, or of the whole snapshot with recursive."""
        directories = self.store.read(scan_id, "directories")
        root = self._root(scan_id)
        if directories.where(F.col("path") == (selected or root)).isEmpty():
            raise KeyError(selected)
        page = B.browse(self.store.read(scan_id, "files"), directories, root, selected, query, offset, limit,
                        recursive, sort, after, self.rules)
        indexed = self._pages(scan_id, sort)
        if recursive and not query and after is None and self.store.exists(f"{indexed}/places/_SUCCESS"):
            page = Page(indexed_slice(self.store.spark, indexed, offset, limit), page.meta)
        whole = self.store.summary(scan_id).select("details_complete").scalar()
        return Page(page.items, page.meta.withColumn("details_complete", whole))

    def _pages(self, scan_id: str, sort: str) -> str:
        return f"{self.store.root}/pages/scan_id={scan_id}/{sort}"

    def index_pages(self, scan_id: str, sorts: tuple[str, ...] = ("size", "allocated", "name", "modified")) -> None:
        """Keep all files of a snapshot in these orders, so that a jump to any place in the whole of it reads one data file."""
        files = B.entries(self.store.read(scan_id, "files"), self.store.read(scan_id, "directories"), "", recursive=True)
        for sort in sorts:
            write_index(files, B.sort_order(sort), self._pages(scan_id, sort))

    def index_search(self, scan_id: str) -> None:
        """Keep what search needs to open only data files that may hold a text."""
        write_search_index(self.store.read(scan_id, "files"), f"{self.store.root}/search/scan_id={scan_id}")

    def search(self, scan_id: str, query: str) -> DataFrame:
        """All files whose path contains a text, A-Z as a-z; with index_search, from the data files that may have some."""
        folder, names = f"{self.store.root}/search/scan_id={scan_id}", None
        files = self.store.read(scan_id, "files")
        if self.store.exists(f"{folder}/_SUCCESS"):
            names = files_that_may_hold(self.store.spark, folder, query)
        if names is not None:
            files = self.store.data_files("files", [r["file"] for r in names.collect()])
        return files.where(contains_text(F.col("path"), query))

    def errors(self, scan_id: str, offset: int = 0, after: dict | None = None) -> Page:
        return B.error_page(self.store.read(scan_id, "errors"), offset, after)

    def discard(self, scan_id: str) -> None:
        """Free the id of a scan that was never published."""
        self.store.discard(scan_id)

    def compare(self, baseline: str, current: str, selected: str = "", query: str = "",
                kind: str = "all", bucketed: tuple[str, str] | None = None, digests: bool = False) -> Comparison:
        """bucketed: the tables that store.bucket made of both snapshots, for a join that moves no row.

        digests: look only into directories whose digests differ, worth it where most are equal.
        """
        return Comparison(self.store, baseline, current, selected, query, kind, self.rules, bucketed, digests)

    def duplicates(self, scan_id: str, digest=digest_files, observed: DataFrame | None = None,
                   budget: int | None = None, max_bytes: int | None = None,
                   links: DataFrame | None = None) -> DuplicateReview:
        """Files of equal content; budget and max_bytes bound what is read, and meta says what they left out."""
        return find_duplicates(self.store.read(scan_id, "files"), digest, observed, budget, max_bytes,
                               links=links, top=self._root(scan_id), rules=self.rules)

    def candidates(self, scan_id: str) -> DataFrame:
        """Every file of the scan that qualified for cleanup."""
        return self.store.read(scan_id, "candidates")

    def plan_cleanup(self, scan_id: str, selection: DataFrame, fresh: DataFrame, moves: DataFrame, now: float,
                     temp_roots: list[str], batch: str, quarantine: str = QUARANTINE_NAME,
                     links: DataFrame | None = None) -> CleanupPlan:
        """Check selected candidates (a table of ids) of a scan against a fresh files table.

        The plan is empty when any of them fails or the quota would be passed.
        """
        verdicts = K.revalidate(selection.select("id"), self.candidates(scan_id), fresh, now, temp_roots, quarantine, self.rules,
                                links, self._root(scan_id))
        return CleanupPlan(verdicts, K.selection_plan(verdicts, moves, now, batch))

    def reconcile(self, moves: DataFrame, present: DataFrame) -> DataFrame:
        """Journal with new_state, from what lies at both ends of every move."""
        return J.reconcile(J.presence(moves, present))

    def restore_batch(self, moves: DataFrame, present: DataFrame, batch: str, temp_roots: list[str],
                      links: DataFrame | None = None, top: str = "/") -> DataFrame:
        """links: the paths of links below top; a move with one on the way to either end is unsafe."""
        plan = J.batch_plan(moves, batch)
        linked = None if links is None else J.linked_moves(plan, links, top, rules=self.rules)
        return J.restore_verdict(J.presence(plan, present), temp_roots, linked, self.rules)

    def purge(self, moves: DataFrame, present: DataFrame, temp_roots: list[str], quarantine: str = QUARANTINE_NAME,
              links: DataFrame | None = None, top: str = "/") -> DataFrame:
        """links: the paths of links below top; a move with one on the way to its destination is unsafe."""
        linked = None if links is None else J.linked_moves(moves, links, top, ("destination",), self.rules)
        return J.purge_verdict(J.presence(moves, present), temp_roots, quarantine, linked, self.rules)

    def export_inventory(self, scan_id: str, folder: str) -> None:
        report.write_csv(report.inventory_lines(self.store.read(scan_id, "files")), report.INVENTORY_HEADER, folder)

    def export_comparison(self, comparison: Comparison, folder: str) -> None:
        lines = report.comparison_lines(comparison.export_rows())
        report.write_csv(lines, report.COMPARISON_HEADER, folder)

    def report(self, scan_id: str) -> DataFrame:
        """JSON records (part, report): the summary, and one for each extension and each candidate."""
        return report.whole_report(self.store.summary(scan_id), self.extensions(scan_id), self.candidates(scan_id))

    def share_summary(self, scan_id: str, include_paths: bool = False) -> dict:
        rows = report.share_summary(self.store.summary(scan_id), self.store.read(scan_id, "extensions"), include_paths)
        return rows.first().asDict(True)
