"""The quarantine journal against what storage shows. Nothing is ever moved."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import POSIX, PathRules
from treeledger.operators.joins import path_join
from treeledger.operators.paging import ordered_slice
from treeledger.operators.links import ids_under
from treeledger.schema import PAGE_ROWS, QUARANTINE_NAME, RESTORABLE_STATES


def presence(moves: DataFrame, present: DataFrame) -> DataFrame:
    """Journal rows with what lies at both ends now.

    present: (path, fingerprint, device, inode), path unique; id is unique in moves. A
    move without a match at one end has nulls there.

    The ends of all moves are looked up together, so present is read once and may stay
    where it is: an inner join can broadcast the ends if Spark measures them as small.
    What was found, at most two rows a move, is then brought to the moves by id.
    """
    facts, marks = ("fingerprint", "device", "inode"), ("source", "destination")
    ends = moves.select("id", F.explode(F.create_map(*[
        part for mark in marks for part in (F.lit(mark), F.col(mark))])).alias("_end", "path"))
    found = path_join(present.select("path", *facts), ends.where(F.col("path").isNotNull()), "inner")
    there = found.groupBy("id").agg(*[
        F.max(F.when(F.col("_end") == mark, F.struct(*facts))).alias(f"_{mark}") for mark in marks])
    return moves.join(there, "id", "left").select(
        *moves.columns, *[F.col(f"_{mark}.{c}").alias(f"{mark}_{c}") for mark in marks for c in facts])


def current(log: DataFrame, version: str = "version") -> DataFrame:
    """The newest row per id of an append-only journal; version grows with every change of a row."""
    columns = [c for c in log.columns if c not in ("id", version)]
    newest = F.max(F.struct(version, *columns)).alias("row")
    return log.groupBy("id").agg(newest).select("id", *[F.col(f"row.{c}").alias(c) for c in columns])


def transitions(reconciled: DataFrame) -> DataFrame:
    """Rows whose state the reconciliation changed, ready to be appended to the journal."""
    changed = reconciled.where(F.col("state") != F.col("new_state"))
    return changed.select("id", "source", "destination", "size", "fingerprint",
                          F.col("new_state").alias("state"), "created", "batch")


def reconcile(checked: DataFrame) -> DataFrame:
    """New state of every journal row after an interruption; settled states stay."""
    state = F.col("state")
    source, destination = F.col("source_fingerprint").isNotNull(), F.col("destination_fingerprint").isNotNull()
    same = F.col("source_fingerprint") == F.col("fingerprint")
    new = (F.when((state == "pending") & ~source & destination, "quarantined")
           .when((state == "pending") & source & ~destination, "failed")
           .when((state == "restoring") & source & ~destination & same, "restored")
           .when((state == "purging") & destination, "quarantined")
           .when(state == "purging", "purged")
           .otherwise(state))
    return checked.withColumn("new_state", new)


def history_page(moves: DataFrame, offset: int = 0) -> DataFrame:
    return ordered_slice(moves, [F.desc("created"), F.asc("id")], offset, PAGE_ROWS)


def batch_plan(moves: DataFrame, batch: str | None = None) -> DataFrame:
    """Rows of a batch (or of all batches) that a restore would try."""
    open_rows = moves.where(F.col("state").isin(*RESTORABLE_STATES))
    return open_rows if batch is None else open_rows.where(F.col("batch") == batch)


def _in_one_root(destination: Column, source: Column, roots: list[str], rules: PathRules) -> Column:
    """Some root holds both the destination and the directory of the source."""
    test = F.lit(False)
    for root in roots:
        test = test | (rules.inside(destination, root) & rules.inside(rules.parent(source), root))
    return test


def linked_moves(moves: DataFrame, links: DataFrame, top: str, ends: tuple[str, ...] = ("source", "destination"),
                 rules: PathRules = POSIX) -> DataFrame:
    """Ids of moves with a link (from a listing of links below top) on the way to one of their ends."""
    return ids_under(moves, list(ends), links, top, rules)


def _mark_linked(checked: DataFrame, linked: DataFrame | None) -> DataFrame:
    if linked is None:
        return checked.withColumn("_linked", F.lit(False))
    marks = linked.select("id", F.lit(True).alias("_linked"))
    return checked.join(marks, "id", "left").withColumn("_linked", F.col("_linked").isNotNull())


def restore_verdict(checked: DataFrame, roots: list[str], linked: DataFrame | None = None,
                    rules: PathRules = POSIX) -> DataFrame:
    """Why a restore would be refused, or ok.

    linked holds the ids of moves with a link on either way down (one id each).
    """
    checked = _mark_linked(checked, linked)
    state = F.col("state")
    source, destination = F.col("source_fingerprint").isNotNull(), F.col("destination_fingerprint").isNotNull()
    same_file = ((F.col("source_device") == F.col("destination_device"))
                 & (F.col("source_inode") == F.col("destination_inode")))
    safe = destination & _in_one_root(F.col("destination"), F.col("source"), roots, rules) & ~F.col("_linked")
    verdict = (F.when(~state.isin(*RESTORABLE_STATES), "not_in_quarantine")
               .when(source & (state != "restoring"), "source_occupied")
               .when(~safe, "unsafe_path")
               .when(F.col("destination_fingerprint") != F.col("fingerprint"), "changed")
               .when(source & ~same_file, "conflict")
               .otherwise("ok"))
    return checked.select("id", "batch", "state", verdict.alias("verdict"))


def purge_verdict(checked: DataFrame, roots: list[str], quarantine: str = QUARANTINE_NAME,
                  linked: DataFrame | None = None, rules: PathRules = POSIX) -> DataFrame:
    """Why a purge would be refused, or ok, with the bytes it would release."""
    checked = _mark_linked(checked, linked)
    folders = [rules.prefix(root) + quarantine for root in roots]
    direct = rules.parent(F.col("destination")).isin(*folders)
    safe = F.col("destination_fingerprint").isNotNull() & direct & ~F.col("_linked")
    verdict = (F.when(F.col("state") != "quarantined", "not_in_quarantine")
               .when(~safe, "unsafe_path")
               .when(F.col("destination_fingerprint") != F.col("fingerprint"), "changed")
               .otherwise("ok"))
    return checked.select("id", "state", verdict.alias("verdict"),
                          F.when(verdict == "ok", F.col("size")).otherwise(F.lit(0)).alias("released_bytes"))
