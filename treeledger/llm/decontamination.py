"""Passages of a benchmark in training texts."""

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.batches import covered, filtered, place_of, slices, with_results
from treeledger.operators.joins import lookup_join

WINDOW = 10
BLOCK_BYTES = 16 << 20  # benchmark text that one broadcast may carry

# Upper case becomes lower case, and what is neither digit, letter nor beyond ASCII a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


class Table(NamedTuple):
    """Windows of one length: ascending hashes, the word numbers of each, and its owners from bounds[i] to bounds[i + 1]."""
    hashes: np.ndarray
    windows: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray


class Windows(NamedTuple):
    """Word windows of a block of items: word numbers from 1, names of items, and a table per window length."""
    numbers: dict[bytes, int]
    names: list[str]
    tables: list[tuple]


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = out * FACTOR + ids[at + i].astype(np.uint64)
    return out


def windows_of(items: list[tuple], size: int = WINDOW) -> Windows:
    """The windows of (item_id, text) rows; an item shorter than a window is one window itself.

    A window takes about 60 bytes, so a block of 16 MB some 150 MB with its words.
    """
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    ids = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in plain_words(text)], np.int32) for _, text in items]
    lengths = np.array([len(own) for own in ids], np.int64)
    owner = np.array([-1 if item is None else names.setdefault(str(item), len(names)) for item, _ in items], np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    first = np.cumsum(lengths) - lengths
    tables = []
    for n in np.unique(np.minimum(lengths[lengths > 0], size)).tolist():
        mine = np.flatnonzero(np.minimum(lengths, size) == n)
        times = lengths[mine] - n + 1
        at = np.repeat(first[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        tables.append(tuple(_table(flat, at, np.repeat(owner[mine], times), n)))
    return Windows(numbers, list(names), tables)


def _table(flat: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> Table:
    """Distinct windows of n words in the order of hash and words, with their distinct owners."""
    hashes = window_hashes(flat, at, n)
    order = np.lexsort((owner, *(flat[at + i] for i in reversed(range(n))), hashes))
    hashes, at, owner = hashes[order], at[order], owner[order]
    windows = flat[at[:, None] + np.arange(n)]
    new = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
    listed = (owner >= 0) & (new | np.r_[True, owner[1:] != owner[:-1]])
    starts = np.flatnonzero(new)
    bounds = np.r_[0, np.cumsum(listed)][np.r_[starts, len(new)]]
    return Table(hashes[starts], windows[starts], bounds, owner[listed])


def find(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
    """Hit places in word numbers, and the items of each window found with its place.

    Number 0 is a word that no item has, so only stretches without it are hashed. A hash
    that is known is checked against the words of every window that has it.
    """
    places = np.arange(len(ids))
    following = np.minimum.accumulate(np.where(ids == 0, places, len(ids))[::-1])[::-1]
    free = following - places
    starts, ends, found = [], [], []
    for known, rows, bounds, owners in windows.tables:
        n = rows.shape[1]
        at = np.flatnonzero(free >= n)
        value = window_hashes(ids, at, n)
        slot = np.searchsorted(known, value)
        while len(at):
            held = slot < len(known)
            held[held] = known[slot[held]] == value[held]
            at, value, slot = at[held], value[held], slot[held]
            same = (rows[slot] == ids[at[:, None] + np.arange(n)]).all(axis=1)
            starts.append(at[same])
            ends.append(at[same] + n)
            for start, a, b in zip(at[same].tolist(), bounds[slot[same]].tolist(), bounds[slot[same] + 1].tolist()):
                found.append((start, [windows.names[i] for i in owners[a:b].tolist()]))
            at, value, slot = at[~same], value[~same], slot[~same] + 1  # another window with this hash
    none = [np.empty(0, np.int64)]
    return covered(np.concatenate(none + starts), np.concatenate(none + ends), len(ids)), found


def blocks_of(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's distinct rows in lists of about half `limit` bytes, dealt by hash once they exceed it in sum.

    The number of blocks follows from a count, so the driver never holds more than one.
    """
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"].encode()) for r in part.toLocalIterator()]


RESULT = "n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"


def spans_in(docs: DataFrame, shared, text: str, keep: list[str] | None) -> DataFrame:
    """Documents with n_words, the hit word spans and the items found, for one broadcast block."""
    def compute(texts: pa.Array):
        windows = Windows(*shared.value)
        n_words, spans_of, items_of = [], [], []
        for part in slices(texts):
            words = [plain_words(raw) for raw in part]
            sizes = np.array([len(w) + 1 for w in words])
            starts = np.cumsum(sizes) - sizes
            spans, items = [[] for _ in words], [set() for _ in words]
            ids = np.zeros(sizes.sum(), np.int64)
            for start, own in zip(starts, words):
                ids[start:start + len(own)] = np.fromiter(map(windows.numbers.get, own, repeat(0)), np.int64, len(own))
            hit, found = find(ids, windows)
            for place, names in found:
                items[np.searchsorted(starts, place, "right") - 1].update(names)
            edges = np.flatnonzero(np.diff(np.r_[False, hit, False]))
            owner = np.searchsorted(starts, edges[::2], "right") - 1
            for i, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
                spans[i].append({"start": a - int(starts[i]), "end": b - int(starts[i])})
            n_words += [len(w) for w in words]
            spans_of += spans
            items_of += [sorted(names) for names in items]
        return n_words, spans_of, items_of

    return with_results(docs, [text], RESULT, compute, keep)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         keep: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with n_words, hit_spans (of words), items (ids as sorted strings) and contaminated.

    The benchmark is broadcast in blocks of checked size. Up to `block_bytes` it is one block
    and the texts are scanned once. A larger one takes a scan for each block, whose hits are
    brought together by the hash of the text; no task ever holds more than one block. A null
    text has no words; an item without words has no window; an item with a null id hits but
    is not listed. Spans are unions of hits.
    """
    context = docs.sparkSession.sparkContext
    blocks = (context.broadcast(tuple(windows_of(block, size))) for block in blocks_of(benchmark, item_id, item_text, block_bytes))
    shared = list(blocks)
    if len(shared) == 1:
        found = spans_in(docs, shared[0], text, keep)
    else:
        found = _spans_by_text(docs, shared, text, keep)
    return found.withColumn("contaminated", F.size("hit_spans") > 0)


def _spans_by_text(docs: DataFrame, shared: list, text: str, keep: list[str] | None) -> DataFrame:
    # Columns go by their places until the end, so that no name clashes with those used here.
    names = [f"_own{i}" for i in range(len(docs.columns))]
    placed, whole = docs.toDF(*names), names[place_of(docs, text)]
    key = F.sha2(whole, 256).alias("_text")
    hits = None
    for block in shared:
        own = spans_in(placed.select(key, whole), block, whole, ["_text"]).where(F.size("hit_spans") > 0)
        own = own.dropDuplicates(["_text"])
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy("_text").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    keyed = placed.select("*", key, F.monotonically_increasing_id().alias("_spread"))
    joined = lookup_join(keyed, hits, ["_text"], "left", ["_spread"])

    def merge(texts: pa.Array, spans: pa.Array, items: pa.Array):
        n_words, merged = [], []
        for part in slices(texts):
            for raw in part:
                n = len(plain_words(raw))
                own = spans[len(n_words)].as_py() or []
                hit = covered(np.array([s["start"] for s in own], np.int64), np.array([s["end"] for s in own], np.int64), n)
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
                merged.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                n_words.append(n)
        return n_words, merged, [names or [] for names in items.to_pylist()]

    kept = docs.columns if keep is None else keep
    merged = with_results(joined, [whole, "_spans", "_items"], RESULT, merge, [names[place_of(docs, name)] for name in kept])
    results = merged.columns[len(kept):]
    kept = [(names[place_of(docs, name)], name) for name in kept if name.lower() not in {r.lower() for r in results}]
    return merged.select(*[F.col(own).alias(name) for own, name in kept], *results)


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items and items_sha256 in place of spans and items."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda sum_, s: sum_ + s["end"] - s["start"])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("hit_spans", "items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    return filtered(docs, text, lambda renamed, name: scan(renamed, benchmark, name), "NOT contaminated")
