"""Near-duplicates by SimHash fingerprints, compared exactly in tiles of equal population counts."""

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results
from treeledger.llm.components import linked_components
from treeledger.operators.joins import lookup_join
from treeledger.sources.workspace import materialize

SEED, SHINGLE, RADIUS = 42, 3, 2
PIECE = 1 << 15  # shingles whose bits are unpacked at once
TILE_ROWS = 2048
QUARTERS = (48, 32, 16, 0)
HEAVY_ROWS = 1_000  # a fingerprint of more documents than this may be cut into slices


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words, or of all words where there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [words[i:] for i in range(min(size, len(words)))]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts)), repeat(seed)), np.uint64,
                       len(parts[-1]))


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Per text the bits that are set in over half of its shingle hashes, as signed 64-bit numbers."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting: list[tuple[int, np.ndarray]] = []

    def add():
        if waiting:
            hashes = np.concatenate([h for _, h in waiting])
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lengths = np.array([len(h) for _, h in waiting])
            sums = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int32)
            np.add.at(counts, [i for i, _ in waiting], sums)
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        sizes[i] = len(hashes)
        for at in range(0, len(hashes), PIECE):
            waiting.append((i, hashes[at:at + PIECE]))
            held += len(waiting[-1][1])
            if held >= PIECE:
                add()
                held = 0
    add()
    majority = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                     name: str = "fingerprint") -> DataFrame:
    """Documents with a 64-bit fingerprint; a text without words, or null, has fingerprint zero."""
    def compute(texts: pa.Array):
        return [[value for part in slices(texts) for value in fingerprints(part).tolist()]]

    return with_results(docs, [text], f"`{name}` long", compute, keep)


def close_pairs(left: np.ndarray, right: np.ndarray, same: bool, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between two tiles, reduced to a forest that connects the same fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept, band = [], max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), band):
        near = np.bitwise_count(left[at:at + band, None] ^ right[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i += at
            if same and i >= j:
                continue
            a, b = root(i), root(j if same else -1 - j)
            if a != b:
                parent[a] = b
                kept.append((int(left[i]), int(right[j])))
    return kept


def _tile(counts: list) -> "F.Column":
    """Number of the tile whose members have these population counts in their four 16-bit quarters."""
    out = F.lit(0)
    for c in counts:
        out = out * 17 + c
    return out.cast("int")


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, within `radius` bits or connected by such pairs.

    prints holds distinct fingerprints. Two of them cannot be within the radius if the
    population counts of their quarters differ by more than that in sum, so a tile meets
    only the tiles around it. There are at most 17^4 tiles, so their sizes may be broadcast.
    Large tiles are cut into blocks by hash; each pair of blocks is one row, compared whole.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fingerprint", shift).bitwiseAND(0xFFFF)) for shift in QUARTERS]
    tiled = prints.select("fingerprint", *[q.alias(f"q{i}") for i, q in enumerate(quarters)])
    tiled = tiled.withColumn("tile", _tile([F.col(f"q{i}") for i in range(4)]))
    blocks = materialize(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("blocks")))
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    cells = (tiled.join(F.broadcast(blocks), "tile").withColumn("block", block)
             .groupBy("tile", "q0", "q1", "q2", "q3", "block").agg(F.collect_list("fingerprint").alias("members")))
    cells = materialize(cells)
    shifts = [d for d in itertools.product(range(-radius, radius + 1), repeat=4)
              if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    around = F.array(*[F.struct(F.lit(d == (0, 0, 0, 0)).alias("same"), _tile([F.col(f"q{i}") + d[i] for i in range(4)])
                                .alias("to"), *[(F.col(f"q{i}") + d[i]).alias(f"to{i}") for i in range(4)])
                       for d in shifts])
    inside = " AND ".join(f"shift.to{i} BETWEEN 0 AND 16" for i in range(4))
    left = cells.withColumn("shift", F.explode(around)).where(inside)
    left = left.select("members", "block", "shift.same", F.col("shift.to").alias("tile"))
    left = left.join(F.broadcast(blocks), "tile")
    first = F.when(F.col("same"), F.col("block")).otherwise(F.lit(0).cast("bigint"))
    left = left.withColumn("other", F.explode(F.sequence(first, F.col("blocks") - 1)))
    left = left.select("tile", F.col("other").alias("block"), F.col("members").alias("ours"),
                       (F.col("same") & (F.col("block") == F.col("other"))).alias("same"))
    pairs = left.join(cells.select("tile", "block", "members"), ["tile", "block"])

    def compare(batches):
        for batch in batches:
            found = []
            for ours, theirs, same in zip(*(batch.column(c) for c in ("ours", "members", "same"))):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (ours, theirs))
                if not same.as_py() or len(a) > 1:
                    found += close_pairs(a, b, same.as_py(), radius)
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found) if found else ([], [])))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.select("ours", "members", "same").mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The class of every fingerprint: fingerprint, leader, component_id.

    prints is (fingerprint, first_id), one row per fingerprint with the smallest id of its
    documents. component_id is the smallest id in the class (null if all are null), leader
    the smallest fingerprint among those whose first_id that is.
    """
    prints = materialize(prints)
    roots = linked_components(links(prints.select("fingerprint"), radius))
    joined = prints.join(roots.withColumnsRenamed({"node": "fingerprint"}), "fingerprint", "left")
    joined = materialize(joined.withColumn("root", F.coalesce("root", "fingerprint")))
    # Nulls go last: (is null, id, fingerprint) has its least value at the leader.
    least = F.min(F.struct(F.col("first_id").isNull(), "first_id", "fingerprint")).alias("least")
    heads = joined.groupBy("root").agg(least)
    heads = heads.select("root", F.col("least.fingerprint").alias("leader"), F.col("least.first_id").alias("component_id"))
    counts = joined.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
    return lookup_join(joined, heads, ["root"], "inner", ["fingerprint"], counts, at_least=HEAVY_ROWS).select(
        "fingerprint", "leader", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Copies share a fingerprint and are compared as one, so no group is ever expanded. Rows
    with a null id take part but give no component_id unless their whole class has none.
    """
    marked = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    marked = materialize(marked)
    groups = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"),
                                                           F.count(F.lit(1)).alias("_rows")))
    found = classes(groups.select("fingerprint", "first_id"), radius).select("fingerprint", "component_id")
    joined = lookup_join(marked, found, ["fingerprint"], "inner", ["doc_id"],
                         groups.select("fingerprint", "_rows"), at_least=HEAVY_ROWS)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each class: the one with the smallest id. Of rows that repeat its id and fingerprint, one stays.

    Whole rows are moved once: repeated ones are dropped by fingerprint and id, beginning
    in the tasks that read them, and the leaders are matched where the rest then lies.
    """
    key = "_fingerprint"
    ids = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    marked = materialize(with_fingerprint(ids, "text", ["_id"], key))
    groups = marked.groupBy(F.col(key).alias("fingerprint")).agg(F.min("_id").alias("first_id"))
    leaders = classes(groups, radius).where(F.col("fingerprint") == F.col("leader"))

    def named(print_: str, ident: str) -> list:
        return [F.col(print_).alias("_print"), F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("_name"),
                F.col(ident).isNull().alias("_unnamed")]

    keys = ["_print", "_name", "_unnamed"]
    names = [f"_own{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    whole = with_fingerprint(docs.toDF(*names), own[text], None, key)
    single = whole.select(*names, *named(key, own[doc_id])).dropDuplicates(keys)
    kept = single.join(leaders.select(*named("leader", "component_id")), keys, "left_semi")
    return kept.select(*[F.col(name).alias(column) for column, name in own.items()])
