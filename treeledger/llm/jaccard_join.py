"""Similarity join of word n-gram sets by PartEnum signatures, with exact verification."""

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results
from treeledger.llm.components import linked_components
from treeledger.llm.simhash import shingle_hashes
from treeledger.operators.joins import heavy_keys, lookup_join
from treeledger.sources.workspace import materialize

PERCENT, SHINGLE = 90, 3
HEAVY_ROWS = 1_000  # a key of more rows than this may be cut into slices
BLOCK = 1 << 18  # shingles in a block of sets that are compared with another block
FLOATS = 1 << 22  # numbers in a dense table of sets against shingles
KEYS = "key1 long, key2 long, n_shingles long"


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, size))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from every other one."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def band_of(size: int, percent: int = PERCENT) -> tuple[int, int]:
    """Number and largest size of the band that holds sets of this size; similar sets lie in the same or the next one."""
    band, low = 0, 1
    while (high := 100 * low // percent) < size:
        band, low = band + 1, high + 1
    return band, high


def scheme(largest: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """First-level parts, second-level parts in each, and of these how many may differ, for sets of at most `largest`.

    Two similar sets differ in at most k elements. Of n1 first-level parts one then differs in
    at most k // n1 of them, so that at least n2 - k // n1 of its n2 second-level parts are equal.
    """
    k = 2 * largest * (100 - percent) // (100 + percent)
    n1 = (k + 2) // 2
    spoiled = k // n1
    return n1, spoiled + 2 if spoiled else 1, spoiled


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set: for its own band and the next, each first-level part with each choice of second-level parts.

    A signature stands for the elements that lie in the chosen parts: the sum of their
    scrambled hashes, scrambled with the band, the part and the choice. Equal elements give
    equal signatures; unequal ones may do so by chance, which verification mends.
    """
    if not len(shingles):
        return np.empty(0, np.int64)
    found = []
    band, high = band_of(len(shingles), percent)
    for number, largest in ((band, high), (band + 1, 100 * (high + 1) // percent)):
        n1, n2, spoiled = scheme(largest, percent)
        place = _mix(shingles, 1 + 2 * number)
        first = ((place >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
        second = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
        cells = np.zeros((n1, n2), np.uint64)
        np.add.at(cells, (first.astype(np.int64), second.astype(np.int64)), _mix(shingles, 2 + 2 * number))
        parts = np.arange(n1, dtype=np.uint64)
        for i, chosen in enumerate(combinations(range(n2), n2 - spoiled)):
            total = cells[:, list(chosen)].sum(axis=1, dtype=np.uint64)
            found.append(_mix(total + _mix(parts, 1 + (number * 64 + i)), 3))
    return np.concatenate(found).view(np.int64)


def _keys(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for text in texts:
        shingles = shingle_set(text, size)
        yield *set_key(shingles), shingles


def with_keys(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key1, key2, n_shingles."""
    def compute(texts: pa.Array):
        rows = [(a, b, len(s)) for part in slices(texts) for a, b, s in _keys(part, size)]
        return list(zip(*rows)) if rows else [[], [], []]

    return with_results(docs, ["text"], KEYS, compute, ["doc_id"])


def with_signatures(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, key1, key2, sigs."""
    def compute(texts: pa.Array):
        rows = [(a, b, signatures(s, percent)) for part in slices(texts) for a, b, s in _keys(part, size)]
        return list(zip(*rows)) if rows else [[], [], []]

    return with_results(docs, ["text"], "key1 long, key2 long, sigs array<long>", compute, ["doc_id"])


def with_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key1, key2, shingles."""
    def compute(texts: pa.Array):
        rows = [(a, b, s.view(np.int64)) for part in slices(texts) for a, b, s in _keys(part, size)]
        return list(zip(*rows)) if rows else [[], [], []]

    return with_results(docs, ["text"], "key1 long, key2 long, shingles array<long>", compute, [])


def candidate_pairs(signed: DataFrame, hot: DataFrame) -> DataFrame:
    """Stars of sets that share a signature: (p1, p2) the least key of a signature, (key1, key2) another one's.

    Every set goes to its signatures once. A signature of the table hot (sig, _slices) is
    cut into slices by set; the least keys of its slices then make a star of their own.
    """
    rows = signed.select("key1", "key2", F.explode("sigs").alias("sig"))
    order = ["key1", "key2"]

    def star(least: Column, table: DataFrame) -> DataFrame:
        return table.select(least["key1"].alias("p1"), least["key2"].alias("p2"), *order)

    if hot.isEmpty():
        window = Window.partitionBy("sig").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        pairs = star(F.col("least"), rows.select(*order, F.first(F.struct(*order)).over(window).alias("least")))
    else:
        salt = F.pmod(F.xxhash64("key1"), F.coalesce("_slices", F.lit(1).cast("bigint"))).alias("slice")
        cut = rows.join(F.broadcast(hot), "sig", "left").select("sig", salt, *order)
        window = Window.partitionBy("sig", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        pairs = star(F.col("least"), cut.select(*order, F.first(F.struct(*order)).over(window).alias("least")))
        heads = rows.join(F.broadcast(hot), "sig").select("sig", salt, *order)
        heads = heads.groupBy("sig", "slice").agg(F.min(F.struct(*order)).alias("head"))
        heads = heads.select("head.*", F.min("head").over(Window.partitionBy("sig")).alias("least"))
        pairs = pairs.unionByName(star(F.col("least"), heads))
    return pairs.where("p1 != key1 OR p2 != key2").distinct()


def hot_signatures(docs: DataFrame, percent: int, size: int, at_least: int, one_of: int = 64) -> DataFrame:
    """Signatures of very many texts, with the number of slices for each; found among one text of 64, by hash.

    What is found decides how work is spread and nothing else. There are fewer of them than
    the 4,096 slices of heavy_keys, which bounds their broadcast.
    """
    some = with_signatures(docs.where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0), percent, size)
    counts = some.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("_rows"))
    return heavy_keys(materialize(counts.where("_rows > 1")), ["sig"], at_least=max(1, at_least // one_of))


def similar(common, left, right, percent: int = PERCENT):
    """Whether sets of these sizes with so many common elements are similar enough."""
    return (100 + percent) * common >= percent * (left + right)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, at_least: int = HEAVY_ROWS) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; sets is (rep, shingles)."""
    counts = [materialize(pairs.groupBy(F.col(side).alias("rep")).agg(F.count(F.lit(1)).alias("_rows"))) for side in "ab"]
    rows = lookup_join(pairs.withColumn("rep", F.col("b")), sets, ["rep"], "inner", ["a"], counts[1], at_least=at_least)
    rows = rows.select(F.col("a").alias("rep"), "b", F.col("shingles").alias("theirs"))
    rows = lookup_join(rows, sets, ["rep"], "inner", ["b"], counts[0], at_least=at_least)
    common = F.size(F.array_intersect("shingles", "theirs"))
    return rows.where(similar(common, F.size("shingles"), F.size("theirs"), percent)).select(F.col("rep").alias("a"), "b")


def _groups(sizes: np.ndarray, limit: int) -> list[slice]:
    """Consecutive items in slices whose sizes add up to about the limit."""
    group = (np.cumsum(sizes) - sizes) // max(1, limit)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _table(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """One row per set, one column per word, one where the set has the word."""
    out = np.zeros((len(sets), len(words)), np.float32)
    for row, members in zip(out, sets):
        at = np.searchsorted(words, members)
        at[at == len(words)] = 0
        row[at[words[at] == members]] = 1
    return out


def block_links(left: list[tuple], right: list[tuple], same: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two lists of (rep, label, set), reduced to a forest that joins the same labels.

    Common elements of all sets of one side with all of the other are products of dense
    tables, made in pieces of bounded size over the words of the left piece. Sets with
    equal labels are known to belong together.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    sizes = [np.array([len(s) for _, _, s in side]) for side in (left, right)]
    for mine in _groups(sizes[0], 1 << 14):
        words = np.unique(np.concatenate([s for _, _, s in left[mine]]))
        ours = _table([s for _, _, s in left[mine]], words)
        rows = max(1, FLOATS // len(words))
        for at in range(mine.start if same else 0, len(right), rows):
            theirs = right[at:at + rows]
            common = ours @ _table([s for _, _, s in theirs], words).T
            hits = similar(common, sizes[0][mine, None], sizes[1][None, at:at + rows], percent)
            for i, j in zip(*(x.tolist() for x in np.nonzero(hits))):
                (a, one, _), (b, two, _) = left[mine.start + i], theirs[j]
                one, two = root(one), root(two)
                if one != two:
                    parent[one] = two
                    kept.append((a, b))
    return kept


def _blocks(rows: DataFrame, limit: int = BLOCK, at_least: int = HEAVY_ROWS) -> DataFrame:
    """Sets of open clusters with the block each is compared in, and pure, the label that all of a block's sets have, if so.

    A component that fills a block has blocks of its own; the others of a cluster share some.
    """
    one = F.lit(1).cast("bigint")
    labels = rows.groupBy("cluster", "label").agg(F.sum("n").alias("_n"))
    pooled = labels.groupBy("cluster").agg(F.sum(F.when(F.col("_n") <= limit, F.col("_n"))).alias("_pool"))
    labels = lookup_join(labels, pooled, ["cluster"], "inner", ["label"], at_least=at_least)
    big = F.col("_n") > limit
    labels = labels.select("cluster", "label", F.when(big, F.col("label")).alias("pure"),
                           F.greatest(one, F.ceil(F.when(big, F.col("_n")).otherwise(F.col("_pool")) / limit)).alias("_of"))
    cut = F.pmod(F.when(F.col("pure").isNotNull(), F.xxhash64("rep")).otherwise(F.xxhash64("label")), F.col("_of"))
    placed = rows.withColumn("_hash", F.xxhash64("cluster", "label")).join(
        labels.withColumn("_hash", F.xxhash64("cluster", "label")), ["_hash", "cluster", "label"])
    return placed.select("cluster", "pure", F.struct(F.coalesce("pure", F.lit(-1).cast("bigint")).alias("of"), cut.alias("cut")).alias("block"),
                         "rep", "label")


def cluster_links(open_sets: DataFrame, sets: DataFrame, percent: int = PERCENT, limit: int = BLOCK,
                  at_least: int = HEAVY_ROWS) -> DataFrame:
    """Links (a, b) across components inside clusters; open_sets is (rep, cluster, label, n).

    Block is compared with block, but for two blocks of one component. A task holds two
    blocks and the table of a piece of them.
    """
    placed = materialize(_blocks(open_sets, limit, at_least))
    keys = ["cluster", "pure", "block"]
    kinds = placed.select(*keys).distinct()
    known = F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False))
    pairs = kinds.join(kinds.select("cluster", F.col("pure").alias("other_pure"), F.col("block").alias("other")), "cluster")
    pairs = materialize(pairs.where((F.col("block") <= F.col("other")) & ~known).select("cluster", "block", "other"))
    cells = placed.join(sets, "rep").groupBy("cluster", "block").agg(
        F.collect_list(F.struct("rep", "label", "shingles")).alias("members"))
    cells = materialize(cells)
    work = pairs.join(cells.withColumnRenamed("members", "ours"), ["cluster", "block"])
    work = work.withColumn("same", F.col("block") == F.col("other")).drop("block").join(
        cells.withColumnsRenamed({"members": "theirs", "block": "other"}), ["cluster", "other"])

    def members(cell) -> list[tuple]:
        rows = cell.values
        ends = rows.field("shingles").offsets.to_numpy()
        values = rows.field("shingles").values.to_numpy()
        return [(a, b, values[i:j]) for a, b, i, j in zip(rows.field("rep").to_pylist(), rows.field("label").to_pylist(),
                                                           ends[:-1], ends[1:])]

    def compare(batches):
        for batch in batches:
            found = []
            for ours, theirs, same in zip(*(batch.column(c) for c in ("ours", "theirs", "same"))):
                found += block_links(members(ours), members(theirs), same.as_py(), percent)
            a, b = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work.select("ours", "theirs", "same").mapInArrow(compare, "a long, b long")


def _labelled(reps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Every rep with the least one of its component."""
    found = linked_components(links).select(F.col("node").alias("rep"), F.col("root").alias(name))
    return reps.join(found, "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def similar_classes(docs: DataFrame, keyed: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
                    block: int = BLOCK, at_least: int = HEAVY_ROWS) -> DataFrame:
    """Classes of the sets that have any candidate: key1, key2, root, first_id.

    keyed has one row per distinct set: key1, key2, first_id, n, _rows.
    """
    # Of a set that very many documents share one document is enough; which, does not matter.
    many = heavy_keys(keyed.select("key1", "key2", "_rows"), ["key1", "key2"], at_least=at_least)
    many = many.join(keyed.select("key1", "key2", "first_id"), ["key1", "key2"]).drop("_slices")
    signed = with_signatures(docs, percent, size).join(F.broadcast(many), ["key1", "key2"], "left")
    signed = signed.where(F.col("first_id").isNull() | (F.col("doc_id") == F.col("first_id")))
    hot = materialize(hot_signatures(docs, percent, size, 100 * at_least))
    pairs = materialize(candidate_pairs(signed, hot))

    ends = pairs.select(F.col("p1").alias("key1"), F.col("p2").alias("key2")).unionByName(pairs.select("key1", "key2")).distinct()
    reps = materialize(ends.join(keyed.drop("_rows"), ["key1", "key2"]).withColumn("rep", F.monotonically_increasing_id()))
    named = docs.where("doc_id IS NOT NULL").join(reps.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = named.unionByName(docs.where("doc_id IS NULL"))
    sets = with_sets(texts, size).groupBy("key1", "key2").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.join(reps.select("key1", "key2", "rep"), ["key1", "key2"]).select("rep", "shingles"))

    keys = reps.select("key1", "key2", "rep")
    pairs = pairs.join(keys.withColumnRenamed("rep", "b"), ["key1", "key2"]).select("p1", "p2", "b")
    pairs = materialize(pairs.join(keys.toDF("p1", "p2", "a"), ["p1", "p2"]).select("a", "b"))
    links = materialize(verified(pairs, sets, percent, at_least))
    labels = materialize(_labelled(reps.select("rep", "n"), links, "label"))

    # Sets that share a signature with one of another component are compared with all that they may be similar to.
    label_of = labels.select("rep", "label")
    across = pairs.join(label_of.toDF("a", "one"), "a").join(label_of.toDF("b", "two"), "b").where("one != two")
    across = materialize(across.select("a", "b"))
    if not across.isEmpty():
        clusters = materialize(_labelled(labels, pairs, "cluster"))
        opened = materialize(clusters.join(across.select(F.col("a").alias("rep")).distinct(), "rep").select("cluster").distinct())
        rows = lookup_join(clusters, opened, ["cluster"], "left_semi", ["rep"], at_least=at_least)
        more = cluster_links(rows.select("rep", "cluster", "label", "n"), sets, percent, block, at_least)
        links = materialize(links.unionByName(more))
    return _labelled(reps.select("key1", "key2", "rep", "first_id"), links, "root").select("key1", "key2", "root", "first_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    size: int = SHINGLE, block: int = BLOCK, at_least: int = HEAVY_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id that similar texts lead to.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least
    `percent`; the numbers are compared exactly. A text of fewer words than a shingle has is
    one shingle. Texts without words, or null, are linked with nothing: component_id is their
    own doc_id. Equal sets are joined as one. Rows with a null id take part but give no
    component_id unless their whole class has none. Other columns play no part.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(with_keys(docs, size))
    keyed = materialize(marked.where("n_shingles > 0").groupBy("key1", "key2").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("_rows")))
    classes = materialize(similar_classes(docs, keyed, percent, size, block, at_least))
    heads = classes.groupBy("root").agg(F.min("first_id").alias("least"))
    counts = classes.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
    found = lookup_join(classes, heads, ["root"], "inner", ["key1", "key2"], counts, at_least=at_least)
    known = keyed.join(found.select("key1", "key2", "least"), ["key1", "key2"], "left")
    known = known.select("key1", "key2", F.coalesce("least", "first_id").alias("component_id"))
    joined = lookup_join(marked.where("n_shingles > 0"), known, ["key1", "key2"], "inner", ["doc_id"],
                         keyed.select("key1", "key2", "_rows"), at_least=at_least)
    columns = ["doc_id", "n_shingles", "component_id"]
    empty = marked.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return joined.select(*columns).unionByName(empty.select(*columns))
