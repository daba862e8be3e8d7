"""How far the sources of a language differ in their words, priced over hash-consed segment trees."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.batches import slices
from treeledger.operators.joins import lookup_join
from treeledger.sources.workspace import materialize

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
LEAVES = 1 << 12  # terms under one segment tree
GROUPS = 64  # groups whose trees a task holds of each side
PRICED = 1 << 20  # pairs of leaves that are looked at together
HELD_TERMS = 500_000  # counts that a task adds up before it hands them on
HEAVY_ROWS = 10_000
SMALL_GROUPS = 100_000  # up to so many groups their table is broadcast
PAD = -1  # count of a leaf that stands for no term

# Letters are ASCII ones, lowered, and all that is not ASCII.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, with empty ones wherever separators meet."""
    return (text or b"").translate(_PLAIN).split(b" ") if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), from documents with lang, source and text."""
    def count(batches):
        held: dict[tuple, list[Counter]] = {}
        waiting = 0

        def flush():
            rows = [(*group, term, n, seen[1][term]) for group, seen in held.items() for term, n in seen[0].items() if term]
            held.clear()
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for part in slices(batch.column("text")):
                for text in part:
                    terms = terms_of(text)
                    own = held.setdefault(next(groups), [Counter(), Counter()])
                    before = len(own[0])
                    own[0].update(terms)
                    own[1].update(set(terms))
                    waiting += len(own[0]) - before
                if waiting > HELD_TERMS:
                    yield flush()
                    waiting = 0
        yield flush()

    made = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # A task's rows are added up already; another partial sum of them would be work for nothing.
    return made.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Trees over the rows of leaves as shared nodes: the root of each row, the children of each level's nodes, the leaf values.

    A node is made once for each pair of children that occurs, in whatever tree and place,
    so equal stretches of counts are one node.
    """
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes, levels = nodes.reshape(leaves.shape), []
    while nodes.shape[1] > 1:
        pairs = nodes[:, 0::2].astype(np.int64) << 32 | nodes[:, 1::2]
        made, inverse = np.unique(pairs, return_inverse=True)
        levels.append(np.stack([made >> 32, made & 0xFFFFFFFF], axis=1))
        nodes = inverse.reshape(pairs.shape)
    return nodes[:, 0], levels, values


def frequencies(counts, totals):
    """Smoothed relative frequencies in units of 1 / SCALE, rounded down, plus one; exact."""
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - 2:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + SCALE * (counts + 2) // totals).astype(np.int64)


def distance(p, q):
    return (p - q) ** 2 // (p + q)


def prices(roots: np.ndarray, others: np.ndarray, kinds: np.ndarray, totals: np.ndarray, levels: list[np.ndarray],
           values: np.ndarray) -> np.ndarray:
    """Sum of distances over the leaves of each pair of trees.

    Both trees are walked together, level by level. Of the node pairs that a level meets,
    equal ones (with the same totals, which kinds tells) are kept once; so every one is
    priced once, and its price goes back up to all that met it. totals has a row for each kind.
    """
    inverses = []
    a, b, kind = roots.astype(np.int64), others.astype(np.int64), kinds
    for level in [*reversed(levels), None]:
        keys, at = _distinct(kind, a, b)
        inverses.append(at)
        kind, a, b = keys[:, 0], keys[:, 1], keys[:, 2]
        if level is not None:
            a, b, kind = level[a].reshape(-1), level[b].reshape(-1), np.repeat(kind, 2)
    left, right = values[a], values[b]
    real = left != PAD
    price = np.zeros(len(a), np.int64)
    p = frequencies(left[real], totals[kind[real], 0])
    q = frequencies(right[real], totals[kind[real], 1])
    price[real] = distance(p, q)
    for at in reversed(inverses[1:]):
        price = price[at].reshape(-1, 2).sum(axis=1)
    return price[inverses[0]]


def _distinct(kind: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Distinct triples with the place of each in them, by two rounds over single numbers."""
    pairs, first = np.unique(a << 32 | b, return_inverse=True)
    triples, second = np.unique(kind << 32 | first, return_inverse=True)
    chosen = pairs[triples & 0xFFFFFFFF]
    return np.stack([triples >> 32, chosen >> 32, chosen & 0xFFFFFFFF], axis=1), second


def block_prices(left: tuple, right: tuple, leaves: int, same: bool) -> list[tuple[int, int, int]]:
    """(group, other, sum of distances) for groups of two cells; a cell is (slots' totals, entries' slot, leaf, count)."""
    width = 1 << max(0, (leaves - 1).bit_length())
    tables = []
    for totals, slot, leaf, n in (left, right):
        table = np.zeros((len(totals), width), np.int64)
        table[:, leaves:] = PAD
        table[slot, leaf] = n
        tables.append(table)
    roots, levels, values = consed(np.concatenate(tables))
    one, two = np.triu_indices(len(left[0]), 1) if same else (x.reshape(-1) for x in np.indices((len(left[0]), len(right[0]))))
    found = []
    step = max(1, PRICED // width)
    for at in range(0, len(one), step):
        i, j = one[at:at + step], two[at:at + step]
        totals, kinds = np.unique(np.stack([left[0][i], right[0][j]], axis=1), axis=0, return_inverse=True)
        sums = prices(roots[i], roots[len(left[0]) + j], kinds.reshape(-1).astype(np.int64), totals, levels, values)
        found += zip(i.tolist(), j.tolist(), sums.tolist())
    return found


def _numbered(terms: DataFrame, leaves: int) -> DataFrame:
    """Kept terms (lang, term, ...) with block and leaf, their place in the order of the language's terms.

    A range sort lays them out; its parts, counted by language, tell where each begins.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    laid = materialize(terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
                       .withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    parts = laid.groupBy("lang", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("lang", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return laid.join(parts, ["lang", "_part"]).select(
        *terms.columns, F.floor(place / leaves).alias("block"), F.pmod(place, F.lit(leaves)).cast("int").alias("leaf"))


def with_groups(rows: DataFrame, groups: DataFrame, at_least: int, small: int = SMALL_GROUPS) -> DataFrame:
    """Rows with the facts of their (lang, source): by a broadcast of few groups, or a join that splits large ones."""
    if groups.count() <= small:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    return lookup_join(rows, groups, ["lang", "source"], "inner", ["term"], at_least=at_least)


def pair_sums(counts: DataFrame, groups: DataFrame, numbered: DataFrame, width: int = GROUPS, at_least: int = HEAVY_ROWS,
              small: int = SMALL_GROUPS) -> DataFrame:
    """lang, source, other, value for every pair of sources of a language, each pair once.

    counts is (lang, source, term, n, block, leaf) of kept terms; groups (lang, source, total),
    total the denominator of its frequencies; numbered (lang, block) of every kept term. The
    terms of a language are cut into blocks, its sources into cells; a task prices the trees
    of two cells over one block.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.withColumn("_at", place).select(
        "lang", "source", "total", F.floor(F.col("_at") / width).alias("cell"), F.pmod("_at", F.lit(width)).alias("slot")))
    entries = with_groups(counts, groups.select("lang", "source", "cell", "slot"), at_least, small)
    filled = entries.groupBy("lang", "block", "cell").agg(F.collect_list(F.struct("slot", "leaf", "n")).alias("entries"))
    cells = groups.groupBy("lang", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "total"))),
                                                           lambda s: s["total"]).alias("totals"))
    blocks = numbered.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("leaves"))
    grid = cells.join(blocks, "lang").join(filled, ["lang", "block", "cell"], "left")
    grid = materialize(grid.withColumn("entries", F.coalesce("entries", F.array().cast(filled.schema["entries"].dataType))))
    other = grid.select("lang", "block", F.col("cell").alias("other"), F.col("totals").alias("other_totals"),
                        F.col("entries").alias("other_entries"))
    work = grid.join(other, ["lang", "block"]).where("cell <= other")

    def price(batches):
        def cell(totals, entries):
            rows = entries.values
            return (totals.values.to_numpy(), *[rows.field(f).to_numpy() for f in ("slot", "leaf", "n")])

        for batch in batches:
            names = ("lang", "cell", "other", "leaves", "totals", "entries", "other_totals", "other_entries")
            rows = []
            for lang, a, b, n, *sides in zip(*(batch.column(c) for c in names)):
                lang, a, b = lang.as_py(), a.as_py(), b.as_py()
                sums = block_prices(cell(*sides[:2]), cell(*sides[2:]), n.as_py(), a == b)
                rows += [(lang, a, i, b, j, v) for i, j, v in sums]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["lang", "cell", "slot", "other_cell", "other_slot", "value"])

    schema = "lang string, cell long, slot long, other_cell long, other_slot long, value long"
    priced = work.select("lang", "cell", "other", "leaves", "totals", "entries", "other_totals", "other_entries")
    keys = ["lang", "cell", "slot", "other_cell", "other_slot"]
    sums = priced.mapInArrow(price, schema).groupBy(*keys).agg(F.sum("value").alias("value"))
    names = groups.select("lang", "cell", "slot", "source")
    sums = sums.join(names, ["lang", "cell", "slot"]).drop("cell", "slot")
    sums = sums.join(names.toDF("lang", "other_cell", "other_slot", "other"), ["lang", "other_cell", "other_slot"])
    return sums.select("lang", "source", "other", "value")


def _frequency(n: Column, total: Column) -> Column:
    scaled = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, leaves: int = LEAVES, width: int = GROUPS,
          at_least: int = HEAVY_ROWS, small: int = SMALL_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Part `pair`: every other source of the language, by how far its words are from this one's.
    Part `term`: the words this source uses more than its language does, the `top_terms`
    farthest ones. A language keeps the terms that occur in at least `least_documents` of its
    documents. Frequencies and distances are exact whole numbers. Null lang, source and
    text count as empty ones; a language without kept terms has distances of zero and no
    terms. Repeated rows count as often as they occur. Equal values go by item.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
             for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    docs = docs.select(*named)
    counts = materialize(term_counts(docs))
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"),
                                               F.count(F.lit(1)).alias("_rows"))
    kept = materialize(known.where(F.col("docs") >= least_documents).select("lang", "term", "all_n", "_rows"))
    numbered = materialize(_numbered(kept.drop("_rows"), leaves))
    counts = materialize(lookup_join(counts.drop("docs"), numbered, ["lang", "term"], "inner", ["source"],
                                     kept.select("lang", "term", "_rows"), at_least=at_least)
                         .select("lang", "source", "term", "n", "all_n", "block", "leaf"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(groups.select(
        "lang", "source", (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
        (F.coalesce("all_total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("all_total")))

    sums = pair_sums(counts.drop("all_n"), groups.select("lang", "source", "total"), numbered.select("lang", "block"),
                     width, at_least, small)
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    wordless = groups.where("total = 0").select("lang", "source")
    alone = wordless.join(wordless.toDF("lang", "other"), "lang").where("source != other")
    both = both.unionByName(alone.withColumn("value", F.lit(0).cast("bigint")))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by))

    priced = with_groups(counts, groups, at_least, small)
    p, q = _frequency(F.col("n"), F.col("total")), _frequency(F.col("all_n"), F.col("all_total"))
    priced = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    apart = F.col("p") - F.col("q")
    value = F.call_function("div", apart * apart, F.col("p") + F.col("q"))
    terms = priced.where("p > q").select("lang", "source", "part", "item", value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
