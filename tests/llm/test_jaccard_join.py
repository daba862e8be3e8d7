import random

import numpy as np
import pytest
from fixtures import documents, near_texts, odd_texts

from treeledger.llm import jaccard_join as J


def direct(texts, percent=90):
    """Component numbers (the first position of each class) by comparing every pair of shingle sets."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        n = min(3, len(words))
        sets.append({b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                one, two = sorted((root(i), root(j)))
                parent[two] = one
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def check(spark, texts, **options):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs, **options).collect()}
    sizes, roots = direct(texts, options.get("percent", 90))
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    return roots


@pytest.mark.parametrize("percent", [90, 70, 100])
def test_similar_sets_share_a_signature(percent):
    rng = random.Random(percent)
    for _ in range(300):
        size = rng.choice([1, 2, 5, 9, 10, 19, 40, 200, 1500])
        base = rng.sample(range(1 << 40), size)
        gone = rng.randrange(size // 8 + 1)
        other = base[gone:] + [rng.randrange(1 << 40) for _ in range(rng.randrange(size // 8 + 1))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            assert set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())
    for size in range(1, 3000):
        band, high = J.band_of(size, percent)
        assert J.band_of(100 * size // percent, percent)[0] in (band, band + 1) and high >= size
        n1, n2, spoiled = J.scheme(high, percent)
        assert (spoiled + 1) * n1 > 2 * high * (100 - percent) // (100 + percent) and n2 > spoiled


def edits(rng, base, n):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for t in odd_texts() if t is None or len(t) < 3000] + near_texts(rng, 8)
    for size, n, copies in ((60, 1, 25), (200, 2, 20), (300, 5, 15), (12, 1, 8)):
        base = [f"b{size}x{rng.randrange(500)}" for _ in range(size)]
        texts += [" ".join(base)] + [edits(rng, base, rng.randrange(n + 1)) for _ in range(copies)]
    for size in (9, 10, 11, 19, 20, 21, 200):  # one word more at the end: on either side of the limit
        base = [f"c{size}x{i}" for i in range(size)]
        texts += [" ".join(base[:k]) for k in range(size - size // 9 - 1, size + 1)]
    rng.shuffle(texts)
    roots = check(spark, texts)
    assert len(set(roots)) < len(texts) - 40


def test_chains_are_followed_and_blocks_are_small(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(80)]
    # Each is similar to the unedited text alone, which is last in id but may stand anywhere in key order.
    texts = [" ".join(base[:i] + [f"own{i}"] + base[i + 1:]) for i in range(2, 78, 4)] + [" ".join(base)]
    chain = [f"k{i}" for i in range(100)]
    for step in range(30):
        texts.append(" ".join(chain))
        chain[(3 * step) % 100] = f"s{step}"
    texts += [edits(rng, base, 40) for _ in range(5)]
    roots = check(spark, texts, block=300, at_least=1)
    assert len(set(roots)) == 2 + 5
    check(spark, texts, percent=70)


def test_hot_signatures_are_cut(spark):
    rng = random.Random(6)
    texts = [" ".join([*(f"h{i}" for i in range(60)), f"end{rng.randrange(10 ** 9)}"]) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    signed = J.with_signatures(docs)
    hot = J.hot_signatures(docs, 90, 3, 64, one_of=2)
    assert 0 < hot.count() and hot.agg({"_slices": "max"}).first()[0] > 1
    pairs = J.candidate_pairs(signed, hot)
    reached = {(r.key1, r.key2) for r in pairs.collect()} | {(r.p1, r.p2) for r in pairs.collect()}
    assert len(reached) == 300
    from treeledger.llm.components import linked_components
    numbers = {k: i for i, k in enumerate(sorted(reached))}
    links = [(numbers[r.p1, r.p2], numbers[r.key1, r.key2]) for r in pairs.collect()]
    roots = linked_components(spark.createDataFrame(links, "a long, b long")).select("root").distinct()
    assert roots.count() == 1


def test_block_links_against_direct():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.int64) for _ in range(60)]
    rows = [(i, i, s) for i, s in enumerate(sets)]
    found = J.block_links(rows[:30], rows[30:], False, 50)
    assert all(2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b])) for a, b in found)
    label = list(range(60))
    for a, b in J.block_links(rows, rows, True, 50):
        label = [label[a] if x == label[b] else x for x in label]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)):
                assert label[i] == label[j]


def test_odd_inputs(spark):
    docs = documents(spark, key1="x", rep=3, sigs="y", **{"a.b": 1})
    rows = J.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and r.n_shingles == 0) == [0, 0, 1, 1, 2, 2]
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    # The row without an id repeats the last text and so belongs to its class.
    assert [r.component_id for r in rows if r.doc_id is None and r.n_shingles] == [len(odd_texts()) - 1]
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in J.near_duplicates(nameless).collect()) == [(0, None), (2, None), (2, None)]
    assert J.near_duplicates(docs.limit(0)).count() == 0
