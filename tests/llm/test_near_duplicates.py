import random
import re

import numpy as np
import xxhash
from fixtures import documents, near_texts, odd_texts

from treeledger.llm import simhash
from treeledger.llm.components import linked_components


def direct_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def direct_classes(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check(spark, docs):
    rows = docs.collect()
    prints = [direct_print(r.text) for r in rows]
    classes = direct_classes(prints)
    least = {}
    for r, c in zip(rows, classes):
        ids = [x for x in (least.get(c), r.doc_id) if x is not None]
        least[c] = min(ids) if ids else None
    want = sorted(((r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, classes)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    return rows, classes, least


def test_classes_against_all_pairs(spark):
    docs = documents(spark, odd_texts() + near_texts(random.Random(1)), fingerprint=7, component_id="x")
    rows, classes, least = check(spark, docs)
    assert len(set(classes)) < len(rows) - 20
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)


def test_small_tiles_give_the_same_links(spark):
    rng = random.Random(3)
    numbers = {0, 2**63, 2**64 - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        numbers |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ 7 << rng.randrange(60)}
    signed = np.array(sorted(numbers), np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    classes = direct_classes(sorted(numbers))
    want = {frozenset(signed[i] for i in range(len(signed)) if classes[i] == c) for c in classes}
    for rows in (2, 2048):
        roots = dict(linked_components(simhash.links(prints, tile_rows=rows)).collect())
        groups = {}
        for x in signed:
            groups.setdefault(roots.get(x, x), set()).add(x)
        assert {frozenset(g) for g in groups.values()} == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(7, i) for i in range(8, 40)] + [(1, 1), (3, 2), (2, 3), (4, 2)]
    roots = dict(linked_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert roots == {x: 100 for x in chain} | {x: 7 for x in range(7, 40)} | {2: 2, 3: 2, 4: 2}


def test_empty_and_wordless(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.without_near_duplicates(docs.limit(0)).collect() == []
    rows = simhash.near_duplicates(documents(spark, [None, "", " "])).collect()
    assert {r.fingerprint for r in rows} == {"0" * 16} and {r.component_id for r in rows} == {0}
