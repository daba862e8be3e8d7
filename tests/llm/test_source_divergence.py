import random
import re
from collections import Counter, defaultdict

import numpy as np
from fixtures import documents, odd_texts

from treeledger.llm import source_divergence as D


def direct(rows, least=10, top=10):
    """The rule written out; rows are (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for known, s in counts if known == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def frequency(counter):
            total = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (counter[t] + 2) // total for t in kept}

        own, q = {s: frequency(counts[lang, s]) for s in sources}, frequency(whole)
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // (own[s][t] + own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((own[s][t] - q[t]) ** 2 // (own[s][t] + q[t])), t.encode()) for t in kept
                     if counts[lang, s][t] and own[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def test_shared_nodes_and_prices():
    rng = np.random.default_rng(4)
    leaves = rng.integers(0, 3, (6, 16)) * (rng.random((6, 16)) < 0.3)
    leaves[3] = leaves[2]
    roots, levels, values = D.consed(leaves)
    assert roots[2] == roots[3] and len(set(roots.tolist())) <= 5
    for nodes in levels:
        assert len(np.unique(nodes, axis=0)) == len(nodes)

    def unfold(node, depth):
        return [int(values[node])] if depth < 0 else [x for child in levels[depth][node] for x in unfold(child, depth - 1)]

    assert [unfold(r, len(levels) - 1) for r in roots] == leaves.tolist()
    totals = rng.integers(40, 60, 6)
    found = D.block_prices((totals, *np.nonzero(leaves), leaves[np.nonzero(leaves)]),
                           (totals, *np.nonzero(leaves), leaves[np.nonzero(leaves)]), 16, True)
    assert len(found) == 15
    for i, j, value in found:
        p, q = (1 + 10 ** 9 * (leaves[k] + 2) // totals[k] for k in (i, j))
        assert value == int(((p - q) ** 2 // (p + q)).sum())
    huge = np.array([10 ** 13])
    assert D.frequencies(huge, np.array([10 ** 13 + 5])).tolist() == [1 + 10 ** 9 * (10 ** 13 + 2) // (10 ** 13 + 5)]


def test_audit_against_the_rule(spark):
    rng = random.Random(9)
    words = ["la", "Mer", "est", "grand", "Straße", "日本", "naïve", "x-ray", "it's", "old", "town", "ÀÉ", "boats", "many"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["aa", "bb", "", None]), rng.choice(["s1", "s2", "é", "S", None, "s10"])
        rows.append((lang, source, " ".join(rng.choice(words[:6] if source == "S" else words) for _ in range(rng.randrange(12)))))
    rows += [("rare", f"r{i}", f"word{i}") for i in range(5)] + [("void", "v1", None), ("void", "v2", ""), ("one", "alone", "a a a")]
    rows += [("aa", "odd", t) for t in odd_texts()]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS `a.b`", "3 AS n")
    want = direct(rows)
    for options in ({}, {"leaves": 4, "width": 2, "at_least": 1, "small": 0}):
        assert sorted(map(tuple, D.audit(docs, **options).collect())) == want
    assert {r[0] for r in want if r[2] == "pair" and r[4] == 0} >= {"rare", "void"}
    small = D.audit(docs, least_documents=1, top_terms=2, leaves=2, width=3)
    assert sorted(map(tuple, small.collect())) == direct(rows, 1, 2)


def test_no_rows(spark):
    assert D.audit(documents(spark).limit(0)).count() == 0
