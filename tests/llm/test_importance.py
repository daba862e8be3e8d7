import hashlib
import math
import random
import re
import zlib

from fixtures import documents, odd_texts

from treeledger.llm import importance as I


def plain_features(text, buckets=10000):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def direct(rows, target, percent=5, least=20, seed=42, buckets=10000):
    """The rule written out; rows are (doc_id, text)."""
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in plain_features(text, buckets)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for ident, text in rows:
        n, features = plain_features(text, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        out.append([ident, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in out), key=repr)


def test_features_by_direct_count():
    for text in [t for t in odd_texts() if t] + ["A-b_C\x00d é 日本  x9", "one", "  ", "ÀB ßſK"]:
        n, features = I.feature_buckets(text.encode())
        want = plain_features(text)
        assert (n, sorted(features.tolist())) == (want[0], sorted(want[1]))


def test_resample_against_the_rule(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)] + odd_texts()
    docs = documents(spark, texts, weight=7, rank="x", **{"a.b": 1})
    target = [" ".join(rng.choice(words[:40]) for _ in range(50)) for _ in range(20)] + [None, "", "Wholly other words"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for options in ({}, {"percent": 50, "least_words": 3, "seed": 7, "buckets": 70_000}):
        got = sorted((tuple(r) for r in I.resample(docs, bench, **options).collect()), key=repr)
        plain = {"least_words": "least"}
        assert got == direct(rows, target, **{plain.get(k, k): v for k, v in options.items()})
        assert sum(r[4] is not None for r in got) > 3


def test_empty_sides(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in I.resample(docs, none).collect()), key=repr) == direct(rows, [])
    assert I.resample(docs.limit(0), none).count() == 0
