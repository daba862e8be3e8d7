import random
from collections import Counter, defaultdict
from itertools import combinations

from fixtures import documents
from pyspark.sql import functions as F

from treeledger.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_best():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 50) for _ in lengths]
        k = rng.randrange(1, 5)
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) == min(k, len(lengths)) and bounds[-1] == lengths[-1]
        choices = [padding(lengths, counts, (*c, lengths[-1])) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n)]
        assert padding(lengths, counts, bounds) == min(choices)
    assert packing.best_bounds([], [], 3) == []


def test_every_token_has_one_place(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randrange(0, 90) for _ in range(500)] + ["w " * 40] * 300
    docs = documents(spark, texts, bucket=1, n_tokens="x")
    rows = packing.pack_texts(docs, max_length=32, buckets=4, budget=128).collect()
    words = Counter((r.doc_id, len((r.text or "").split())) for r in docs.collect())
    taken = defaultdict(int)
    for r in rows:
        taken[r.doc_id] += r.n_tokens
        assert r.start == r.piece * 32 and 0 <= r.n_tokens <= 32
    want = defaultdict(int)
    for (doc, n), times in words.items():
        want[doc] += n * times
    assert taken == want
    placed = [r for r in rows if r.n_tokens]
    assert all(r.batch is None and r.slot is None and r.bucket is None for r in rows if not r.n_tokens)
    assert len({(r.batch, r.slot) for r in placed}) == len(placed)
    batches = defaultdict(list)
    for r in placed:
        assert r.n_tokens <= r.bucket_length
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for members in batches.values():
        assert len({m.bucket for m in members}) == 1 and len(members) * members[0].bucket_length <= 128
        short[members[0].bucket] += len(members) < 128 // members[0].bucket_length
    assert all(n <= 1 for n in short.values())
    histogram = Counter(r.n_tokens for r in placed)
    bounds = sorted({r.bucket_length for r in placed})
    lengths = sorted(histogram)
    assert bounds == packing.best_bounds(lengths, [histogram[n] for n in lengths], 4)


def test_no_documents_and_no_tokens(spark):
    docs = documents(spark, [])
    assert packing.pack_texts(docs.limit(0)).collect() == []
    rows = packing.pack_texts(docs.where(F.col("text").isNull())).collect()
    assert [(r.doc_id, r.n_tokens, r.batch) for r in rows] == [(None, 0, None)]
