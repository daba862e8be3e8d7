import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import documents, odd_texts

from treeledger.llm import decontamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def direct(text, items, size):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        for at in range(max(1, len(own) - size + 1) if own else 0):
            window = own[at:at + size]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
    names = ",".join(sorted(found))
    return len(words), bool(hit), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_against_direct_search(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = [f"W{i}É" if i % 3 else f"w{i}" for i in range(12)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(i, text(rng.randrange(0, 14))) for i in range(30)] + [(None, text(6)), (10, text(8)), (3, None), (30, "...")]
    bodies = [body for _, body in items if body]
    texts = odd_texts() + [text(rng.randrange(60)) + rng.choice(bodies).upper() + text(5) for _ in range(30)]
    texts += [text(40) for _ in range(30)]
    benchmark = spark.createDataFrame(items + items[:4], "item_id long, text string")
    docs = documents(spark, texts, items="x", N_WORDS=1)
    found = decontamination.digest(decontamination.scan(docs, benchmark, keep=["doc_id", "text"], size=4, block_bytes=block_bytes))
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.contaminated, r.n_hit, r.n_items, r.items_sha256) == direct(r.text, items, 4), r.text


def test_clean_documents_stay_as_they_are(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = documents(spark, [None, "", passage, f"x {passage.upper()}! y", passage[:-4]], contaminated=False)
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    left = decontamination.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(left.collect(), key=repr) == sorted((r for r in docs.collect() if passage not in (r.text or "").lower()), key=repr)
    assert decontamination.without_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert decontamination.without_contaminated(docs.limit(0), benchmark).collect() == []


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """Hits, owners and null ids are right even where most windows share a hash."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 12))).encode() for _ in range(40)]
    items = [(None if i % 9 == 0 else i % 25, text) for i, text in enumerate(texts)]
    monkeypatch.setattr(decontamination, "window_hashes",
                        lambda ids, at, size: sum(ids[at + i].astype(np.uint64) for i in range(size)) % np.uint64(3))
    made = decontamination.windows_of(items, 4)
    for _ in range(20):
        words = rng.choices("abcx", k=60)
        ids = np.array([made.numbers.get(w.encode(), 0) for w in words], np.int64)
        hit, found = decontamination.find(ids, made)
        want_hit, want = set(), set()
        for item, text in items:
            own = text.decode().split()
            for at in range(max(1, len(own) - 3) if own else 0):
                window = own[at:at + 4]
                for start in range(len(words) - len(window) + 1):
                    if words[start:start + len(window)] == window:
                        want_hit.update(range(start, start + len(window)))
                        want.update([] if item is None else [str(item)])
        assert set(np.flatnonzero(hit).tolist()) == want_hit
        assert {name for _, names in found for name in names} == want
    empty = decontamination.windows_of([], 4)
    assert not decontamination.find(np.zeros(3, np.int64), empty)[0].any()
