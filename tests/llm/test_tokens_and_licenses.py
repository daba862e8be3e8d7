import random
import re

import pytest
from fixtures import documents, odd_texts

from treeledger.llm import licenses, token_counts

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return vocabularies.path("word_bpe_49k.json")


def test_counts_are_those_of_the_library(spark, path):
    rng = random.Random(1)
    alphabet = "aA'sSt lv" + "é́Σẞ\x1c İ漢字9½!!!\n\t😀\ua7cb\U00010d50" + "\x85\u2028\ufeff\u200b"
    texts = odd_texts() + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "a", "<|startoftext|>", "Σ", "e\u0301"]) for _ in range(8)) for _ in range(100)]
    texts += ["aaaa" * 300, "ababab" * 50, "!" * 999, "don't we'll I'M"]
    docs = documents(spark, texts, N_TOKENS="x", over_limit=1)
    library = tokenizers.Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path, limit=20, keep=["doc_id", "text"]).collect():
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 20), r.text
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []


def test_every_code_point_is_classed_as_the_library_does(path):
    counter, library = token_counts.Counter(token_counts.read_vocabulary(path)), tokenizers.Tokenizer.from_file(path)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for before, after in (("е", "е"), ("1!", "'s")):
        texts = [before + c + after for c in points]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        got = counter.counts([t.encode() for t in texts])
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_forgotten_chunks_are_counted_again(path):
    counter = token_counts.Counter(token_counts.read_vocabulary(path), cached=3)
    texts = [b"one two three", b"four five six", b"one six nine ten"]
    fresh = token_counts.Counter(token_counts.read_vocabulary(path))
    assert [n for t in texts for n in counter.counts([t])] == fresh.counts(texts)


def test_automaton_finds_longest_stretches():
    rng = random.Random(3)
    for _ in range(150):
        known = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))]
        automaton, text = licenses.Automaton(known), [rng.choice([b"a", b"b", b"c"]) for _ in range(20)]
        for i, (state, length) in enumerate(automaton.statistics([automaton.numbers.get(w, 0) for w in text])):
            ends = {n: sorted((k, j + n) for k, s in enumerate(known) for j in range(len(s) - n + 1) if s[j:j + n] == text[i + 1 - n:i + 1])
                    for n in range(1, i + 2)}
            longest = max((n for n in ends if ends[n]), default=0)
            assert length == longest and (not longest or automaton.ends[state] == ends[longest])


def test_phrases_and_templates(spark):
    rng = random.Random(6)
    parts = ["under the MIT license", "Apache License, version 2.0", "CC BY-NC", "cc by", "mit license under the", "x y", "the"]
    template = dict(licenses.TEMPLATES)["mit"]
    words = template.split()
    cut = " ".join(words[:40] + ["foreign"] * 5 + words[40:])
    texts = odd_texts() + [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += [template, cut, " ".join(words[:20]), " ".join(words[50:] + words[:50])]
    docs = documents(spark, texts, score="x", PHRASES=1)
    rows = licenses.digest(licenses.scan(docs, keep=["doc_id", "text"])).collect()
    assert len(rows) == docs.count()
    for r in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        own = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(own))
                        if own[i:i + len(phrase.split())] == phrase.split())
        labels = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(own), len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by_text = {r.text: r for r in rows}
    assert by_text[template].labels == "mit" and by_text[template].score == 1.0
    assert by_text[cut].labels == "mit" and by_text[cut].score > 0.9
    assert by_text[" ".join(words[:20])].labels == "" and 0 < by_text[" ".join(words[:20])].score < 0.5
    assert licenses.scan(docs.limit(0)).collect() == []


def test_notices_of_one_line_and_whole_licences(spark):
    full = dict(zip((name for _, name in licenses.FULL), (text for _, text in licenses.full_texts())))
    templates = dict(licenses.TEMPLATES)
    passage = " ".join(full["gpl-3"].split()[2500:2800])
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the GNU Lesser General Public License v2.1": "lgpl", "Released under the AGPLv3.": "agpl",
        "Use is under the BSD 3-Clause license": "bsd", "This file is under the terms of the Mozilla Public License": "mpl-2",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl", "# SPDX-License-Identifier: MIT": "mit",
        "Licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "Licensed under the Apache License, Version 2.0.": "apache-2", "We all like a general public and its license": "",
        templates["gpl"]: "gpl", templates["lgpl"]: "lgpl", templates["agpl"]: "agpl", passage: "gpl",
        **{text: label for (label, name), text in zip(licenses.FULL, full.values()) if name in ("bsd", "cc0", "gpl-2", "mpl-2")},
    }
    rows = licenses.digest(licenses.scan(documents(spark, list(want)), keep=["text"])).collect()
    got = {r.text: r for r in rows}
    assert {t[:60]: label for t, label in want.items() if label not in got[t].labels.split(",")} == {}
    assert all(r.labels == want[r.text] for r in rows if len(r.text or "") < 1000 and r.text in want), [(r.text[:60], r.labels) for r in rows if r.text in want]
    gpl = got["This work is licensed under the GNU General Public License, version 3."]
    assert (gpl.base_labels, gpl.n_base, gpl.score) == ("", 0, 1.0)
    many = documents(spark, [" ".join(["Licensed under CC BY 4.0"] * 20000)])
    assert licenses.digest(licenses.scan(many)).first().labels == "cc-by"


def test_a_whole_licence_has_its_own_label_alone(spark):
    texts = [text for _, text in licenses.full_texts()]
    docs = spark.createDataFrame([(i, f"Copyright me\n{t}\nThe end") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs)).collect()}
    assert got == {i: label for i, (label, _) in enumerate(licenses.full_texts())}


@pytest.mark.parametrize("text, labels", [
    ("This project is not under the GPL", ""), ("It is not licensed under the MPL 2.0.", ""), ("Released under the GPL.", "gpl"),
    ("Not mine. It is free and it is licensed under the GNU GPL", "gpl"), ("License: BSD-3-Clause", "bsd"),
    ("This library is MIT licensed", "mit"), ("under the Eclipse Public License", "epl"), ("SPDX-License-Identifier: Artistic-2.0", "artistic"),
    ("under the terms of the CC BY-NC and nothing else", "cc-by-nc")])
def test_lines_and_denials(spark, text, labels):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.digest(licenses.scan(docs)).first().labels == labels


def test_chains_against_direct_search():
    """Every long match of a chain stands in template and text, in the order of both, and none is left out."""
    rng = random.Random(12)
    words = [f"w{i}".encode() for i in range(12)]
    for _ in range(60):
        template = [rng.choice(words) for _ in range(40)]
        text = [rng.choice(words) for _ in range(10)]
        at = rng.randrange(20)
        text += template[at:at + 12] + [b"other"] * rng.randrange(3) + template[at + 13:] + [rng.choice(words) for _ in range(6)]
        scanner = licenses.Scanner((), (("t", b" ".join(template).decode()),), match=4, gap=3, notices=())
        (_,), (chains,) = scanner.scan([text])

        def longest(end):
            """Length of the longest stretch of the template that the text has before `end`."""
            n = 0
            while n < end and any(template[i:i + n + 1] == text[end - n - 1:end] for i in range(40 - n)):
                n += 1
            return n

        lengths = [longest(i) for i in range(len(text) + 1)] + [0]
        long = {i for i in range(len(text) + 1) if lengths[i] >= 4 and lengths[i + 1] <= lengths[i]}
        assert {c[2] for c in chains} <= long and (max(long), bool(chains)) == (max(c[2] for c in chains), True)
        for _, start, end, covered, matches in chains:
            inside = [i for i in long if start < i <= end]
            assert len(inside) >= matches and covered <= sum(lengths[i] for i in inside) and covered <= 40
