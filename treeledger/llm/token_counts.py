"""Token counts of a byte-pair vocabulary, merged by rank in numpy arrays."""

import json
import unicodedata
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from treeledger.llm.batches import slices, with_results

CACHED_CHUNKS = 1_000_000  # counts of distinct chunks that a task keeps; beyond that it starts anew
# Space for str.split but not for the vocabulary's splitter.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Capitals up to Unicode 17, which the vocabulary's library lower-cases and Python does not yet.
NEW_CAPITALS = {0xA7CB: 0x264, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DC: 0x19B} | {0x10D50 + i: 0x10D70 + i for i in range(22)}
# First and last code points of letters and numbers that are newer than Unicode 16, which the
# vocabulary's library goes by. It takes them for signs.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_CLASS = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER)
NONE = np.iinfo(np.int64).max


class Merges(NamedTuple):
    """A vocabulary as arrays: symbols of a byte inside and at the end of a word, and per
    pair of symbols (as one number, ascending) its rank and the symbol it becomes."""
    size: int
    inner: np.ndarray
    final: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    splitter: str
    specials: list[str]


def byte_characters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: a printable byte stands for itself."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


def read_vocabulary(path: str) -> Merges:
    """Read a tokenizers file: lower-casing byte-level BPE with an end-of-word suffix."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, vocabulary = content["model"], content["model"]["vocab"]
    steps = {step["type"] for step in content["normalizer"]["normalizers"]}
    suffix = model["end_of_word_suffix"]
    if steps != {"NFC", "Replace", "Lowercase"} or not suffix or model["ignore_merges"]:
        raise ValueError(f"{path} is no lower-casing vocabulary with word ends")
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    size = max(vocabulary.values()) + 1
    codes = np.array([vocabulary[a] * size + vocabulary[b] for a, b in pairs], np.int64)
    order = np.argsort(codes)
    return Merges(size, np.array([vocabulary[c] for c in byte_characters()], np.int64),
                  np.array([vocabulary[c + suffix] for c in byte_characters()], np.int64),
                  codes[order], np.arange(len(pairs))[order], np.array([vocabulary[a + b] for a, b in pairs])[order],
                  content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
                  [token["content"] for token in content["added_tokens"]])


def symbol_counts(words: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols each word ends up as.

    All words lie in one array. In each round every word finds the lowest rank among its
    pairs and merges all pairs of that rank, from the left where they overlap; no later
    merge can undo that, since a merged symbol takes part in higher ranks only. Words
    without a pair to merge leave the array.
    """
    counts = np.zeros(len(words), np.int64)
    names = np.flatnonzero([len(w) > 0 for w in words])
    if not len(names):
        return counts
    lengths = np.array([len(words[i]) for i in names])
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = merges.inner[raw]
    last = np.cumsum(lengths) - 1
    symbols[last] = merges.final[raw[last]]
    while len(names):
        starts = np.cumsum(lengths) - lengths
        codes = symbols[:-1] * merges.size + symbols[1:]
        slot = np.minimum(np.searchsorted(merges.pairs, codes), len(merges.pairs) - 1)
        rank = np.append(np.where(merges.pairs[slot] == codes, merges.ranks[slot], NONE), NONE)
        rank[starts + lengths - 1] = NONE
        lowest = np.minimum.reduceat(rank, starts)
        chosen = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != NONE))
        # Chosen pairs that overlap form runs of one repeated symbol: take every other one.
        place = np.arange(len(chosen))
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(chosen) != 1], place, 0))
        chosen = chosen[(place - run) % 2 == 0]
        symbols[chosen] = merges.merged[slot[chosen]]
        gone = np.zeros(len(symbols), bool)
        gone[chosen + 1] = True
        open_ = lowest != NONE
        counts[names[~open_]] = lengths[~open_]
        keep = np.repeat(open_, lengths) & ~gone
        lengths = (lengths - np.add.reduceat(gone.astype(np.int64), starts))[open_]
        symbols, names = symbols[keep], names[open_]
    return counts


class Counter:
    """Counts the tokens of texts. What stands between white space is counted once and remembered."""

    def __init__(self, merges: Merges, cached: int = CACHED_CHUNKS):
        self.merges, self.cached, self.known = merges, cached, {}
        self.pieces = regex.compile(merges.splitter)
        self.newer = regex.compile(f"[{NEWER_CLASS}]")
        kinds = ((rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{NEWER_CLASS}]]") for kind in "LN")
        self.old_pieces = regex.compile(reduce(lambda p, kind: p.replace(*kind), kinds, merges.splitter), regex.V1)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def chunks(self, text: str) -> tuple[list[str], int]:
        """Lower-case chunks between white space, and the number of special tokens among them."""
        specials = 0
        if self.special and (specials := len(self.special.findall(text))):
            # Each part between special tokens is normalised by itself.
            parts = [self.chunks(part)[0] for part in self.special.split(text)]
            return [chunk for part in parts for chunk in part], specials
        if not text.isascii():
            # Capital sigma has one lower case wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if any(chr(c) in text for c in NEW_CAPITALS):
                text = text.translate(NEW_CAPITALS)
        text = text.lower()
        separate = any(c in text for c in SEPARATORS)
        return (regex.split(r"\s+", text) if separate else text.split()), specials

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        pieces = [(self.old_pieces if not chunk.isascii() and self.newer.search(chunk) else self.pieces).findall(chunk)
                  for chunk in new]
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = symbol_counts([word.encode() for p in pieces for word in p], self.merges)
        sums = np.r_[0, np.cumsum(counts)]
        ends = np.cumsum(sizes)
        self.known.update(zip(new, (sums[ends] - sums[ends - sizes]).tolist()))

    def counts(self, texts: list[bytes | None]) -> list[int]:
        split = [self.chunks((raw or b"").decode()) for raw in texts]
        wanted = {chunk for chunks, _ in split for chunk in chunks}
        if len(self.known) + len(wanted) > self.cached:
            self.known = {}
        self.learn(wanted.difference(self.known))
        return [sum(map(self.known.__getitem__, chunks)) + specials for chunks, specials in split]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048,
                 keep: list[str] | None = None) -> DataFrame:
    """Documents with n_bytes, n_tokens and over_limit.

    The vocabulary is a file on the driver; it goes to the executors by a broadcast whose
    size is that of the file. A null or empty text has no bytes and no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(read_vocabulary(vocabulary)))
    held: list[Counter] = []

    def compute(texts: pa.Array):
        if not held:
            held.append(Counter(Merges(*shared.value)))
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        n_tokens = [n for part in slices(texts) for n in held[0].counts(part)]
        return n_bytes, n_tokens, [n > limit for n in n_tokens]

    return with_results(docs, [text], "n_bytes long, n_tokens long, over_limit boolean", compute, keep)
