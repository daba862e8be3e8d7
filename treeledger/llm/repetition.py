"""Quality rules on repetition inside a text, by a suffix array over its words."""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from treeledger.llm.batches import covered, filtered, slices, with_results

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
GROUP_WORDS = 1 << 17


class Rules:
    """Repeats of at least `length` words count; they may cover this share of the words, and none may be longer."""

    def __init__(self, length: int = 10, share: float = 0.3, longest: int = 300):
        self.length, self.share, self.longest = length, share, longest


def longest_repeats(words: np.ndarray, document: np.ndarray) -> np.ndarray:
    """For each place of several word sequences put end to end, the length of the longest
    stretch from there that occurs elsewhere in the same sequence.

    Every sequence must end in a word of its own. Suffixes are sorted by prefix doubling:
    each round sorts only those that still share a rank, by the rank of what follows. The
    ranks of all rounds then give the common prefix of neighbours by halving steps. A
    suffix lies in the LCP intervals of its neighbours, and the deeper of the two is the
    longest repeat that starts there.
    """
    n = len(words)
    key = document.astype(np.int64) << 32 | words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, step = [], 1
    while True:
        rounds.append(rank)
        shared = np.flatnonzero(~(new & np.r_[new[1:], True]))  # slots of suffixes that are not told apart yet
        if not len(shared):
            break
        suffixes = order[shared]
        # A shared suffix has a sequence end of its own beyond the step, so the step stays inside.
        key = rank[suffixes] * n + rank[suffixes + step]
        by_key = np.argsort(key, kind="stable")
        order[shared], key = suffixes[by_key], key[by_key]
        new[shared] = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        heads = np.maximum.accumulate(np.where(new[shared], shared, 0))
        rank[order[shared]] = heads
        step *= 2
    left, right = order[:-1], order[1:]
    prefix = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        prefix += (rounds[level][left + prefix] == rounds[level][right + prefix]).astype(np.int64) << level
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(np.r_[prefix, 0], np.r_[0, prefix])
    return longest


def measures(group: list[np.ndarray], rules: Rules) -> list[np.ndarray]:
    """Per word sequence: words in repeated 3-word windows, words that long repeats cover, longest repeat."""
    sizes = np.array([len(ids) + 1 for ids in group])
    starts = np.cumsum(sizes) - sizes
    words = np.full(sizes.sum(), 0xFFFFFFFF, np.int64)
    for start, ids in zip(starts, group):
        words[start:start + len(ids)] = ids
    longest = longest_repeats(words, np.repeat(np.arange(len(group)), sizes))
    short, long = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= rules.length)
    return [np.add.reduceat(covered(short, short + 3, len(words)).astype(np.int64), starts),
            np.add.reduceat(covered(long, long + longest[long], len(words)).astype(np.int64), starts),
            np.maximum.reduceat(longest, starts)]


def distinct_surplus(lines: list[bytes]) -> int:
    worded = [line for line in lines if line and not line.isspace()]
    return len(worded) - len(set(worded))


def judge(docs: DataFrame, rules: Rules | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with their counts, base_failed and kept.

    A text is rejected by the base rules (under 50 words, or over half of them in repeated
    3-word windows) or by `rules` on long repeats. A null text has no words and is rejected.
    Every text is measured whole; memory is that of one text or of a group of short ones.
    """
    rules = rules or Rules()

    def compute(texts: pa.Array):
        characters = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        facts, found, group, waiting = [], [[], [], []], [], 0

        def flush():
            nonlocal group, waiting
            if group:
                for values, more in zip(found, measures(group, rules)):
                    values.extend(more.tolist())
            group, waiting = [], 0

        for part in slices(texts):
            number = defaultdict(count().__next__)
            for raw in part:
                raw = raw or b""
                words = raw.split()
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                spaces = len(raw) - len(raw.translate(None, SPACES))
                facts.append((len(words), characters[len(facts)] - spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
                              distinct_surplus(raw.split(b"\n"))))
                group.append(ids)
                waiting += len(ids)
                if waiting > GROUP_WORDS:
                    flush()
            flush()  # word numbers are those of one slice
        rows = []
        for (n, chars, symbols, lines), repeat, cover, longest in zip(facts, *found):
            failed = n < 50 or 100 * repeat > 50 * n
            kept = not failed and cover <= rules.share * n and longest <= rules.longest
            rows.append((n, chars, symbols, lines, repeat, cover, longest, failed, kept))
        return list(zip(*rows)) or [[]] * 9

    return with_results(docs, [text], "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                        "n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, "
                        "kept boolean", compute, keep)


def kept_documents(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return filtered(docs, text, lambda renamed, name: judge(renamed, rules, name), "kept")
