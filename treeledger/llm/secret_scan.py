"""Secrets in texts: fixed patterns, and strings too random to be words."""

import hashlib
import re
from collections import Counter
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")


class CharacterClass(NamedTuple):
    """Candidates are runs of these characters; a window of them with this many bits a character is random."""
    kind: str
    run: re.Pattern
    window: int
    bits: float


# Random hex has 3.6 bits a character in 32, random base64 has 4.2 in 24; long words stay below 3.7.
CLASSES = (
    CharacterClass("entropy_hex", re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}(?![0-9a-fA-F])"), 32, 3.0),
    CharacterClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
    # Shorter ones are random only if they also mix digits and both cases; 16 random characters have 3.8 bits.
    CharacterClass("entropy_base64", re.compile(
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Za-z+/_=-]*[0-9])"
        r"[A-Za-z0-9+/_=-]{16,23}(?![A-Za-z0-9+/_=-])"), 16, 3.4),
)
KINDS = BASE_KINDS + tuple(dict.fromkeys(c.kind for c in CLASSES))

# Words of a case, or of several parts of two letters and more in one: random letters change their case more often.
WORD = r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)*+[A-Za-z]?"
# Parts of paths, slugs and times, which are judged one by one: a number with a few letters, or words with a number.
PIECE = rf"(?>[0-9]++[A-Za-z]{{0,3}}[0-9]{{0,4}}(?![A-Za-z0-9])|{WORD}[0-9]{{0,4}}(?![A-Za-z0-9]))"
# A candidate that matches one of these as a whole is no secret: identifiers, words, paths, rulers.
ALLOWED = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9]+", rf"{WORD}([-_/+=]{WORD})*", rf"{PIECE}([-_/]+{PIECE})*[-_/]*", rf"[-_/]+{PIECE}([-_/]+{PIECE})*[-_/]*", r"[0-9]*([-_/+=.][0-9]*)+",
))
# No window with one of these is a secret; the rest of its candidate may hold one.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|your[-_]", re.IGNORECASE)


def random_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy is at least `bits`, by moving one window along the text.

    A step takes one character out and one in, so only two terms of the sum of n*log2(n) change.
    """
    if len(text) < window:
        return []
    counts = Counter(text[:window])
    total = sum(n * log2(n) for n in counts.values())
    most = window * (log2(window) - bits) + 1e-9
    found: list[list[int]] = []
    for start in range(len(text) - window + 1):
        if start:
            for character, step in ((text[start - 1], -1), (text[start + window - 1], 1)):
                n = counts[character]
                total -= n * log2(n) if n else 0
                counts[character] = n = n + step
                total += n * log2(n) if n else 0
        if total <= most:
            if found and start <= found[-1][1]:
                found[-1][1] = start + window
            else:
                found.append([start, start + window])
    return [(a, b) for a, b in found]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, each kind leftmost and without overlap; offsets are code points."""
    return ([("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
            + [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
            + [("hex", *m.span()) for m in HEX.finditer(text)])


def without_placeholders(text: str) -> list[tuple[int, str]]:
    """The stretches between placeholder words, with their starts."""
    found = list(PLACEHOLDER.finditer(text))
    starts, ends = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)]
    return [(a, text[a:b]) for a, b in zip(starts, ends)]


def entropy_spans(text: str, classes=CLASSES, allowed=ALLOWED) -> list[tuple[str, int, int]]:
    """Random windows without placeholder words in the candidate strings that no allow-list pattern matches."""
    found = []
    for kind, run, window, bits in classes:
        for m in run.finditer(text):
            if not any(p.fullmatch(m[0]) for p in allowed):
                found += [(kind, m.start() + at + a, m.start() + at + b) for at, part in without_placeholders(m[0])
                          for a, b in random_spans(part, window, bits)]
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with n_assign, n_access, n_hex, base_sha256 and all spans.

    A null or empty text has no spans. Rows are judged one by one, so repeated rows get
    equal results; kept columns pass through, and those named like a result give way.
    """
    def compute(texts: pa.Array):
        rows = []
        for part in slices(texts):
            for raw in part:
                value = (raw or b"").decode()
                base = in_order(base_spans(value))
                counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
                every = in_order(base + entropy_spans(value))
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return list(zip(*rows)) or [[]] * 5

    return with_results(docs, [text], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
                        compute, keep)


def without_spans(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with every stretch of overlapping spans replaced by the mask."""
    pieces, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            pieces += [text[at:start], mask]
        at = max(at, end)
    return "".join(pieces) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """Documents with all secrets masked. Null texts stay null; the length column, if there is one, follows a
    changed text and stays as it was otherwise."""
    reads = [text] + ([length] if length in docs.columns else [])

    def compute(texts: pa.Array, lengths: pa.Array | None = None):
        values, sizes = [], lengths.to_pylist() if lengths is not None else []
        for part in slices(texts):
            for raw in part:
                value = None if raw is None else raw.decode()
                if value and (spans := base_spans(value) + entropy_spans(value)):
                    value = without_spans(value, spans, mask)
                    if sizes:
                        sizes[len(values)] = len(value)
                values.append(value)
        return [values, sizes] if lengths is not None else [values]

    schema = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in reads)
    return with_results(docs, reads, schema, compute).select(*[F.col(f"`{name.replace('`', '``')}`") for name in docs.columns])
