"""Language identification with Kneser-Ney character models, one per language."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results
from treeledger.sources.workspace import materialize

ORDER, BITS = 4, 16
PER_LANGUAGE = 1000  # documents fitted for a language
MOST_LANGUAGES, MODEL_BYTES = 100_000, 1 << 30  # beyond these, fit refuses
HELD = 1 << 22  # log probabilities held at once, over characters and languages
REJECTED = 0.995  # share of calibration texts of a language whose cross-entropy is accepted
SHARPNESS = 50  # characters that a score is based on at most
BREAK, OTHER, FIRST = 0, 1, 2  # character numbers: anything but letters, letters never seen, letters


class Table(NamedTuple):
    """N-grams of one order as a sorted array, with their log probabilities per language;
    and the same for contexts, with the log weight of the next lower order."""
    grams: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    numbers: np.ndarray
    tables: list[tuple]
    limits: list[float]


def letter_numbers(seen: list[int]) -> np.ndarray:
    """Number of each code point: letters in lower case that were seen, other letters, the rest."""
    lower = sorted({ord(chr(c).lower()[0]) for c in seen if chr(c).isalpha()})[:(1 << BITS) - FIRST]
    number = {c: i for i, c in enumerate(lower, FIRST)}
    return np.array([number.get(ord(c.lower()[0]), OTHER) if c.isalpha() else BREAK for c in map(chr, range(0x110000))],
                    np.uint16)


def sequences(texts: list[bytes | None], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, owner) at each character of texts put end to end.

    Letters keep their numbers, each stretch of others counts as one break, and a text
    begins and ends in a break. A code holds a character and the three before it.
    """
    values = [(raw or b"").decode() for raw in texts]
    points = np.frombuffer("".join(v + "\0" for v in values).encode("utf-32-le", "surrogatepass"), "<u4")
    ids = numbers[points]
    owner = np.repeat(np.arange(len(values), dtype=np.int32), [len(v) + 1 for v in values])
    kept = (ids != BREAK) | (np.r_[np.uint16(BREAK), ids[:-1]] != BREAK)
    ids, owner = ids[kept].astype(np.uint64), owner[kept]
    codes = ids.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(ids)
        before[back:] = np.where(owner[back:] == owner[:-back], ids[:-back], np.uint64(0))
        codes |= before << np.uint64(BITS * back)
    return codes, owner


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, the sums of their values and their numbers of rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values, np.diff(np.r_[starts, len(keys)])


def at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return slot, table[slot] == keys


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], letters: int) -> list[tuple]:
    """Tables of orders 1 to ORDER from each language's (sorted codes, counts) of the highest order.

    The highest order keeps its counts; below, an n-gram counts the characters seen before
    it. Every order takes one absolute discount n1/(n1+2*n2) from all counts and hands it to
    the order below, the lowest to all characters alike.
    """
    levels = {ORDER: [(codes, n.astype(np.float64)) for codes, n in counts]}
    for order in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << BITS * order) - 1)
        levels[order] = []
        for codes, _ in levels[order + 1]:
            keys, _, rows = grouped(np.sort(codes & mask), np.ones(len(codes)))
            levels[order].append((keys, rows.astype(np.float64)))
    tables: list[tuple] = []
    for order in range(1, ORDER + 1):
        shift = np.uint64(BITS)
        grams = (np.arange(letters + FIRST, dtype=np.uint64) if order == 1
                 else np.unique(np.concatenate([codes for codes, _ in levels[order]])))
        contexts = np.unique(grams >> shift) if order > 1 else np.zeros(1, np.uint64)
        logs = np.empty((len(grams), len(counts)), np.float32)
        weights = np.zeros((len(contexts), len(counts)), np.float32)
        for i, (codes, n) in enumerate(levels[order]):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own, total, kinds = grouped(codes >> shift if order > 1 else np.zeros(len(codes), np.uint64), n)
            slot, known = at(own, contexts)
            sums = np.where(known, total[slot] if len(own) else 1.0, 1.0)
            weight = np.where(known, discount * kinds[slot] / sums if len(own) else 1.0, 1.0)
            weights[:, i] = np.log(weight)
            place, seen = at(codes, grams)
            within = at(contexts, grams >> shift if order > 1 else np.zeros(len(grams), np.uint64))[0]
            share = np.where(seen, np.maximum((n[place] if len(n) else 0.0) - discount, 0.0), 0.0) / sums[within]
            if order == 1:
                lower = np.full(len(grams), 1.0 / len(grams))
            else:
                lower = np.exp(tables[-1][1][at(tables[-1][0], grams & np.uint64((1 << BITS * (order - 1)) - 1))[0], i])
            logs[:, i] = np.log(share + weight[within] * lower)
        tables.append(tuple(Table(grams, logs, contexts, weights)))
    return tables


def log_probabilities(codes: np.ndarray, tables: list[tuple], order: int = ORDER) -> np.ndarray:
    """Per code and language the log probability of its last character after the others."""
    grams, logs, contexts, weights = tables[order - 1]
    slot, known = at(grams, codes)
    out = logs[slot]
    if order > 1 and not known.all():
        rest = np.flatnonzero(~known)
        lower, found = at(contexts, codes[rest] >> np.uint64(BITS))
        fallen = log_probabilities(codes[rest] & np.uint64((1 << BITS * (order - 1)) - 1), tables, order - 1)
        out[rest] = fallen + np.where(found[:, None], weights[lower], np.float32(0))
    return out


def cross_entropies(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of characters (0 without a letter) and, per language, nats a character."""
    codes, owner = sequences(texts, model.numbers)
    sizes = np.bincount(owner, minlength=len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    step = max(1, HELD // max(1, len(model.languages)))
    for first in range(0, len(codes), step):
        own = owner[first:first + step]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        logs = log_probabilities(codes[first:first + step], model.tables)
        sums[own[starts]] += np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
    return sizes, -sums / np.maximum(sizes, 1)[:, None]


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def sample_of(docs: DataFrame, doc_id: str, text: str, label: str, held_out: int, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, fold, text) of at most `per_language` labelled documents of every language.

    Documents whose remainder is held out, without a label, text or id are left aside. The
    choice goes by a hash of the id: first by share, so that little is moved, then by rank.
    """
    labelled = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h")).where(
        F.col(label).isNotNull() & F.col(text).isNotNull() & (remainder(doc_id) != held_out))
    sizes = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"{label} has more than {MOST_LANGUAGES} values and names no languages")
    share = F.lit(2.0 * per_language) / F.col("n")
    near = labelled.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= per_language)
    return chosen.select("lang", (F.col("rank") % 5 == 0).alias("calibrates"), "text")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", held_out: int = 2,
        per_language: int = PER_LANGUAGE, model_bytes: int = MODEL_BYTES) -> Model:
    """Fit models of all languages on at most `per_language` documents of each; what reaches the driver is bounded by it too.

    The models go to the tasks by a broadcast; ValueError if they would take more than model_bytes.
    """
    sample = materialize(sample_of(docs, doc_id, text, label, held_out, per_language))
    languages = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]

    def points(batches):
        for batch in batches:
            seen = [np.unique(np.frombuffer((raw or b"").decode().encode("utf-32-le"), "<u4"))
                    for part in slices(batch.column("text")) for raw in part]
            found = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["point"])

    numbers = letter_numbers([r[0] for r in sample.select("text").mapInArrow(points, "point int").distinct().collect()])
    shared = sample.sparkSession.sparkContext.broadcast(numbers)

    def grams(batches):
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            done = 0
            for part in slices(batch.column("text")):
                codes, owner = sequences(part, shared.value)
                which = lang[done:done + len(part)][owner]
                done += len(part)
                for own in np.unique(which):
                    keys, n = np.unique(codes[which == own], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), own)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    fitted = sample.where("NOT calibrates").select("lang", "text").mapInArrow(grams, "lang long, code long, n long")
    rows = fitted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, codes, n = (rows.column(c).to_numpy() for c in ("lang", "code", "n"))
    if 4 * len(languages) * len(np.unique(codes)) > model_bytes:
        raise ValueError(f"the models of {len(languages)} languages would take more than {model_bytes} bytes; lower per_language")
    counts = []
    for i in range(len(languages)):
        own = codes[lang == i].view(np.uint64)
        order = np.argsort(own)
        counts.append((own[order], n[lang == i][order]))
    model = Model(languages, numbers, kneser_ney(counts, int(numbers.max()) + 1 - FIRST) if languages else [], [])
    return model._replace(limits=calibrate(sample.where("calibrates"), model))


def calibrate(sample: DataFrame, model: Model) -> list[float]:
    """Per language the cross-entropy that the given share of its calibration texts stays below."""
    if not model.languages:
        return []
    shared = sample.sparkSession.sparkContext.broadcast(tuple(model))

    def compute(texts: pa.Array):
        own = Model(*shared.value)
        return [[row for part in slices(texts) for row in cross_entropies(part, own)[1].min(axis=1).tolist()]]

    best = with_results(sample, ["text"], "nats double", compute, ["lang"])
    limits = {r[0]: r[1] for r in best.groupBy("lang").agg(F.percentile("nats", REJECTED)).collect()}
    return [limits.get(language, np.inf) for language in model.languages]


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred, score and accepted.

    A null text or one without letters is `und` with score 0, and so is everything if no
    language was learned. Otherwise the language of the least cross-entropy a character is
    taken, the first by name among equals; score is its share of the likelihoods of up to
    SHARPNESS characters. accepted is false where the cross-entropy is beyond what the
    language's own calibration texts have. Every text is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def compute(texts: pa.Array):
        own = Model(*shared.value)
        rows = []
        for part in slices(texts):
            if not own.languages:
                rows += [("und", 0.0, False)] * len(part)
                continue
            sizes, nats = cross_entropies(part, own)
            best = nats.argmin(axis=1)
            least = nats[np.arange(len(part)), best]
            odds = np.exp((least[:, None] - nats) * np.minimum(sizes, SHARPNESS)[:, None])
            for n, i, x, score in zip(sizes.tolist(), best.tolist(), least.tolist(), (1 / odds.sum(axis=1)).tolist()):
                rows.append((own.languages[i], score, x <= own.limits[i]) if n else ("und", 0.0, False))
        return list(zip(*rows)) or [[]] * 3

    return with_results(docs, [text], "lang_pred string, score double, accepted boolean", compute, keep)
