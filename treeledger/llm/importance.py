"""Resampling of documents towards a target set, by hashed n-gram importance weights."""

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.batches import slices, with_results
from treeledger.sources.workspace import materialize

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20

# A separator is any ASCII character but a digit or a small letter; capitals are lowered before.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# At each word that the text or a space precedes: the word, and where they follow the next one and the one after.
_GRAMS = regex.compile(rb"(?<![^ ])([^ ]++)(?:( [^ ]++)( [^ ]++)?+)?+")


def feature_buckets(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the bucket of every run of one to three words, in no set order.

    Separators become single spaces. Matches begin one byte apart at least and may overlap;
    each gives the spans of up to three features, whose checksums continue each other.
    """
    plain = _SEPARATORS.sub(b" ", (text or b"").translate(_LOWER)).strip(b" ")
    crc, found, words = zlib.crc32, [], 0
    add = found.append
    for match in _GRAMS.finditer(plain, overlapped=True):
        one, two, three = match.groups()
        words += 1
        value = crc(one)
        add(value)
        if two is not None:
            value = crc(two, value)
            add(value)
            if three is not None:
                add(crc(three, value))
    return words, (np.array(found, np.uint32) % np.uint32(buckets)).astype("<u4")


def with_features(docs: DataFrame, text: str, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The kept columns with n_words, n_features, and features: the buckets, packed."""
    def compute(texts: pa.Array):
        rows = [feature_buckets(t, buckets) for part in slices(texts) for t in part]
        return [[w for w, _ in rows], [len(f) for _, f in rows], [_packed(f) for _, f in rows]]

    return with_results(docs, [text], "n_words long, n_features long, features binary", compute, keep)


def _packed(features: np.ndarray) -> bytes:
    """Two bytes a feature where that is enough, four otherwise, after a byte that says how many."""
    wide = len(features) and int(features.max()) > 0xFFFF
    return (b"\x04" + features.tobytes()) if wide else (b"\x02" + features.astype("<u2").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[:1] == b"\x04" else "<u2", offset=1)


def histogram(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features; each task sends one row per bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("features").to_pylist():
                total += np.bincount(_unpacked(raw), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return featured.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """What a feature in each bucket adds to a document's weight, in thousandths, rounded down."""
    def counts(found):
        out = np.zeros(buckets)
        out[list(found.keys())] = list(found.values())
        return out

    s, t = counts(corpus), counts(target)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    def compute(features: pa.Array):
        return [[int(gain[_unpacked(raw)].sum()) for raw in features.to_pylist()]]

    return with_results(featured, ["features"], "weight long", compute, ["doc_id", "n_words", "n_features"])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, rounded down, that depends on the id alone; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank to the share of best scores among documents with enough words; null elsewhere.

    The order is made by a range sort; the rows of its written parts, counted, give every
    part the rank that it starts from.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"]
    able = scored.where(F.col("n_words") >= least_words)
    at = F.monotonically_increasing_id()
    laid = materialize(able.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_part", F.spark_partition_id()).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    limit = F.floor(laid.agg(F.count(F.lit(1))).scalar() * percent / 100)
    rank = F.col("_before") + F.col("_at") + 1
    ranked = laid.join(F.broadcast(parts), "_part").withColumn("rank", F.when(rank <= limit, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank.

    A weight is the sum over all features of a document of the logarithm of how much more
    frequent their buckets are in the target than among the documents, smoothed by one. The
    score adds noise made from the id, so that the best scores are a draw without
    replacement; `percent` of the documents with enough words get a rank, the others null.
    Null and empty texts have no features and weight 0. Repeated rows are ranked each; equal
    scores go by id, a null id last. Texts are read once: their features are written out, two
    bytes each. Only the two tables of `buckets` counts come to the driver.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    featured = materialize(with_features(docs, "text", ["doc_id"], buckets))
    wanted = with_features(target.select(F.col(target_text).alias("text")), "text", [], buckets)
    counts = [{r.bucket: r.n for r in histogram(side, buckets).collect()} for side in (featured, wanted)]
    scored = weighted(featured, gains(*counts, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(materialize(scored), percent, least_words)
