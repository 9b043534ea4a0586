"""Quality classifier by importance resampling (operator 6).

Two generative models over hashed n-grams are compared: one of the target (labelled documents
of good quality that are not toxic), one of the raw text (all documents).  n-grams are words,
pairs of neighbouring words, and triples of word shapes (capital, small letters, digits, the
punctuation itself; whether a word repeats the one before).  A document's log weight is the
sum of its n-grams' log ratios.  Documents are then drawn without replacement by Gumbel top-k
on log weight / temperature: k is the number of documents on the good side of the cut that
parts the held-out labels best, and the temperature the largest at which the draw is expected
to do hardly worse than that cut on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmark.llm.common import forget, free_name, in_parts, keyed_text, local_rows, table, written
from quillmark.llm.textscan import _mix, pair_hashes, word_hashes

BUCKET_BITS = 17
#: Each n-gram has a bucket in each of so many tables, so that a chance meeting in one is not taken for evidence.
TABLES = 2
TEMPERATURES = (1.0, 0.5, 0.25, 0.1, 0.05, 0.02, 0.01)


def _shapes(words: np.ndarray, heads: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of each word: digits, capital or small first letter, or the punctuation itself; and whether it repeats its predecessor."""
    kind = np.full(256, 0, np.uint64)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 3
    same = np.zeros(len(words), np.uint64)
    same[1:] = (words[1:] == words[:-1]) & inside
    shape = kind[heads]
    return np.where(shape == 0, words, shape) * np.uint64(2) + same


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the words, pairs of words and triples of word shapes of each text, each once per text.

    Words are runs of letters and digits or of other signs; A-Z count as a-z.
    """
    words, upto, heads = word_hashes(texts, split_punctuation=True, heads=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
    if not len(words):
        return owner, words
    inside = owner[1:] == owner[:-1]
    shape = _mix(_shapes(words, heads, inside) + np.uint64(0x51ED270B))
    triples = _mix(pair_hashes(shape)[:-1] * np.uint64(3) + shape[2:]) if len(words) > 2 else words[:0]
    both = inside[1:] & inside[:-1]
    value = np.concatenate([words, pair_hashes(words)[inside], triples[both]])
    owner = np.concatenate([owner, owner[1:][inside], owner[2:][both]])
    _, first = np.unique(value + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)
    return owner[first], value[first]


def buckets(value: np.ndarray) -> list[np.ndarray]:
    """Where each n-gram is counted in each table, as places in one array for all tables."""
    size = 1 << BUCKET_BITS
    return [((value >> np.uint64(64 - BUCKET_BITS * (k + 1))) & np.uint64(size - 1)).astype(np.int64) + k * size for k in range(TABLES)]


def ratios(table_: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Log ratio of each n-gram: where the tables agree in sign, the one closest to 0; else 0."""
    found = np.stack([table_[at] for at in buckets(value)])
    low, high = found.min(axis=0), found.max(axis=0)
    return np.where(low > 0, low, np.where(high < 0, high, 0.0))


def log_ratios(raw: np.ndarray, target: np.ndarray, share: float, prior: float, deviations: float) -> np.ndarray:
    """Per bucket, from the documents that hold it among all and in the target; ``share`` of all are in the target.

    What half of the buckets hold at least is taken to be rare n-grams that met there, and
    subtracted.  A log ratio shrinks with the evidence for it: to half where the target count
    is ``deviations`` standard deviations from the expected one, with the fourth power of these
    below; none is set to 0.
    """
    expected = raw * share
    rest = float(np.median(raw)) * share
    out = np.log((np.maximum(target - rest, 0) + prior) / (np.maximum(expected - rest, 0) + prior))
    evidence = ((target - expected) ** 2 / (expected + prior)) ** 2
    return out * evidence / (evidence + deviations**4)


@dataclass(frozen=True)
class ImportanceModel:
    """log ratio of target to raw by bucket; cut: log weight from which a document is good; temperature of the draw."""

    log_ratio: np.ndarray
    cut: float
    temperature: float = 1.0


def _bounded_labels(labels: DataFrame, bound: int) -> list[tuple[int, bool]]:
    """(doc_id, in the target) of at most ``bound`` labelled documents, chosen by hash.

    A document is in the target if all its labels have quality 1 and toxic 0; rows with a
    null in them don't count.
    """
    rows = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return [(r.doc_id, r.good) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()]


def fit(docs: DataFrame, labels: DataFrame, bound: int = 100_000, prior: float = 1.0, deviations: float = 4.0) -> ImportanceModel:
    """Fits both models: the raw one on all documents, the target on at most ``bound`` labelled ones.

    Counts are of documents that hold an n-gram.  A bucket's ratio is (target count + prior) /
    (count expected of a draw from raw + prior); its logarithm is shrunk by the evidence (see
    ``log_ratios``).  Three tenths of the labelled sample are kept out of the target; on them
    the cut and the temperature are found.  Without labels all log ratios are 0 and nothing
    is cut.
    """
    sample = _bounded_labels(labels, bound)
    held_out = dict(sample[::10] + sample[3::10] + sample[7::10])
    good = {k for k, g in sample if g and k not in held_out}
    size = TABLES << BUCKET_BITS

    def count(batches):
        # the last place counts the documents themselves
        raw, target = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for part, texts in in_parts(batches, 1_000_000):
            owner, value = ngrams(texts)
            mine = np.array([k in good for k in part.column(0).to_pylist()], bool)
            inside = mine[owner]
            raw[size] += len(texts)
            target[size] += int(mine.sum())
            for at in buckets(value):
                raw[:size] += np.bincount(at, minlength=size)
                if inside.any():
                    target[:size] += np.bincount(at[inside], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counted = keyed_text(docs).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size + 1), np.zeros(size + 1)
    found = counted.toArrow()  # at most TABLES * 2**BUCKET_BITS + 1 rows
    at = found["bucket"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    share = target[size] / max(1.0, raw[size])
    ratio = log_ratios(raw[:size], target[:size], share, prior, deviations) if share else np.zeros(size)
    model = ImportanceModel(ratio.astype(np.float32), -np.inf)
    if not held_out or not share:
        return model
    mine = keyed_text(docs).join(F.broadcast(local_rows(docs.sparkSession, {"doc_id": ("long", list(held_out))})), "doc_id", "left_semi")
    scores = score(mine, model).toArrow()  # at most 0.3 * bound rows, and their copies
    weight = scores["log_weight"].to_numpy()
    is_good = np.array([held_out[k] for k in scores["doc_id"].to_pylist()], bool)
    cut = best_cut(weight, is_good)
    return ImportanceModel(model.log_ratio, cut, best_temperature(weight, is_good, cut))


def best_cut(weight: np.ndarray, good: np.ndarray, care: float = 4.0) -> float:
    """The cut with the fewest errors; losing a good document counts ``care`` times.

    It lies midway between the two weights that it parts; -inf if keeping all is best.
    """
    if not len(weight):
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    # errors if the first i go
    errors = np.concatenate([[0], np.cumsum(np.where(g, care, -1.0))])
    possible = np.concatenate([[True], w[1:] != w[:-1], [True]])
    i = int(np.argmin(np.where(possible, errors, np.inf)))
    return -np.inf if i == 0 else np.inf if i == len(w) else float((w[i - 1] + w[i]) / 2)


def best_temperature(weight: np.ndarray, good: np.ndarray, cut: float, care: float = 4.0, slack: float = 0.004) -> float:
    """The largest of ``TEMPERATURES`` at which a draw of as many documents as pass the cut is expected to err hardly more.

    A document of weight w is drawn if w / temperature + Gumbel noise passes a bound, of which
    the probability is known; the bound is the one that as many pass in the mean.  Up to
    ``slack`` more errors per document are allowed; if no temperature does, it is the least.
    """
    share = float((weight >= cut).mean()) if len(weight) else 1.0
    if not 0 < share < 1:
        return TEMPERATURES[0]
    errors = care * (good & (weight < cut)).sum() + (~good & (weight >= cut)).sum()
    for t in TEMPERATURES:
        low, high = weight.min() / t - 50, weight.max() / t + 50
        for _ in range(80):
            bound = (low + high) / 2
            lost = np.exp(-np.exp(np.minimum(weight / t - bound, 700)))
            low, high = (bound, high) if 1 - lost.mean() > share else (low, bound)
        if care * lost[good].sum() + (1 - lost[~good]).sum() <= errors + slack * len(weight):
            return t
    return TEMPERATURES[-1]


def _weights(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    owner, value = ngrams(texts)
    return np.round(np.bincount(owner, weights=ratios(ratio, value), minlength=len(texts)) + 0.0, 6)


def score(docs: DataFrame, model: ImportanceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key as ``doc_id`` and ``log_weight``; 0 for empty and null texts."""
    table_ = docs.sparkSession.sparkContext.broadcast(model.log_ratio)  # TABLES * 2**BUCKET_BITS floats

    def run(batches):
        for part, texts in in_parts(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_weights(texts, table_.value))], names=["doc_id", "log_weight"])

    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, log_weight double")


def gumbel_key(weight: str, temperature: float, seed: int, key: str = "doc_id"):
    """Log weight / temperature plus Gumbel noise from the hash of the key and the seed, as a column."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key).cast("long"), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.col(weight) / temperature - F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest double of a column: counts of 65,536 slots, then of those of one slot, and so on."""
    if k <= 0:
        return float("inf")
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return float("inf")
    while True:
        width = (hi - lo) / 65536
        if not width > 0 or lo + width == lo:
            return lo
        slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(65535)).cast("int")
        rows = df.filter((F.col(column) >= lo) & (F.col(column) <= hi)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.slot):
            if k <= r.n:
                break
            k -= r.n
        if r.lo == r.hi or (r.lo, r.hi) == (lo, hi):
            return r.lo
        lo, hi = r.lo, r.hi


def keep_rule(docs: DataFrame, model: ImportanceModel, seed: int) -> tuple[DataFrame, float]:
    """(doc_id, log_weight and key of every document as a written table; smallest key drawn)."""
    scored = written(score(docs, model).withColumn("key", gumbel_key("log_weight", model.temperature, seed)), "weights")
    k = scored.filter(F.col("log_weight") >= F.lit(model.cut)).count()
    return scored, kth_largest(scored, "key", k)


def resample(docs: DataFrame, labels: DataFrame, temperature: float | None = None, seed: int = 7, bound: int = 100_000) -> DataFrame:
    """The documents drawn: rows of ``docs`` (doc_id and text among the columns) with all their columns.

    Null and empty texts weigh 0, like text that says nothing about quality.  Rows that repeat
    a doc_id and text are drawn together.  Equal keys at the limit are all drawn.  Without
    labels everything is; no rows give no rows.  A lower ``temperature`` keeps the draw closer
    to the weights' order; None takes the fitted one (``best_temperature``).  doc_id must be
    a whole number, null included.
    """
    model = fit(docs, labels, bound)
    if temperature is not None:
        model = ImportanceModel(model.log_ratio, model.cut, temperature)
    scored, least = keep_rule(docs, model, seed)
    forget(scored)
    names = docs.columns
    weight = free_name("log_weight", names)
    sent = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    def run(batches):
        for part, texts in in_parts(batches, 1_000_000):
            yield part.append_column(weight, pa.array(_weights([t or "" for t in texts], sent.value)))

    picked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(weight, DoubleType())]))
    return picked.filter(gumbel_key(weight, model.temperature, seed) >= F.lit(least)).select(*names)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn: doc_id, log_weight and key."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored, least = keep_rule(docs, fit(docs, labels), 7)
    return scored.filter(F.col("key") >= F.lit(least)).select("doc_id", "log_weight", "key")
