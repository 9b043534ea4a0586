"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 5).

An item of n characters that occurs in a text with at most k edits shares at least
n + 1 - q - kq of its q-grams with the text, on diagonals at most k apart.  Texts are
normalised, windows that hold too few q-grams of any item are passed over, the others' hits
are counted in diagonal bands of width 2(k + 1) that overlap by half, and bands that reach the
bound are aligned within the band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmark.llm.common import free_name, in_parts, keyed_text, sized, table, written

Q = 8
_MULT = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x3000)), bool, 0x3000)


def _solid(code: np.ndarray) -> np.ndarray:
    low = _alnum()
    out = low[np.minimum(code, len(low) - 1)]
    for k in np.flatnonzero(code >= len(low)):
        out[k] = chr(int(code[k])).isalnum()
    return out


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, place of each in its text, number of them up to and with each text).

    Lower case; a run of characters that are neither letters nor digits is one space.  A
    text's part ends with a 0.
    """
    joined = "\0".join(_lower(t) if "\0" not in t else _lower(t.replace("\0", " ")) for t in texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = ~_solid(code)
    end = code == 0
    keep = ~gap | end
    keep[1:] |= gap[1:] & ~gap[:-1]
    at = np.flatnonzero(keep)
    out = np.where(gap[at] & ~end[at], 32, code[at])
    upto = np.flatnonzero(out == 0) + 1
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    return out, at - np.repeat(first, np.diff(upto, prepend=0)), upto


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place on; Q is a power of two."""
    h, span = code.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        factor = _MULT
        while span < Q:
            h = h[:-span] + h[span:] * np.uint64(factor)
            factor, span = factor * factor & (1 << 64) - 1, span * 2
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ItemIndex:
    """Benchmark items by q-gram: postings sorted by hash, a bit table in front of them."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    post_item: np.ndarray
    post_at: np.ndarray
    table: np.ndarray
    shift: int
    window: int
    least: int


def build_index(rows: list[tuple], rate: float, shortest: int = 32) -> ItemIndex | None:
    """Of the (key, text) of at least ``shortest`` normalised characters; None if there are none.

    Raises where ``rate`` allows an item more edits than leave a fifth of its q-grams to count on.
    """
    ids, items = [], []
    for key, text in rows:
        code, _, upto = normalised([text or ""])
        code = code[: upto[0] - 1]
        while len(code) and code[0] == 32:
            code = code[1:]
        while len(code) and code[-1] == 32:
            code = code[:-1]
        if len(code) >= max(Q, shortest):
            ids.append(key)
            items.append(code)
    if not items:
        return None
    n = np.array([len(x) for x in items])
    budget, most = (rate * n).astype(np.int64), (n + 1 - Q - (n + 1 - Q) // 5) // Q
    if (budget > most).any():
        k = int(np.argmax(budget > most))
        raise ValueError(f"{rate} edits a character are too many for q-grams of {Q}: item {ids[k]} of {n[k]} characters may have {most[k]}; lower the rate or raise the shortest length")
    bound = n + 1 - Q - budget * Q
    hashes = [gram_hashes(x) for x in items]
    h = np.concatenate(hashes)
    post_item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
    post_at = np.concatenate([np.arange(len(x)) for x in hashes])
    order = np.argsort(h, kind="stable")
    h, post_item, post_at = h[order], post_item[order], post_at[order]
    keys, begin = np.unique(h, return_index=True)
    bits = max(16, min(26, math.ceil(math.log2(len(keys) * 128))))
    marks = np.zeros(1 << bits, bool)
    marks[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    # an occurrence spans n + k places; a window of the shortest span has this many hits
    window = int((n + budget).min())
    least = int(min(max(math.ceil(b / math.ceil((m + k) / window)), b - (m + k - window)) for b, m, k in zip(bound.tolist(), n.tolist(), budget.tolist())))
    return ItemIndex(ids, items, budget, bound, keys, np.append(begin, len(h)), post_item, post_at, marks, 64 - bits, window, max(1, least))


def banded_edits(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fewest edits between the item and any substring of each region, where that substring ends).

    Row i holds the diagonals 0..width of a region of len(item) + width places: an alignment
    may begin on any of them and must stay on them.  Ties go to the first end.
    """
    n, width = len(item), regions.shape[1] - len(item)
    ramp = np.arange(width + 1, dtype=np.int32)
    best = np.zeros((len(regions), width + 1), np.int32)
    for i in range(n):
        # diagonal c of row i + 1 stands behind place i + c
        step = best + (regions[:, i : i + width + 1] != item[i] if i + width + 1 <= regions.shape[1] else np.pad(regions[:, i:], ((0, 0), (0, 1)))[:, : width + 1] != item[i])
        step[:, :-1] = np.minimum(step[:, :-1], best[:, 1:] + 1)
        best = np.minimum.accumulate(step - ramp, axis=1) + ramp
    end = best.argmin(axis=1)
    return best[np.arange(len(regions)), end], end + n


def _place_of(item: np.ndarray, region: np.ndarray) -> int:
    """Where the item stands in the region unedited; -1 if nowhere."""
    data, sought = region.astype(np.uint32).tobytes(), item.astype(np.uint32).tobytes()
    at = data.find(sought)
    while at % 4 and at >= 0:
        at = data.find(sought, at + 1)
    return at // 4 if at >= 0 else -1


def _cut(code: np.ndarray, low: np.ndarray, size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of ``size`` places from ``low`` on; 0 where that is outside first..last."""
    at = low[:, None] + np.arange(size)
    inside = (at >= first[:, None]) & (at < last[:, None])
    return np.where(inside, code[np.clip(at, 0, len(code) - 1)], 0)


def find(texts: list[str], index: ItemIndex) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits), places in the text as given, non-overlapping per item."""
    code, place, upto = normalised(texts)
    if len(code) < Q:
        return
    first = np.concatenate([[0], upto[:-1]])
    h = gram_hashes(code)
    hit = index.table[(h >> np.uint64(index.shift)).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    w = min(index.window, len(hit))
    dense = total[w:] - total[:-w] >= index.least
    if not dense.any():
        return
    # places that some dense window covers: dense ones among the last w window starts
    upto_dense = np.concatenate([np.zeros(w, np.int32), np.cumsum(dense, dtype=np.int32), np.zeros(w - 1, np.int32)])
    upto_dense[w + len(dense) :] = upto_dense[w + len(dense) - 1]
    at = np.flatnonzero(hit & (upto_dense[w:] > upto_dense[:-w]))
    k = np.searchsorted(index.keys, h[at])
    k[k == len(index.keys)] = 0
    true = index.keys[k] == h[at]
    at, k = at[true], k[true]
    if not len(at):
        return
    count = index.begin[k + 1] - index.begin[k]
    row = np.repeat(np.arange(len(at)), count)
    post = index.begin[k][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    item = index.post_item[post]
    diagonal = at[row] - index.post_at[post]
    text = np.searchsorted(upto, at, "right")[row]
    half = index.budget[item] + 1
    band = diagonal // half
    # each hit is in the band that begins with its half and in the one before
    lowest, span = int(band.min()) - 1, int(band.max() - band.min()) + 2
    one = (text * len(index.items) + item) * span + (band - lowest)
    both = np.concatenate([one, one - 1])
    both.sort()
    edge = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    size = np.diff(np.append(edge, len(both)))
    owner, c = np.divmod(both[edge], span)
    a, b = np.divmod(owner, len(index.items))
    good = size >= index.bound[b]
    a, b, c = a[good], b[good], c[good] + lowest
    found = []
    for i in np.unique(b).tolist():
        mine = np.flatnonzero(b == i)
        n, edits = len(index.items[i]), int(index.budget[i])
        low = c[mine] * (edits + 1) - edits
        width = 2 * (edits + 1) + 2 * edits
        for part in range(0, len(mine), 512):
            lo, t = low[part : part + 512], a[mine][part : part + 512]
            regions = _cut(code, lo, n + width, first[t], upto[t] - 1)
            whole = [_place_of(index.items[i], r) for r in regions]
            for x in [x for x, at in enumerate(whole) if at >= 0]:
                found.append((int(t[x]), i, int(lo[x]) + whole[x], int(lo[x]) + whole[x] + n, 0))
            other = np.array([x for x, at in enumerate(whole) if at < 0], np.int64)
            if not len(other):
                continue
            lo, t = lo[other], t[other]
            cost, end = banded_edits(index.items[i], regions[other])
            near = np.flatnonzero(cost <= edits)
            if len(near):
                t, stop = t[near], lo[near] + end[near]
                back = _cut(code, stop - n - edits, n + edits, first[t], upto[t] - 1)[:, ::-1]
                _, length = banded_edits(index.items[i][::-1], back)
                begin, stop = np.maximum(stop - length, first[t]), np.minimum(stop, upto[t] - 1)
                found += zip(t.tolist(), [i] * len(near), begin.tolist(), stop.tolist(), cost[near].tolist())
    found.sort(key=lambda f: (f[0], f[1], f[4], f[2]))
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, i, lo, hi, cost in found:
        others = taken.setdefault((t, i), [])
        if hi > lo and all(hi <= x or lo >= y for x, y in others):
            others.append((lo, hi))
            yield t, i, int(place[lo]), int(place[hi - 1]) + 1, cost


def find_items(docs: DataFrame, items: DataFrame, rate: float = 0.08, shortest: int = 32, block_chars: int = 4_000_000, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): occurrences of benchmark items in whole texts.

    An item occurs where a substring of the normalised text is within ``rate`` edits per
    character of it.  start and end are code points of the text as given; edits are in
    normalised text.  An item's occurrences in a text don't overlap.  Items of fewer than
    ``shortest`` normalised characters are taken as too short to be evidence and are not looked
    for (``short_items`` lists them); null and empty texts hold nothing; null keys and
    repeated rows stay.  A rate that is too high for the q-gram lemma raises.  Keys of documents
    must be whole numbers.

    The items' total length is measured first.  Up to ``block_chars`` characters are sent to
    the tasks at a time; a larger benchmark is dealt into blocks by hash, and the documents are
    scanned once for each.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.length("text") >= shortest)
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    schema = f"doc_id long, item_id {wanted.schema['item_id'].dataType.simpleString()}, start long, end long, edits int"
    kind = to_arrow_type(wanted.schema["item_id"].dataType)
    own, out = keyed_text(docs, key, text), None
    for k in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = build_index([tuple(r) for r in rows], rate, shortest)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            at = sent.value
            for part, texts in in_parts(batches, 1_000_000):
                keys = part.column(0)
                hits = list(find(texts, at))
                if hits:
                    t, i, lo, hi, cost = zip(*hits)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(t)), pa.array([at.ids[x] for x in i], kind), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(cost, pa.int32())], names=["doc_id", "item_id", "start", "end", "edits"])

        some = own.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], schema)


def short_items(items: DataFrame, shortest: int = 32, item_text: str = "text") -> DataFrame:
    """The rows of ``items`` that ``find_items`` does not look for: null or of too few normalised characters."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(item_text)).to_pylist()]
            code, _, upto = normalised(texts) if texts else (np.zeros(0), None, np.zeros(0, np.int64))
            sizes = [len("".join(map(chr, code[a : e - 1])).strip(" ")) for a, e in zip([0, *upto[:-1]], upto)]
            yield b.filter(pa.array([n < max(Q, shortest) for n in sizes], pa.bool_()))

    return items.mapInArrow(run, items.schema)


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = 0.08, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose key is not that of a text with a benchmark item (``find_items``).

    The keys found are written and counted first; many are joined by sorting, few are sent to
    the documents.
    """
    names = docs.columns
    hit = free_name("hit", names)
    hits = written(find_items(docs, items, rate, key=key, text=text).select(F.col("doc_id").alias(hit)).distinct(), "contaminated")
    return docs.join(sized(hits), F.col(key).eqNullSafe(F.col(hit)), "left_anti").select(*names)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
