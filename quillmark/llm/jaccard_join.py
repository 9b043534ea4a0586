"""N-gram Jaccard join by universe partition and pigeonhole (operator 4).

Sets whose Jaccard similarity reaches the threshold and whose sizes lie in one band or in
neighbouring bands differ in at most H elements.  The universe of shingles is cut by hash
into segments, so an element that only one of the sets has spoils one segment:

* larger sets: H + 1 + k segments, of which k + 1 must agree wholly;
* smaller sets: floor(H / 2) + 1 + k segments, of which k + 1 differ in at most one element;
  such a segment is indexed with all its one-deletion neighbours.

Which of the two a band uses, and k, follows from a cost model: the number of signatures,
against the share of empty and nearly empty segments, which hardly tell sets apart.  The smallest segments of a
set, up to k (half of that, where neighbours are indexed), need no signature: of k + 1 that
agree, the two sets together drop no more than k.
Every pair that shares a signature is compared exactly, unless links found before already
connect it or their sketches rule a link out: a sketch counts a set's elements in each of 256
parts of the universe, and two sets have at most the sum of the lesser counts in common.  So
sets themselves are moved only for pairs that are links or nearly so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import by_weight, forget, in_parts, keyed_text, sized, table, written
from quillmark.llm.components import components
from quillmark.llm.textscan import _mix, shingles

#: Parts of the universe that a sketch counts in: the values of one byte.
PARTS = 256


@dataclass(frozen=True)
class Scheme:
    """How sets of sizes low..high are signed to find pairs whose smaller set is in the scheme's band."""

    number: int
    errors: int
    segments: int
    spare: int
    neighbours: bool


def plan(size: int, number: int, least: int, most: int, num: int, den: int) -> Scheme:
    """The cheaper way to sign a band of sizes least..most (of the smaller set)."""
    errors = (most + most * den // num) * (den - num) // (den + num)
    # a: segments that must agree wholly
    spare = 2 + math.ceil(0.1 * (errors + 1))
    whole = errors + 1 + spare
    # b: segments with one-deletion neighbours
    more = 2 if errors >= 4 else 0
    near = errors // 2 + 1 + more

    def cost(signatures: float, mean: float, allowed: int, segments: int) -> float:
        empty = math.exp(-mean)
        return signatures * (1 + 12 * empty + 50 * max(0.0, empty - allowed / (2 * segments)))

    if cost(whole, least / whole, spare, whole) <= cost(least + near, least / near, more // 2, near):
        return Scheme(number, errors, whole, spare, False)
    return Scheme(number, errors, near, more // 2, True)


def bands(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """(least, most) size of each band: a set that links with one of a band is in that or a neighbouring band."""
    out, low = [], 1
    while low <= longest:
        high = max(low, (low - 1) * den // num)
        out.append((low, high))
        low = high + 1
    return out


def schemes(longest: int, num: int, den: int) -> tuple[np.ndarray, list[Scheme]]:
    """(upper ends of the bands, scheme of each band), up to the band after ``longest``."""
    b = bands(longest, num, den)
    return np.array([h for _, h in b]), [plan(low, k, low, high, num, den) for k, (low, high) in enumerate(b)]


def signatures(values: np.ndarray, bounds: np.ndarray, docs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document place) of the sets ``values[bounds[d]:bounds[d + 1]]`` for d in ``docs``."""
    size = np.diff(bounds)[docs]
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends, plans = schemes(int(size.max()), num, den)
    band = np.searchsorted(ends, size)
    found_s, found_d = [], []
    for s in plans:
        if s.errors == 0:
            continue
        mine = docs[(band == s.number) | (band == s.number + 1)]
        if not len(mine):
            continue
        n = np.diff(bounds)[mine]
        row = np.repeat(np.arange(len(mine)), n)
        start = np.cumsum(n) - n
        h = values[bounds[mine][row] + np.arange(len(row)) - start[row]]
        salt = np.uint64((s.number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = _mix(h ^ salt)
        m = s.segments
        at = row * m + ((x >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        value = _mix(x + salt)
        total = np.zeros(len(mine) * m, np.uint64)
        np.add.at(total, at, value)
        held = np.bincount(at, minlength=len(total))
        tag = (np.arange(len(total)) % m).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + salt
        held = held.reshape(-1, m)
        # all segments smaller than the (spare + 1)-th smallest: at most ``spare`` of them
        skip = (held < np.partition(held, s.spare, axis=1)[:, s.spare][:, None]).reshape(-1)
        use = np.flatnonzero(~skip)
        found_s.append(_mix(total[use] ^ tag[use]))
        found_d.append(mine[use // m])
        if s.neighbours:
            some = ~skip[at]
            found_s.append(_mix((total[at] - value)[some] ^ tag[at][some]))
            found_d.append(mine[row[some]])
    if not found_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_d)


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set's mixed elements, as rows."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros((n, 2), np.uint64)
    for k in range(2):
        np.add.at(out[:, k], owner, _mix(values + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)))
    return out


def set_classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch) of every row: its set's size, 128-bit fingerprint and sketch."""

    def run(batches):
        for part, texts in in_parts(batches, 1_000_000):
            values, bounds = shingles(texts, width)
            f = _fingerprints(values, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([r.tobytes() for r in sketches(values, bounds)], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def candidate_groups(docs: DataFrame, width: int, num: int, den: int, chunk: int = 4096) -> DataFrame:
    """(head, others): fingerprints of sets that share a signature, the smallest first; equal groups once per task.

    Signatures are shuffled with the first half of a set's fingerprint, 16 bytes in all; a task
    sends on one of the equal sets that it meets, and a group keeps one of those that are left.
    The exchange is sorted, so a group is streamed: a task holds some ``chunk`` members of it at
    a time, however many sets share the signature.
    """

    def sign(batches):
        met: set[int] = set()
        for part, texts in in_parts(batches, 1_000_000):
            values, bounds = shingles(texts, width)
            valid = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            prints = _fingerprints(values, bounds)[:, 0].view(np.int64)
            own = []
            for d in np.flatnonzero((np.diff(bounds) > 0) & valid).tolist():
                p = int(prints[d])
                if p not in met:
                    own.append(d)
                    if len(met) < 200_000:
                        met.add(p)
            sig, d = signatures(values, bounds, np.asarray(own, np.int64), num, den)
            for k in range(0, len(sig), 400_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + 400_000].view(np.int64)), pa.array(prints[d[k : k + 400_000]])], names=["sig", "f"])

    def group(batches):
        carry = np.zeros((0, 2), np.int64)
        told: set[int] = set()
        last = None  # (signature, its smallest fingerprint) of a group that is still coming
        out: list[tuple[int, list[int]]] = []

        def emit(prints: np.ndarray, head: int | None):
            prints = np.unique(prints)
            head = int(prints[0]) if head is None else head
            for k in range(0, len(prints), chunk):
                some = prints[k : k + chunk]
                some = some[some != head]
                mark = hash((head, some.tobytes()))
                if not len(some) or mark in told:
                    continue
                if len(told) < 200_000:
                    told.add(mark)
                out.append((head, some.tolist()))

        def flush(final: bool):
            nonlocal carry, last
            if not len(carry):
                return
            sig = carry[:, 0]
            edges = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
            lengths = np.diff(edges)
            stop = len(lengths) if final else len(lengths) - 1
            several = np.flatnonzero(lengths[:stop] > 1).tolist()
            if last is not None and stop and sig[0] == last[0] and (not several or several[0]):
                several.insert(0, 0)
            for g in several:
                going_on = last is not None and sig[edges[g]] == last[0]
                emit(carry[edges[g] : edges[g + 1], 1], last[1] if going_on else None)
            rest = carry[edges[stop] :]
            if len(rest) >= 8 * chunk:  # a very large group: send on what is there, remember its head
                going_on = last is not None and rest[0, 0] == last[0]
                head = last[1] if going_on else int(rest[:, 1].min())
                emit(rest[:, 1], head)
                last, rest = (int(rest[0, 0]), head), rest[:0]
            elif stop:
                last = None
            carry = rest

        def block():
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([m for _, m in out], pa.list_(pa.int64()))], names=["head", "others"])

        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1)
            carry = np.concatenate([carry, rows]) if len(carry) else rows
            flush(False)
            if out:
                yield block()
                out = []
        flush(True)
        if out:
            yield block()

    signed = docs.mapInArrow(sign, "sig long, f long")
    return signed.repartition("sig").sortWithinPartitions("sig", "f").mapInArrow(group, "head long, others array<long>")


def _members(ids: DataFrame, bits: int) -> bytes:
    """A set of ``bits`` bits that holds the hashes of all ids."""
    shift = np.uint64(64 - (bits - 1).bit_length())

    def run(batches):
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            x = _mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> shift
            np.bitwise_or.at(held, (x >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of elements of each set in each part of the universe, 255 standing for as many or more."""
    n = len(bounds) - 1
    out = np.zeros((n, PARTS), np.uint8)
    part = (_mix(values ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(56)).astype(np.int64)
    for low in range(0, n, 2048):
        high = min(n, low + 2048)
        owner = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
        held = np.bincount(owner * PARTS + part[bounds[low] : bounds[high]], minlength=(high - low) * PARTS)
        out[low:high] = np.minimum(held, 255).reshape(-1, PARTS)
    return out


def may_link(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Row by row, whether sets of sizes m and n with the sketches x and y can link; never False for a link."""
    least = np.minimum(x, y)
    most = np.where((least == 255).any(axis=-1), np.minimum(m, n), np.minimum(least.sum(axis=-1, dtype=np.int64), np.minimum(m, n)))
    return den * most >= num * (m + n - most)


def _sketch_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def possible(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) among ``pairs`` that sizes and sketches (``sketched``: doc_id, size, sketch) don't rule out."""

    def run(batches):
        for b in batches:
            keep = may_link(_sketch_rows(b.column(2)), _sketch_rows(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), num, den)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    left = sketched.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("m"))
    right = sketched.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("n"))
    joined = pairs.join(left, "a").join(right, "b").filter((F.least("m", "n") * den) >= (F.greatest("m", "n") * num))
    return joined.select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, elements as bytes) of the documents among ``ids`` (column doc_id, distinct, written).

    The scan drops most others by a bit set of hashed ids, 16 bits for each and 16 MB at most;
    the join drops the rest.  Where there are so many that the bit set would be too full, they
    are joined before sets are made.
    """
    n = ids.count()
    bits = 1 << max(16, min(27, (16 * n).bit_length()))
    if 4 * n > bits:
        docs = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(_members(ids, bits))
    shift = np.uint64(64 - (bits - 1).bit_length())

    def run(batches):
        held = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = _mix(keys) >> shift
            hit = (held[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for part, texts in in_parts(iter([b.filter(pa.array(hit))]), 1_000_000):
                values, bounds = shingles(texts, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(texts))], pa.binary())], names=["doc_id", "elements"])

    return docs.mapInArrow(run, "doc_id long, elements binary").join(sized(ids), "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) among ``pairs`` with den * |intersection| >= num * |union|."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                u, v = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                if not len(u) or not len(v) or den * min(len(u), len(v)) < num * max(len(u), len(v)):
                    keep.append(False)
                    continue
                # both are sorted and distinct
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(u) + len(v) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_sets(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Whether each of the left sets links with each of the right ones.

    Intersections are products of 0-1 matrices over the elements that several sets hold, some
    thousand elements at a time.
    """
    n, sets = len(left), [*left, *right]
    size = np.array([len(x) for x in sets], np.float32)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, len(right)), np.float32)
    step = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - low)), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        both += m[:n] @ m[n:].T
    # float32 holds whole numbers to 2**24 exactly; a larger set would need 16 million shingles
    return den * both.astype(np.float64) >= num * (size[:n, None] + size[None, n:] - both).astype(np.float64)


def connected(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Smallest place that each set is connected to by links between ``left`` and ``right``; places count on from left to right."""
    n = len(left)
    i, j = np.nonzero(linked_sets(left, right, num, den))
    label = np.arange(n + len(right))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[n + j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, n + j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _blocks(listed: DataFrame, held: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the blocks of each group: those outside its head's component by all of it.

    Sides have about ``block`` documents and ``held`` elements.  (doc, size, label, head, i, j),
    and the same with names that end in _.
    """
    spread = lambda n, m: F.greatest(F.lit(1), F.ceil(F.col(n) / block), F.ceil(F.col(m) / held)).cast("int")
    out = F.col("label") != F.col("head")
    sizes = listed.groupBy("head").agg(F.count("*").alias("all"), F.sum("size").alias("most"), F.count_if(out).alias("out"), F.sum(F.when(out, F.col("size")).otherwise(0)).alias("some"))
    # one row a group with something to compare: where it is small, no group's rows come together for it
    sizes = sized(written(sizes.filter("out > 0").select("head", spread("all", "most").alias("cols"), spread("out", "some").alias("rows")), "spread"))
    placed = listed.join(sizes, "head")
    side = lambda from_, own, other, count, turns: from_.select("doc", "size", "label", "head", F.pmod(F.xxhash64("doc"), count).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(turns) - 1)).alias(other))
    left = side(placed.filter("label <> head"), "i", "j", "rows", "cols").select("doc", "size", "label", "head", "i", "j")
    right = side(placed, "j", "i", "cols", "rows").select("doc", "size", "label", "head", "i", "j")
    return left, right.toDF("doc_", "size_", "label_", "head_", "i_", "j_")


def possible_members(listed: DataFrame, sketched: DataFrame, num: int, den: int, block: int = 1024, per_task: int = 8192) -> DataFrame:
    """The rows of ``listed`` that their sketches leave a link with a row of another component of their group.

    Groups are mostly of a few documents, so blocks are dealt into about as many parts as give
    ``per_task`` rows each.
    """
    sides = [written(x, "side") for x in _blocks(listed, 1 << 60, block)]
    left, right = sides
    parts = max(1, (left.count() + right.count()) // per_task)
    sketch = sketched.select("doc_id", "sketch")
    left = left.join(sketch.withColumnRenamed("doc_id", "doc"), "doc").withColumn("part", F.pmod(F.xxhash64("head", "i", "j"), F.lit(parts)))
    right = right.join(sketch.select(F.col("doc_id").alias("doc_"), F.col("sketch").alias("sketch_")), "doc_").withColumn("part_", F.pmod(F.xxhash64("head_", "i_", "j_"), F.lit(parts)))

    def compare(few: pa.Table, many: pa.Table) -> pa.Table:
        found_h, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if few.num_rows and many.num_rows:
            ordered = []
            for t, tail in ((few, ""), (many, "_")):
                block_of = np.stack([t[c + tail].to_numpy().astype(np.int64) for c in ("head", "i", "j")])
                order = np.lexsort(block_of[::-1])
                block_of = block_of[:, order]
                edge = np.flatnonzero(np.concatenate([[True], (block_of[:, 1:] != block_of[:, :-1]).any(axis=0), [True]]))
                ordered.append(({tuple(block_of[:, a].tolist()): (a, b) for a, b in zip(edge, edge[1:])}, *(t[c + tail].to_numpy()[order] for c in ("doc", "size", "label")), _sketch_rows(t["sketch" + tail])[order]))
            (places, doc, size, label, sketch), (places_, doc_, size_, label_, sketch_) = ordered
            for key, (a, b) in places.items():
                if key not in places_:
                    continue
                lo, hi = places_[key]
                hit_ = np.zeros(hi - lo, bool)
                for k in range(a, b):
                    # another component, not too different in size, and sketches that allow a link
                    near = np.flatnonzero((label_[lo:hi] != label[k]) & (den * np.minimum(size_[lo:hi], size[k]) >= num * np.maximum(size_[lo:hi], size[k])))
                    near = near[may_link(sketch_[lo:hi][near], sketch[k], size_[lo:hi][near], size[k], num, den)]
                    if len(near):
                        hit_[near] = True
                        found_h.append(np.array([key[0]]))
                        found_d.append(doc[k : k + 1])
                found_h.append(np.full(int(hit_.sum()), key[0]))
                found_d.append(doc_[lo:hi][hit_])
        return pa.table({"head": np.concatenate(found_h).astype(np.int64), "doc": np.concatenate(found_d).astype(np.int64)})

    kept = left.groupBy("part").cogroup(right.groupBy("part_")).applyInArrow(compare, "head long, doc long").distinct()
    out = written(listed.join(kept, ["head", "doc"], "left_semi"), "open")
    forget(*sides)
    return out


def block_links(listed: DataFrame, elements: DataFrame, num: int, den: int, block: int = 1024, held: int = 1 << 20) -> DataFrame:
    """(a, b): connections between documents of different components that share a group.

    ``listed`` has each document (doc, its set's size, label of its component) under its group's
    ``head``, the head's component.  Those of other components than the head's are compared
    exactly with all documents of the group, in blocks of about ``block`` documents and ``held``
    elements by as many; a block sends on one row for each document that it connects, not one
    for each link.
    """
    left, right = _blocks(listed, held, block)
    left = left.join(elements.toDF("doc", "elements"), "doc")
    right = right.join(elements.toDF("doc_", "elements_"), "doc_")

    def compare(_, few: pa.Table, many: pa.Table) -> pa.Table:
        out_a, out_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if few.num_rows and many.num_rows:
            ids = np.concatenate([few["doc"].to_numpy(), many["doc_"].to_numpy()])
            unpack = lambda c: [np.frombuffer(x.as_py(), np.uint64) for x in c]
            label = connected(unpack(few["elements"]), unpack(many["elements_"]), num, den)
            known = np.concatenate([few["label"].to_numpy(), many["label_"].to_numpy()])
            # a document is connected with itself and with its component anyhow
            new = known != known[label]
            out_a, out_b = ids[new], ids[label[new]]
        return pa.table({"a": out_a, "b": out_b})

    return left.groupBy("head", "i", "j").cogroup(right.groupBy("head_", "i_", "j_")).applyInArrow(compare, "a long, b long")


def link_counts(members: DataFrame, elements: DataFrame, num: int, den: int, block: int = 1024, held: int = 1 << 20) -> DataFrame:
    """(rep, n): documents of other classes that a class links with.

    members: rep, copies, size, head (component).  Links lie within components, so each is
    compared with itself in blocks of about ``block`` classes and ``held`` elements by as many.
    A block sends on one number for each of its classes.
    """
    spread = F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.ceil(F.sum("size") / held)).cast("int")
    placed = members.join(sized(written(members.groupBy("head").agg(spread.alias("sides")), "spread")), "head")
    turn = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    own = F.pmod(F.xxhash64("rep"), "sides").cast("int")
    left = placed.select("rep", "size", "head", own.alias("i"), turn.alias("j"))
    right = placed.select("rep", "copies", "head", own.alias("j"), turn.alias("i")).toDF("rep_", "copies_", "head_", "j_", "i_")
    total = members.agg(F.sum("size")).first()[0] or 0
    parts = max(1, int(total) // held)
    left = left.join(elements.toDF("rep", "elements"), "rep").withColumn("part", F.pmod(F.xxhash64("head", "i", "j"), F.lit(parts)))
    right = right.join(elements.toDF("rep_", "elements_"), "rep_").withColumn("part_", F.pmod(F.xxhash64("head_", "i_", "j_"), F.lit(parts)))

    def compare(few: pa.Table, many: pa.Table) -> pa.Table:
        def grouped(t: pa.Table, tail: str) -> dict[tuple, list[int]]:
            out: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(t[c + tail].to_pylist() for c in ("head", "i", "j")))):
                out.setdefault(key, []).append(k)
            return out

        reps, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if few.num_rows and many.num_rows:
            a, b, copies = few["rep"].to_numpy(), many["rep_"].to_numpy(), many["copies_"].to_numpy()
            sets = lambda column, at: [np.frombuffer(column[k].as_py(), np.uint64) for k in at]
            other = grouped(many, "_")
            for key, mine in grouped(few, "").items():
                theirs = other.get(key, [])
                if theirs:
                    link = linked_sets(sets(few["elements"], mine), sets(many["elements_"], theirs), num, den) & (a[mine][:, None] != b[theirs][None, :])
                    reps.append(a[mine])
                    counts.append(link @ copies[theirs])
        return pa.table({"rep": np.concatenate(reps), "n": np.concatenate(counts).astype(np.int64)})

    return left.groupBy("part").cogroup(right.groupBy("part_")).applyInArrow(compare, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def similarity_components(docs: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """Per row: key as ``doc_id``, ``n_shingles`` and ``component_id``; with ``count_links`` also ``n_links``.

    A row's set is that of its distinct shingles of ``width`` words (A-Z as a-z, words parted by
    ASCII white space); with fewer words the whole sequence is its one shingle; null and empty
    texts have an empty set, which links with nothing.  Two rows link when den * |intersection|
    >= num * |union|; component_id is the smallest doc_id reachable by links, the own one
    included.  Equal sets are one class; classes link through one member each.  Rows with a
    null key get a null component.  Rows that repeat a key are rows of their own: each has its own
    text's set, links and component.

    Documents that share a signature are first held only against the one with the smallest id,
    which connects most of a group of near copies in as many comparisons as it has members.
    What that leaves apart is compared with all documents of its groups, block by block: first
    by sketches, and by sets where these leave a link possible.

    ``n_links`` is the number of other rows that a row links with, copies included (0 for a null
    key).  Counting takes the pairs of classes within every component, as products of blocks;
    without it connected pairs are not compared.
    """
    own = keyed_text(docs, key, text)
    clash = written(own.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id"), "clash")
    if clash.isEmpty():
        return _components_of(own, width, num, den, count_links)
    # rows that share a key: keys of their own, past all others, and back again
    low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
    first = high + 1 if high < 1 << 62 else low - (1 << 62)
    renamed = written(own.join(sized(clash), "doc_id", "left_semi").withColumn("fresh", F.lit(first) + F.monotonically_increasing_id()), "renamed")
    fresh = own.join(sized(clash), "doc_id", "left_anti").unionByName(renamed.select(F.col("fresh").alias("doc_id"), "text"))
    found = _components_of(fresh, width, num, den, count_links)
    back = sized(renamed).select(F.col("fresh").alias("doc_id"), F.col("doc_id").alias("was"))
    found = written(found.join(back, "doc_id", "left").withColumn("doc_id", F.coalesce("was", "doc_id")).drop("was"), "found")
    least = written(found.filter("component_id is not null").groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    out = by_weight(found.filter("component_id is not null"), least, "component_id", "n").withColumn("component_id", F.col("least")).drop("least", "n")
    return out.select(found.columns).unionByName(found.filter("component_id is null"))


def _components_of(own: DataFrame, width: int, num: int, den: int, count_links: bool) -> DataFrame:
    """``similarity_components`` of rows (doc_id, text) whose keys differ or are null."""
    sets = written(set_classes(own, width), "sets")
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    groups = candidate_groups(own, width, num, den).select("head", F.explode("others").alias("other"))
    # from fingerprints to documents; where two sets share half a fingerprint, both are candidates
    a, b = classes.select(F.col("f1").alias("head"), F.col("rep").alias("rep")), classes.select(F.col("f1").alias("other"), F.col("rep").alias("doc"), F.col("n_shingles").alias("size"))
    groups = written(groups.distinct(), "groups")
    rows = written(groups.join(a, "head").join(b, "other").filter("rep <> doc").select("rep", "doc", "size").distinct(), "rows")
    star = rows.select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b")).distinct()
    nodes = written(rows.select(F.col("rep").alias("doc_id")).union(rows.select("doc")).distinct(), "nodes")
    sketched = written(sets.select("doc_id", F.col("n_shingles").alias("size"), "sketch").join(sized(nodes), "doc_id", "left_semi"), "sketches")
    close = written(possible(star, sketched, num, den), "close")
    wanted = written(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), "wanted")
    elements = written(sets_of(own, wanted, width), "elements")
    links = written(verified(close, elements, num, den), "links")
    forget(elements, wanted, close, nodes)
    label = components(links)

    # what a group's head did not connect: held, in blocks, against the group's members
    tag = label.select(F.col("node").alias("doc"), "label")
    head = label.select(F.col("node").alias("rep"), F.col("label").alias("head"))
    listed = rows.join(tag, "doc", "left").join(head, "rep", "left").select("doc", "size", F.coalesce("label", "doc").alias("label"), F.coalesce("head", "rep").alias("head"))
    # groups whose heads are connected are one
    listed = written(listed.distinct(), "listed")
    open_ = possible_members(listed, sketched, num, den)
    forget(sketched, listed)
    if open_.limit(1).count():
        wanted = written(open_.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
        elements = written(sets_of(own, wanted, width), "elements")
        more = written(block_links(open_, elements, num, den), "more")
        forget(elements, wanted)
        label = components(links.union(more)) if more.limit(1).count() else label
        forget(more)
    forget(groups, rows, links, open_)

    by_rep = label.select(F.col("node").alias("rep"), F.col("label"))
    # what is known of a class goes to its members in one join, and to those of large classes without a shuffle
    known = classes.join(by_rep, "rep", "left").withColumn("component_id", F.coalesce("label", "rep")).drop("label")
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    of_class = ["f1", "f2", "n_shingles"]
    if not count_links:
        return by_weight(full, written(known, "known"), of_class, "copies").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    members = written(classes.join(by_rep, "rep").select("rep", "copies", F.col("n_shingles").alias("size"), F.col("label").alias("head")), "members")
    wanted = written(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    elements = written(sets_of(own, wanted, width), "elements")
    counts = written(link_counts(members, elements, num, den), "counts")
    forget(members, wanted, elements)
    known = known.join(counts, "rep", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0))).drop("n")
    out = by_weight(full, written(known, "known"), of_class, "copies").select("doc_id", "n_shingles", "component_id", "n_links")
    return out.unionByName(alone.withColumn("n_links", F.lit(0).cast("long")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), 4, 85, 100, count_links=True)


def component_sql(width: int, num: int, den: int, source: str = "documents") -> str:
    """CTEs that end in linked(doc_id, n_shingles, component_id, n_links) for source(doc_id, text)."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array({low}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source}
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS s FROM worded
), classed AS (
  SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM shingled
), one AS (SELECT rep AS id, any_value(n) AS n, any_value(s) AS s FROM classed WHERE n > 0 GROUP BY rep),
held AS (SELECT id, n, unnest(s) AS x FROM one),
linked_pairs AS (
  SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.x = b.x AND a.id < b.id
    AND {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM linked_pairs UNION ALL SELECT b, a FROM linked_pairs),
reach(id, other) AS (
  SELECT DISTINCT a, a FROM edges
  UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a
), component AS (SELECT id, min(other) AS least FROM reach GROUP BY id),
copies AS (SELECT rep, count(*) AS copies FROM classed WHERE n > 0 GROUP BY rep),
others AS (SELECT e.a, sum(p.copies) AS n FROM edges e JOIN copies p ON p.rep = e.b GROUP BY e.a),
linked AS (
  SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles,
         CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(k.least, c.rep) END AS component_id,
         CAST(CASE WHEN c.n = 0 THEN 0 ELSE p.copies - 1 + coalesce(o.n, 0) END AS BIGINT) AS n_links
  FROM classed c LEFT JOIN component k ON k.id = c.rep LEFT JOIN copies p ON c.n > 0 AND p.rep = c.rep LEFT JOIN others o ON c.n > 0 AND o.a = c.rep
)
"""


SQL = {"op4_jaccard_join": "WITH RECURSIVE " + component_sql(4, 85, 100) + "SELECT doc_id, n_shingles, component_id, n_links FROM linked"}
