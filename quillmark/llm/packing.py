"""Best-fit packing with bound-certified repacking (operator 2)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.bpe_automaton import automaton
from quillmark.llm.common import forget, in_parts, keyed_text, table, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of a document's ids (with the end id): its place, length and checksum.

    A document of up to ``capacity`` ids is one piece; a longer one is cut so that every
    piece but the first is full.  Null texts are empty: one piece that holds the end id.
    """

    def run(batches):
        machine = automaton(tokenizer, False)
        for part, texts in in_parts(batches, tokenizes=True):
            keys, row = part.column(0).to_pylist(), 0
            for ids, sizes in machine.encode(texts):
                out: list[tuple] = []
                low = 0
                for n in sizes.tolist():
                    whole = np.empty(n + 1, "<u4")
                    whole[:n], whole[n] = ids[low : low + n], end_id
                    low += n
                    cut = (n % capacity) + 1
                    at = 0
                    for piece in range(n // capacity + 1):
                        to = cut + piece * capacity
                        out.append((keys[row], piece, at, to - at, zlib.crc32(whole[at:to])))
                        at = to
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return keyed_text(docs, key, text).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; counts[n] items have length n.

    The largest value of three families of dual feasible functions, each of which maps any
    set of lengths that fits into a bin to a sum of at most the bin: the identity; for a
    threshold t, lengths over capacity - t count as the whole bin and lengths under t as
    nothing; and the rounding x -> floor((k + 1) x / capacity) / k, which leaves x where
    (k + 1) x is a multiple of the capacity.
    """
    size = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    held = np.concatenate([[0], np.cumsum(counts * size)])
    number = np.concatenate([[0], np.cumsum(counts)])
    for t in range(1, capacity // 2 + 1):
        whole = int(number[-1] - number[capacity - t + 1])
        middle = int(held[capacity - t + 1] - held[t])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):
        up = (k + 1) * size
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, load of each bin); ties by position.

    Open bins are kept by remaining room; a bit set of the rooms in use finds the tightest.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    loads: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.asarray(loads, np.int64)


def pack(pieces: DataFrame, capacity: int, per_task: int = 200_000, rounds: int = 4) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``gap``: pieces of ``length`` placed into sequences.

    Every partition packs its own pieces by best fit decreasing and compares the number of
    its bins with the dual-feasible-function bound.  A partition that meets the bound is
    final, and so are full bins.  The others hand the pieces of their unfilled bins on; these
    are dealt out anew, so that partitions exchange documents, and packed again, until a
    partition count of one has been packed or ``rounds`` is over.  A partition has about
    ``per_task`` pieces, whatever the number of documents.

    ``gap`` is 0 where the bound certifies that the partition that placed a piece could not do
    with fewer sequences, or the sequence is full; else it is by how many sequences that
    partition is over its bound after the last round.

    ``length`` must be 1 to ``capacity``.  Repeated rows are separate pieces.  No rows give
    no rows.
    """
    spark = pieces.sparkSession
    fields = pieces.schema.names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, gap int"

    def packer(turn: int):
        def run(batches):
            from pyspark import TaskContext

            held = [b.select(fields) for b in batches if b.num_rows]
            if not held:
                return
            mine = pa.Table.from_batches(held)
            lengths = np.asarray(mine["length"], np.int64)
            bins, offsets, loads = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            final = np.full(len(loads), len(loads) == bound) | (loads == capacity)
            base = (turn << 56) | (TaskContext.get().partitionId() << 32)
            out = mine
            gap = np.where(final, 0, len(loads) - bound).astype(np.int32)
            for name, column in (("sequence_id", base + bins), ("offset", offsets), ("gap", gap[bins])):
                out = out.append_column(name, pa.array(column))
            yield from out.to_batches(max_chunksize=50_000)

        return run

    total = pieces.count()
    parts = max(1, -(-total // per_task))
    done: list[DataFrame] = []
    rest, temporary = pieces, []
    for turn in range(rounds):
        # the salt differs by turn, so documents of one partition part company in the next
        dealt = rest.repartition(parts, F.xxhash64(F.lit(turn), *[F.col(c) for c in fields])) if parts > 1 else rest.coalesce(1)
        packed = written(dealt.mapInArrow(packer(turn), schema), f"packed{turn}")
        left = packed.filter("gap > 0").count() if parts > 1 and turn + 1 < rounds else 0
        if not left:
            done.append(packed)
            break
        done.append(packed.filter("gap = 0"))
        rest = packed.filter("gap > 0").select(*fields)
        parts = min(max(1, -(-left // per_task)), parts)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*fields, "sequence_id", "offset", "gap")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as gapless pieces of sequences of at most ``capacity`` ids, one row per piece."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces")
    out = pack(pieces, capacity)
    forget(pieces)
    return out


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
