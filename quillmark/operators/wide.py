"""Options of questions with any number of leaves: masks as arrays of words.

Word w of a mask holds the leaves 62 w to 62 w + 61 in order, leaf k at bit k - 62 w.  The subsets
of a question are never listed: prefixes are as many as its leaves, and the best subset of each
sum comes from a pass over the leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 62
_FULL = (1 << BITS) - 1


def words_of(mask: int) -> list[int]:
    out = []
    while mask:
        out.append(mask & _FULL)
        mask >>= BITS
    return out


def _words(places: list[int]) -> list[int]:
    """The words of a mask that holds these leaves."""
    out = [0] * (max(places) // BITS + 1) if places else []
    for p in places:
        out[p // BITS] |= 1 << p % BITS
    return out


def mask_of(words: list[int]) -> int:
    return sum(w << BITS * k for k, w in enumerate(words))


def holds(words: Column, leaf: Column) -> Column:
    """Whether a mask holds a leaf, by its place from 0."""
    word = F.get(words, F.floor(leaf / BITS).cast("int"))
    return F.coalesce(F.getbit(word, (leaf % BITS).cast("int")) == 1, F.lit(False))


def best_within(marks: list[int], most: int) -> int:
    """The mask of the best subset of at most ``most`` marks: most marks, then most leaves, then the smallest mask; 0 for none.

    For every sum that some subset has, the best subset of the leaves so far.
    """
    best: dict[int, tuple[int, int]] = {0: (0, 0)}
    for k, m in enumerate(marks):
        bit = 1 << k
        for s, (n, less) in sorted(best.items(), reverse=True):
            if s + m <= most and (n + 1, less - bit) > best.get(s + m, (-1, 0)):
                best[s + m] = (n + 1, less - bit)
    some = {s: x for s, x in best.items() if x[0]}
    return -some[max(some)][1] if some else 0


def _batch(b: pa.RecordBatch, at: int, key: str, words: list[list[int]], marks: list[int], parts: list[int]) -> pa.RecordBatch:
    keys = b.column(0).take(pa.array([at] * len(words), pa.int64()))
    return pa.RecordBatch.from_arrays([keys, pa.array(words, pa.list_(pa.int64())), pa.array(marks, pa.int64()), pa.array(parts, pa.int32())], names=[key, "words", "marks", "n_parts"])


def _each(rows: DataFrame, key: str, make: Callable[[list[int], int], list[int]]) -> DataFrame:
    """(key, words, marks, n_parts) of the masks that ``make`` gives for (marks of the leaves, pins), a question at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(b.num_rows):
                own, pins = b.column(1)[at].values.field("marks").to_pylist(), b.column(2)[at].as_py()
                masks = make(own, mask_of(pins or []))
                marks = [sum(m for i, m in enumerate(own) if mask >> i & 1) for mask in masks]
                if masks:
                    yield _batch(b, at, key, [words_of(mask) for mask in masks], marks, [mask.bit_count() for mask in masks])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, words array<long>, marks long, n_parts int")


def _leaves(parts: DataFrame, key: str) -> DataFrame:
    valid = parts.filter("is_valid").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("marks").cast("long").alias("marks")))).alias("leaf"))
    return valid.withColumn("pins", F.lit(None).cast("array<long>"))


def prefixes(parts: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, words, marks, n_parts) of every prefix of a question's valid leaves; the longest is the whole question.

    parts: key, ord, marks, is_valid.
    """
    in_order = Window.partitionBy(key).orderBy("ord", "marks").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.filter("is_valid").select(key, F.sum(F.col("marks").cast("long")).over(in_order).alias("marks"), F.count("*").over(in_order).cast("int").alias("n_parts"))
    whole = F.array_repeat(F.lit(_FULL), F.floor(F.col("n_parts") / BITS).cast("int"))
    rest = F.col("n_parts") % BITS
    last = F.when(rest > 0, F.array(F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(key, F.concat(whole, last).alias("words"), "marks", "n_parts")


def best_options(parts: DataFrame, most: int, key: str = "question_id") -> DataFrame:
    """The best subset of each question's valid leaves with at most ``most`` marks; questions without one are left out.  Marks must not be negative.

    Of leaves with equal marks the best subset holds the first ones, and never more of them than
    ``most`` has room for; those without marks it holds all.  So a question brings together
    about ``most`` times the logarithm of ``most`` leaves, however many it has.
    """
    own = parts.filter("is_valid").select(key, F.col("marks").cast("long").alias("marks"), "ord")
    placed = own.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("ord", "marks")) - 1)
    turn = F.row_number().over(Window.partitionBy(key, "marks").orderBy("at"))
    some = placed.filter(F.col("marks") <= most).withColumn("__turn", turn).filter((F.col("marks") == 0) | (F.col("__turn") * F.col("marks") <= most))
    listed = some.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("marks") > 0, F.struct("at", "marks")))).alias("leaf"), F.collect_list(F.when(F.col("marks") == 0, F.col("at"))).alias("free"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in range(b.num_rows):
                leaf, free = b.column(1)[k].values, b.column(2)[k].values.to_numpy()
                at, marks = leaf.field("at").to_pylist(), leaf.field("marks").to_pylist()
                mask = best_within(marks, most)
                chosen = [i for i in range(len(at)) if mask >> i & 1]
                words = _words([*(at[i] for i in chosen), *free.tolist()])
                if words:
                    yield _batch(b, k, key, [words], [sum(marks[i] for i in chosen)], [len(chosen) + len(free)])

    return listed.mapInArrow(run, f"`{key}` {parts.schema[key].dataType.simpleString()}, words array<long>, marks long, n_parts int")


def covering_options(parts: DataFrame, pinned: DataFrame, key: str = "question_id") -> DataFrame:
    """The smallest subset that holds a question's pins (``words``): the pins themselves, or all leaves where a pin is no leaf or there is none."""
    rows = _leaves(parts, key).drop("pins").join(pinned.select(key, F.col("words").alias("pins")), key)

    def cover(own: list[int], pins: int) -> list[int]:
        full = (1 << len(own)) - 1
        return [pins if pins and pins & full == pins else full]

    return _each(rows.select(key, "leaf", "pins"), key, cover)
