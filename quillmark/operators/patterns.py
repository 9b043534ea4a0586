"""Many patterns against many texts: one automaton over what the patterns require, then each survivor by its pattern.

A pattern's required literal is a run of plain characters that every match holds.  All literals
are looked for in one pass over a text, whatever their number; only the patterns whose literal is
there, and those without one, are then matched by Spark's own ``rlike``, so the
result is that of one ``rlike`` for each pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPECIAL = set("\\^$.|?*+()[]{}")


def required_literal(pattern: str, least: int = 3) -> str | None:
    """The longest run of plain characters, A-Z lower-cased, that every match of a pattern holds; None if none is certain.

    Groups and classes are passed over.  Nothing is certain of patterns with alternatives
    outside groups, quotations, comments, nested classes, or flags but a leading (?i), nor of
    other letters than ASCII under that flag.
    """
    fold = pattern.startswith("(?i)")
    s = pattern[4:] if fold else pattern
    if "\\Q" in s or re.search(r"\(\?[a-zA-Z-]*[):]", s.replace("(?:", "(")):
        return None
    runs, run, i, depth = [], "", 0, 0

    def cut() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(s):
        c = s[i]
        if c == "[":
            cut()
            i += 2 if s[i + 1 : i + 2] == "^" else 1
            if s[i : i + 1] == "]":
                return None
            while i < len(s) and s[i] != "]":
                if s[i] == "[" or s[i : i + 2] == "&&":
                    return None
                i += 2 if s[i] == "\\" else 1
            i += 1
        elif c == "(":
            cut()
            depth, i = depth + 1, i + 1
        elif c == ")":
            depth, i = depth - 1, i + 1
            if depth < 0:
                return None
            cut()
        elif depth:
            i += 2 if c == "\\" else 1
        elif c == "|":
            return None
        elif c in "*?{":
            run = run[:-1]
            cut()
            if c == "{":
                end = s.find("}", i)
                if end < 0:
                    return None
                i = end
            i += 1
        elif c in "+.^$":
            cut()
            i += 1
        elif c == "\\":
            after = s[i + 1 : i + 2]
            if not after or not after.isascii():
                return None
            if after.isalnum():
                cut()
                if after in "xuckpPN0" or after.isdigit():  # codes of several characters
                    return None
            else:
                run += after
            i += 2
        elif c in _SPECIAL:
            return None
        else:
            run += c
            i += 1
    cut()
    if depth:
        return None
    found = [r.translate(_LOWER) for r in runs if not fold or r.isascii()]
    best = max(found, key=len, default="")
    return best if len(best) >= least else None


@dataclass(frozen=True)
class Matcher:
    """Which of many patterns a text may match."""

    patterns: tuple[str, ...]

    def build(self):
        import ahocorasick

        a, always = ahocorasick.Automaton(), []
        by_literal: dict[str, list[int]] = {}
        for k, p in enumerate(self.patterns):
            literal = required_literal(p)
            by_literal.setdefault(literal, []).append(k) if literal else always.append(k)
        for literal, ks in by_literal.items():
            a.add_word(literal, ks)
        if by_literal:
            a.make_automaton()
        return (a if by_literal else None), always

    def candidates(self, text: str) -> list[int]:
        automaton, always = _built(self)
        found = set(always)
        if automaton is not None:
            for _, ks in automaton.iter(text.translate(_LOWER)):
                found.update(ks)
        return sorted(found)


@lru_cache(maxsize=4)
def _built(matcher: Matcher):
    """One per Python worker."""
    return matcher.build()


def matched(texts: DataFrame, patterns: list[str], key: str, text: str) -> DataFrame:
    """(key, k, text, pattern): each pattern, by its place in the list, that a text matches; null texts match none.

    The patterns are a parameter; they are sent to all tasks.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(Matcher(tuple(patterns)))

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                found = [[] if t is None else shared.value.candidates(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=["__key", "__text", "__ks"])

    kind = texts.schema[key].dataType.simpleString()
    some = texts.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"__key {kind}, __text string, __ks array<int>")
    listed = spark.createDataFrame(pa.table({"k": pa.array(range(len(patterns)), pa.int32()), "pattern": pa.array(patterns, pa.string())}))
    rows = some.select("__key", "__text", F.explode("__ks").alias("k")).join(F.broadcast(listed), "k")
    return rows.filter(F.expr("__text rlike pattern")).select(F.col("__key").alias(key), "k", F.col("__text").alias(text), "pattern")


def pattern_rejects(spark: SparkSession, patterns: DataFrame, most: int = 100_000) -> DataFrame:
    """(pattern, reject) of the distinct patterns that do not compile, with what the compiler says of them.

    Patterns are settings, not data: of more than ``most`` distinct ones this fails.  They are
    compiled by the class that ``rlike`` uses.
    """
    listed = [r[0] for r in patterns.select("pattern").filter("pattern is not null").distinct().limit(most + 1).collect()]
    if len(listed) > most:
        raise ValueError(f"over {most} distinct patterns")
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    bad, why = [], []
    for p in listed:
        try:
            compile_(p)
        except Exception as failed:
            bad.append(p)
            why.append(str(failed).strip().split("\n")[0])
    return spark.createDataFrame(pa.table({"pattern": pa.array(bad, pa.string()), "reject": pa.array(why, pa.string())}))


def ordered_sum(weights: Column) -> Column:
    """Sum in the order of the array, so rounding is that of a loop."""
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
