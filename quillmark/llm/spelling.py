"""Spelling variants (operator 11): words one edit apart, by a rare-first q-gram prefix filter.

Bigrams are ordered by the number of words that hold them, rarest first.  One edit leaves all
but two of a word's bigrams as they are, moved by one place at most, so of the three rarest of
two words that are one edit apart one is the same untouched bigram, at places that differ by
one at most.  It parts both words: the edit lies on one side of it and the other side is equal.
So words are joined on an untouched side that ends or begins with one of their three rarest
bigrams, which holds the limit on positions too, and pairs are verified.

The order is one of bigrams, not of bigrams at a place: an edit moves the places, and an order
by place would part the prefixes of words that are one edit apart.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import forget, in_parts, keyed_text, sized, table, written

#: A run of fewer letters gives no word, with or without a letter deleted.
LEAST = 5
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: In one of so many runs of a document a letter is left out.
MISSPELT = 97
#: One edit spoils two bigrams at most.
PREFIX = 3


def words_of(key: int | None, text: str) -> dict[str, int]:
    """Number of occurrences of each word of one text, letters left out as the checksum of key and run says."""
    base = zlib.crc32(f"{'' if key is None else key}:".encode())
    out: dict[str, int] = {}
    for word, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(word.encode(), base)
        if not h % MISSPELT:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST:
                continue
        out[word] = out.get(word, 0) + n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, held: int = 200_000) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more in all texts.

    A task adds up its texts' words and passes sums on whenever it holds ``held`` words, so the
    commonest word is a few rows a task.
    """

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total: dict[str, int] = {}
        for part, texts in in_parts(batches):
            for k, t in zip(part.column(0).to_pylist(), texts):
                for w, n in words_of(k, t).items():
                    total[w] = total.get(w, 0) + n
                if len(total) > held:
                    yield rows(total)
                    total = {}
        if total:
            yield rows(total)

    return keyed_text(docs, key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram stands: at most 90 * 90, as words are of 26 + 64 letters."""

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                total.update({w[i : i + 2] for i in range(len(w) - 1)})
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


def rarest(word: str, counts: dict[str, int]) -> list[int]:
    """Places of the word's rarest bigrams, as many as one edit can't spoil."""
    return sorted(range(len(word) - 1), key=lambda i: (counts[word[i : i + 2]], word[i : i + 2], i))[:PREFIX]


def sides(word: str, counts: dict[str, int]) -> list[tuple[int, int, int]]:
    """(key, begin, length) for each side that may be untouched; begin and length are of the rest, where the edit is."""
    out = []
    for p in rarest(word, counts):
        out.append((xxhash.xxh3_64_intdigest("<" + word[: p + 2]) - (1 << 63), p + 2, len(word) - p - 2))
        out.append((xxhash.xxh3_64_intdigest(">" + word[p:]) - (1 << 63), 0, p))
    return out


def _halves() -> F.Column:
    """Keys of a frequent side's parts: half of the rest is untouched too.

    Of two rests, the longer of ``c`` letters, an edit from letter ``c / 2`` on leaves as many
    letters before it, and an earlier one leaves the last ``c - c / 2``.
    """
    rest = F.substring("word", F.col("begin") + 1, F.col("size"))
    keys = []
    for more in (0, 1):
        c = F.col("size") + more
        h = F.floor(c / 2).cast("int")
        keys.append(F.xxhash64("key", c, F.lit(0), F.substring(rest, F.lit(1), h)))
        keys.append(F.when(F.col("size") >= c - h, F.xxhash64("key", c, F.lit(1), F.substring(rest, F.col("size") - (c - h) + 1, c - h))))
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def near_words(words: DataFrame, frequent: int = 128) -> DataFrame:
    """Pairs (a, n_a, b, n_b), a < b, of ``words`` (word, n) that are one edit apart; each pair once.

    Sides that more than ``frequent`` words share are parted by halves of the rest, so no key
    holds more than words alike but for a few letters; the join's condition, not its rows,
    then has all pairs of a key.
    """
    spark = words.sparkSession
    counts = spark.sparkContext.broadcast(bigram_counts(words))

    def run(batches):
        own = counts.value
        for b in batches:
            for low in range(0, b.num_rows, 8192):
                part = b.slice(low, 8192)
                rows = [(k, w, n, begin, size, len(w)) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, begin, size in sides(w, own)]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "word", "n", "begin", "size", "length"])

    entries = written(words.select("word", "n").mapInArrow(run, "key long, word string, n long, begin int, size int, length int"), "sides")
    full = written(entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "side-counts")
    rare = entries.join(full.filter(F.col("m") <= frequent).select("key"), "key").select("key", "word", "n", "length")
    often = sized(written(full.filter(F.col("m") > frequent).select("key"), "frequent-sides"))
    split = entries.join(often, "key").select(F.explode(_halves()).alias("key"), "word", "n", "length")
    keyed = written(rare.unionByName(split), "keyed-words")
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("length").alias("l_a"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("length").alias("l_b"))
    alike = (F.col("a") < F.col("b")) & F.col("l_a").between(F.col("l_b") - 1, F.col("l_b") + 1)
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & alike & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()
    out = written(pairs, "near-words")
    forget(entries, full, often, keyed)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends, by pointer jumping.

    A form occurs twice as often as its word, so a path has no circle and fewer steps than the
    largest count has binary digits.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, frequent: int = 128) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    Words are runs of five or more of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z
    lower-cased, that occur ``least`` times in all texts; of one run in 97 of a document,
    chosen by a checksum of key and run, one letter is left out.  ``n_near`` counts the
    words one insertion, deletion or replacement away; ``form`` is the one of them that occurs
    most often (ties: the smallest in code-point order) where that is at least twice the word's
    own ``n``, and ``form_n`` its count, else both are null.  ``root`` is where following forms
    from the word ends.

    Null and empty texts have no words; a null key counts as an empty string in the checksum;
    rows that repeat a key or a whole row count each; other columns are not read; a table
    without words gives no rows.
    """
    words = written(vocabulary(docs, key, text, least), "vocabulary")
    near = near_words(words, frequent)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"), F.first("n_a").alias("own"))
    taken = F.col("own") * 2 <= -F.col("best.less")
    found = written(best.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
