"""Operators 2, 3 and 10: against the tokenizers library, and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm.bpe_automaton import BpeAutomaton
from quillmark.llm.common import new_path
from quillmark.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from quillmark.llm.queries import QUERIES
from quillmark.llm.token_counts import token_counts
from quillmark.llm.token_store import cut_points, joined_crcs, merkle_root, MerkleStream, read_ids, read_store, write_store
from tests.conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a", "'s", "it's ''s !'s 'sun don't 'rest I'll 're", "  a  b \n\n c\t d \n", "x" * 3000, "ab" * 70_000, "a1b22 333 ½²", "\x1f odd", "日本 text <|endoftext|> b",
    "É’s “q” don’t", " 's \n's  's", "İx ſ ŉ Σας", "a\x00b", "tail  ", "\n\n x", "éclair", "word " * 2000, "😀 ok", "DON'T Stop'LL", "a b\u0085c",
]


def encoded(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def ids_of(machine, texts, **how):
    out = []
    for ids, sizes in machine.encode(texts, **how):
        at = np.concatenate([[0], np.cumsum(sizes)])
        out += [ids[at[k] : at[k + 1]].tolist() for k in range(len(sizes))]
    return out


@pytest.fixture(scope="module")
def machines():
    return {(p, c): BpeAutomaton(p, c) for p in (WORD, BYTE) for c in (True, False)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("width, chars", [(128, 2_000_000), (16, 100), (7, 5000)])
def test_automaton_gives_the_librarys_ids(machines, path, width, chars):
    rng = random.Random(width)
    texts = ODD + ["".join(rng.choice("abcDEthe 's't 12\n.,!?é’ñ_ \tll re ve") for _ in range(rng.randint(0, 150))) for _ in range(200)]
    want = encoded(path, texts)
    assert ids_of(machines[path, False], texts, width=width, chars=chars) == want
    assert machines[path, True].counts(texts, width=width, chars=chars).tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=6))
def test_automaton_on_any_text(machines, texts):
    for path in (WORD, BYTE):
        want = encoded(path, texts) if texts else []
        assert ids_of(machines[path, False], texts) == want
        assert machines[path, True].counts(texts).tolist() == [len(x) for x in want]


def test_automaton_starts_anew_when_full():
    machine = BpeAutomaton(WORD, False, max_states=50, columns=8)
    texts = ["several rather different words", "and some more of them, ünlike", "several rather different words"] * 5
    for part in (texts[:4], texts[4:]):
        assert ids_of(machine, part) == encoded(WORD, part)


def test_automaton_on_many_scripts(machines):
    rng = random.Random(8)
    blocks = ["Ελληνικάωψς", "РусскийязыкЁё", "עבריתשלום", "العربيةسلام", "ひらがなカタカナ", "中文漢字語言", "한국어문장", "ȺƏÀéñçß", "abcXYZ019"]
    texts = ["".join(rng.choice(rng.choice(blocks[k % 9 : k % 9 + 2]) + " .,'1") for _ in range(rng.randint(1, 80))) for k in range(400)]
    for path in (WORD, BYTE):
        machine = machines[path, False]
        assert sum(map(machine._fits, texts)) >= 300
        want = encoded(path, texts)
        assert ids_of(machine, texts) == want
        assert machines[path, True].counts(texts).tolist() == [len(x) for x in want]


def test_long_texts_are_cut_between_words(machines):
    long = " ".join(f"word{k} it's, wOrd" for k in range(3000)) + " 日本 " + "x" * 5000 + " more words of it " * 500 + "😀 end of it"
    for path in (WORD, BYTE):
        (want,) = encoded(path, [long])
        for chars in (100, 3000):
            assert ids_of(machines[path, False], ["a", long, ""], chars=chars) == [encoded(path, ["a"])[0], want, []]
            assert machines[path, True].counts([long, long], chars=chars).tolist() == [len(want)] * 2


def docs(spark, rows=None):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "no key"), (99, None)] if rows is None else rows
    return spark.createDataFrame([(k, t, -1, "x") for k, t in rows], "doc_id long, text string, n_tokens int, start string")


def test_counts(spark):
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs(spark), WORD, limit=20).collect())
    rows = [(r.doc_id, r.text or "") for r in docs(spark).collect()]
    want = encoded(WORD, [t for _, t in rows])
    assert got == sorted((repr(k), len(t.encode()), len(x), len(x) > 20) for (k, t), x in zip(rows, want))
    assert token_counts(docs(spark, []), WORD).count() == 0


def test_store_round_trip(spark):
    path = new_path(spark, "t")
    write_store(docs(spark), path, WORD)
    rows = sorted(((r.doc_id, r.text or "") for r in docs(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [np.array(x + [1], "<u4") for x in encoded(WORD, [t for _, t in rows])]
    got = read_store(spark, path).orderBy("start").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in sorted_like(got, rows, ids)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(x) for x in ids)
    back = {r.start: r.ids for r in read_ids(spark, path).collect()}
    assert all(zlib.crc32(np.array(back[r.start], "<u4")) == r.ids_crc32 for r in got)


def sorted_like(got, rows, ids):
    """The ids in the order of ``got``; rows that share a key may come in any order."""
    left = [(k, x) for (k, _), x in zip(rows, ids)]
    out = []
    for r in got:
        i = next(i for i, (k, x) in enumerate(left) if k == r.doc_id and len(x) == r.n_tokens)
        out.append(left.pop(i)[1])
    return out


def test_store_keeps_equal_chunks_once_and_notices_damage(spark):
    path = new_path(spark, "t")
    text = " ".join(f"word{k % 97} other{k * 7 % 89}" for k in range(4000))
    write_store(docs(spark, [(k, text) for k in range(30)]), path, WORD)
    chunks = spark.read.parquet(f"{path}/chunks").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count() == read_store(spark, path).first().n_chunks
    bad = new_path(spark, "t")
    spark.read.parquet(f"{path}/recipes").write.partitionBy("kind").parquet(f"{bad}/recipes")
    first = chunks.first().digest
    chunks.filter(chunks.digest != first).write.partitionBy("kind").parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="does not match"):
        read_store(spark, bad).collect()


DAMAGE = {
    "a document": lambda r: r.filter("kind <> 'doc' or doc_id <> 17"),
    "a document twice": lambda r: r.union(r.filter("kind = 'doc' and doc_id = 17")),
    "a shard's row": lambda r: r.filter("kind <> 'shard' or shard <> 1"),
    "a shard": lambda r: r.filter("kind = 'store' or shard <> 1"),
    "the store's row": lambda r: r.filter("kind <> 'store'"),
    "two recipes swapped": lambda r: r.withColumn("doc_id", F.expr("case when kind = 'doc' and doc_id = 3 then 4 when kind = 'doc' and doc_id = 4 then 3 else doc_id end")),
    "chunks of two documents swapped": lambda r: r.withColumn("data", F.expr("case when kind = 'doc' and doc_id in (3, 4) then reverse(data) else data end")),
}


@pytest.mark.parametrize("what", DAMAGE)
def test_store_notices_what_is_lost_or_swapped(spark, what):
    path, bad = new_path(spark, "t"), new_path(spark, "t")
    write_store(docs(spark, [(k, f"text {k} " * (k + 1)) for k in range(60)]), path, WORD)
    assert read_store(spark, path).count() == 60
    recipes = spark.read.parquet(f"{path}/recipes")
    assert recipes.filter("kind = 'shard'").count() > 1
    DAMAGE[what](recipes).write.partitionBy("kind").parquet(f"{bad}/recipes")
    spark.read.parquet(f"{path}/chunks").write.partitionBy("kind").parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="manifest|does not match"):
        read_store(spark, bad).collect()


def test_empty_store(spark):
    path = new_path(spark, "t")
    write_store(docs(spark, []), path, WORD)
    assert read_store(spark, path).count() == 0


def test_checksums_and_trees():
    rng = np.random.default_rng(1)
    parts = [[rng.bytes(rng.integers(0, 5000)) for _ in range(n)] for n in (1, 3, 0, 7)]
    got = joined_crcs([[(len(b), zlib.crc32(b)) for b in p] for p in parts])
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]
    for n in range(1, 12):
        leaves = [bytes([k]) * 20 for k in range(n)]
        tree = MerkleStream()
        for x in leaves:
            tree.add(x)
        assert tree.root() == merkle_root(leaves)


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 49000, 20000)
    ids = np.concatenate([rng.integers(0, 49000, 333), body, body])
    cuts = cut_points(ids, np.array([333 + 20000, 333 + 40000]))
    assert [c[-1] for c in cuts] == [20333, 40333]
    a, b = {c - 333 for c in cuts[0]}, {c - 20333 for c in cuts[1]}
    assert len(a & b) > len(a) * 0.6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_and_bound(lengths):
    x = np.array(lengths)
    bins, offsets, loads = best_fit_decreasing(x, 64)
    assert loads.max() <= 64 and loads.sum() == x.sum()
    for b in range(len(loads)):
        mine = sorted((o, n) for o, n in zip(offsets[bins == b].tolist(), x[bins == b].tolist()))
        assert [o for o, _ in mine] == np.concatenate([[0], np.cumsum([n for _, n in mine])[:-1]]).astype(int).tolist()
    bound = lower_bound(np.bincount(x, minlength=65), 64)
    assert -(-x.sum() // 64) <= bound <= len(loads) <= max(1, 1.23 * bound + 1)


def test_bound_beats_the_sum():
    assert lower_bound(np.bincount([60, 60, 60], minlength=101), 100) == 3
    assert lower_bound(np.bincount([34] * 6, minlength=101), 100) == 3


def check_packing(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == np.concatenate([[0], np.cumsum([n for _, n in x])[:-1]]).astype(int).tolist()
        assert sum(n for _, n in x) <= capacity
    return len(by)


def test_partitions_exchange_documents(spark):
    rng = random.Random(5)
    lengths = [rng.choice([300, 380, 500, 640, 700, 90, 1024]) for _ in range(4000)]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    many = pack(pieces, 1024, per_task=500).collect()
    assert sorted(r.doc_id for r in many) == list(range(4000))
    bound = lower_bound(np.bincount(lengths, minlength=1025), 1024)
    assert check_packing(many, 1024) <= 1.02 * bound + 2


def test_packing_whole_documents(spark):
    got = pack_documents(docs(spark), BYTE).collect()
    rows = [(r.doc_id, r.text or "") for r in docs(spark).collect()]
    ids = [np.array(x + [2], "<u4") for x in encoded(BYTE, [t for _, t in rows])]
    want = []
    for (k, _), x in zip(rows, ids):
        at, n = 0, -(-len(x) // 1024)
        for p in range(n):
            to = len(x) - (n - 1 - p) * 1024
            want.append((repr(k), p, at, to - at, zlib.crc32(x[at:to])))
            at = to
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_packing(got, 1024)
    assert pack_documents(docs(spark, []), BYTE).count() == 0


def test_registered_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = sorted(rows)
    want = dict(zip(keys, encoded(WORD, [rows[k] for k in keys])))
    got = QUERIES["op10_token_counts"](spark, SF).collect()
    assert len(got) == n and all(r.n_tokens == len(want[r.doc_id]) for r in got)
    got = QUERIES["op3_token_store"](spark, SF).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(want[k]) + 1 for k in keys]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(want[k] + [1], "<u4")) for k in keys]
    check_packing(QUERIES["op2_best_fit_packing"](spark, SF).collect(), 1024)
