from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import conversations, embedding_dedup, spelling
from quillmark.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.oracle import same

# ---------------------------------------------------------------- operator 11


def words_by_hand(docs) -> dict[str, int]:
    total: Counter = Counter()
    for key, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs):
    words = words_by_hand(docs)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def texts_with_typos(seed: int, n: int):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé×Z") for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["receive", "banana", "ananas", "aaaaa", "aaaaaa", "aaaaaaa"]
    docs = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            words.append(w)
        docs.append((k, rng.choice([" ", ", ", "-", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize("frequent", [128, 1])
def test_variants_equal_brute_force(spark, frequent):
    docs = texts_with_typos(3, 60) + [(None, "receive receive receve receve receve"), (7, None), (8, ""), (7, "recieve " * 30), (9, "b" * 3_000 + " " + "b" * 3_001), (9, ("b" * 3_000 + " ") * 5), (10, ("b" * 3_001 + "\t") * 2)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n int, WORD string")
    want = variants_by_hand(docs)
    assert len(want) > 50 and sum(r[1] is not None for r in want) > 20
    assert rows_of(spelling.spelling_variants(df, frequent=frequent)) == want


def test_variants_of_the_table_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = words_by_hand(docs)
    got = rows_of(QUERIES["op11_spelling_variants"](spark, SF))
    assert {(r[0], r[3]) for r in got} == set(words.items())
    # whole neighbourhoods of the words by deleting letters, a method of its own
    by_gap: dict = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_gap.setdefault(v, set()).add(w)
    near = {w: {x for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for x in by_gap[v] if one_edit(w, x)} for w in words}
    assert {r[0]: r[4] for r in got} == {w: len(x) for w, x in near.items()}
    for w, form, _, n, _, form_n in got:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        assert form == (best if best and words[best] >= 2 * n else None) and form_n == (words[form] if form else None)


def test_variants_chains_and_no_words(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("x", "y")}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(none)) == set()


# ---------------------------------------------------------------- operator 12


def links_by_hand(rows, threshold=0.95):
    fit = []
    for i, (key, v) in enumerate(rows):
        if key is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        fit.append(i)
    link = {i: set() for i in range(len(rows))}
    for a in fit:
        for b in fit:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    link[a].add(b)
                    link[b].add(a)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in link[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(link[i]), low, key == low))
    return sorted(out, key=repr)


def clustered(seed: int, dim: int = 16):
    rng = np.random.default_rng(seed)
    rows = [(1000 + i, rng.standard_normal(dim)) for i in range(60)]
    for size, noise in ((40, 0.02), (30, 0.16), (25, 0.25), (3, 0.1), (2, 0.1)):
        centre = rng.standard_normal(dim)
        rows += [(int(rng.integers(10_000)), centre + noise * rng.standard_normal(dim)) for _ in range(size)]
    walk = rng.standard_normal(dim)
    for i in range(30):  # a chain: neighbours link, ends do not
        walk = walk + 0.24 * rng.standard_normal(dim)
        rows.append((20_000 + i, walk * (1 + i)))
    rows += [(30_000 + i, rows[5][1]) for i in range(50)]
    rows = [(k, [float(x) for x in v]) for k, v in rows]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None), (2, []), (3, [0.0] * dim), (4, [nan] + [1.0] * (dim - 1)), (5, [inf] * dim), (6, [None] + [1.0] * (dim - 1)), (None, rows[0][1]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [-1.0, -2.0])]
    rows += [(1001, rows[1][1]), (1002, rows[3][1]), (50, [1e200] * dim), (51, [1e-200] * dim), (52, [-0.0] + [1.0] * (dim - 1)), (53, [0.0] + [1.0] * (dim - 1))]
    return rows


@pytest.mark.parametrize("block", [1024, 6])
def test_links_equal_brute_force(spark, block):
    rows = clustered(4)
    df = spark.createDataFrame([(k, v, 1, "z") for k, v in rows], "vec_id long, embedding array<double>, n_links int, Kept string")
    got = embedding_dedup.near_duplicates(df, block=block)
    # products of 1e200 overflow in the plain formula, so lengths are taken out first there
    plain = [(k, v if v is None or k not in (50, 51) else [1.0] * len(v)) for k, v in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == links_by_hand(plain)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_links_of_the_tables_equal_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    same(QUERIES["op12_embedding_dedup"](spark, folder), SQL["op12_embedding_dedup"], folder)


def test_pairs_at_the_threshold_are_found(spark):
    """The index alone, without the help of components: pairs at a cosine of 0.951 each."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df).filter("n_links = 1 and component_id = vec_id - vec_id % 2").count()
    assert found >= 0.995 * len(rows)


def test_shape_of_the_index_grows_slowly():
    assert embedding_dedup.shape(10**4, 0.95, 0.999) < embedding_dedup.shape(10**9, 0.95, 0.999)
    assert embedding_dedup.shape(10**9, 0.95, 0.99)[1] < 600
    rng = np.random.default_rng(1)
    x = embedding_dedup.units(rng.standard_normal((4000, 64)))
    y = embedding_dedup.units(x + 0.3162 / 8 * rng.standard_normal(x.shape))
    d = np.linalg.norm(x - y, axis=1).mean()
    meet = (embedding_dedup.bucket_keys(x, 1, 50) == embedding_dedup.bucket_keys(y, 1, 50)).mean()
    assert abs(meet - embedding_dedup.same_cell(d)) < 0.01


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).collect() == []


# ---------------------------------------------------------------- operator 13


def damage_by_hand(rows):
    out = []
    one = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (1 + (k == 3))
    return out


def cheapest_by_hand(rows):
    """Of all sequences of edits, no machine: (cost, audit, lines)."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, roles, lines, added):
        if not re.fullmatch("(s?(ua)*u?)?", roles) or (cost, audit) > best[0][:2] and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit, lines))
        if added < 3:
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", roles + r[0], [*lines, f"{r}:"], added + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, lines, 0)
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                go(i + 1, cost + more, audit + "K", roles + (role[:1] or "?"), [*lines, f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", roles + r[0], [*lines, f"{r}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    return best[0]


def repair_by_hand(rows):
    out = []
    hurt = damage_by_hand(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest_by_hand([(r[2], r[3], f) for r, f in zip(own, faults)])
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return set(out)


def conversations_at_random(seed: int, n: int, most: int = 5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        for k in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "User"]) if rng.random() < 0.5 else ("user", "assistant")[k % 2]
            text = rng.choice(["Yes.", "No!", "Why? ", "open", "", " \t\n", None, "é ", "Yes.", "a.b\nc.", "　"])
            rows.append((c, None if rng.random() < 0.1 else turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 0])
    return rows + [(None, 1, "user", "a."), (None, None, None, None), (None, 1, "user", "a.")]


@pytest.mark.parametrize("piece", [4096, 2])
def test_repairs_equal_brute_force(spark, piece):
    rows = conversations_at_random(5, 150)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, AUDIT string")
    got = {tuple(r) for r in conversations.repair(df, piece=piece).collect()}
    want = repair_by_hand(rows)
    assert any(r[7] == "" for r in want) and len({c for r in want for c in r[7]}) == 4
    assert got == want


def test_long_conversations_equal_whole_ones_in_pieces(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"n {t}.", f"n {t}", " "])) for c, n in ((1, 3000), (2, 700), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {tuple(r) for r in conversations.repair(df, piece=8192).collect()}
    assert one == {tuple(r) for r in conversations.repair(df, piece=64).collect()}
    assert {r[0] for r in one} == {1, 2, 3}


def test_repairs_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    sizes = Counter(r[0] for r in damage_by_hand(rows))
    some = {c for c in {r[0] for r in rows} if sizes[c] <= 6}
    assert len(some) >= 10
    assert {r for r in got if r[0] in some} == repair_by_hand([r for r in rows if r[0] in some])


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(none).collect() == []


def test_steps_are_few():
    """The composition is built lazily: states in use do not grow with the input."""
    rng = random.Random(2)
    conversations.step.cache_clear()
    conversations.costs_before("".join(rng.choice(list(conversations.MEANING)) for _ in range(50_000)), conversations.CLOSING)
    assert conversations.step.cache_info().currsize < 400
