"""Operators 8 and 9: recall and scores against brute force, archives against their rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quillmark.llm.common import new_path
from quillmark.llm.queries import QUERIES
from quillmark.llm.vector_search import fit_index, nearest, scan, usable
from quillmark.llm.warc import exits, page_of, read_archives, successor, write_archives
from tests.conftest import SF


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = {}
            for j, x in good:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(sum(a * b for a, b in zip(q, x))))
            out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def check(df, rows, every, k, least):
    got: dict = {}
    for r in nearest(df, every, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, every, k)
    assert set(got) == {q for q in want if want[q]}
    found = total = 0
    known = {(i, j): s for i in want for s, j in [(s, j) for s, j in brute_all(rows, i)]}
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        for _, j, s in mine:
            assert s == pytest.approx(known[q, j], abs=1e-12)
        found += len({j for _, j, _ in mine} & {j for _, j in best})
        total += len(best)
    assert found >= least * total


def brute_all(rows, q):
    v = dict((i, x) for i, x in rows if i == q)[q]
    return [(float(sum(a * b for a, b in zip(v, x))), j) for j, x in rows if j is not None and j != q and x and all(c is not None for c in x)]


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (40, [-1.0, 0.5]), (7, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    good = [r for r in rows if r[0] in (0, 1, 40)]
    check(df, good, 20, 20, 1.0)
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.filter("vec_id = 2")).count() == 0


def test_ties_go_to_smaller_ids_and_copies_to_themselves(spark):
    rng = np.random.default_rng(1)
    base = [rng.standard_normal(8).tolist() for _ in range(3)]
    rows = [(k, base[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in nearest(df, 20, 10).filter("query_id = 0").orderBy("rank").collect()]
    assert got == [(k + 1, 3 * (k + 1)) for k in range(10)]


def test_recall_on_many_lists_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 24)) * rng.uniform(0.2, 3, (6000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest(df, 50, 20, candidates=700, asked=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::50] @ x.T
    hits = 0
    for n, q in enumerate(range(0, 6000, 50)):
        score[n, q] = -np.inf
        assert len(got[q]) == 20
        hits += len(got[q] & set(np.argsort(-score[n])[:20].tolist()))
    assert hits >= 0.9 * 20 * 120


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_with_lists_skipped(spark, clustered):
    """Over 20 lists; at least a quarter of them skipped where vectors have no clusters at all, most where they have."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 32))
    if clustered:
        x = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] * 2 + x * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = fit_index(usable(df, "vec_id", "embedding"), 20)
    assert len(index.centres) >= 100 and index.probes <= (0.2 if clustered else 0.75) * len(index.centres)
    got: dict = {}
    for r in nearest(df, 50, 20, candidates=900, asked=64, per_cell=1000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    # what is returned lies in probed lists
    home = np.argmax(x @ index.centres.T, axis=1)
    hits = 0
    for q in range(0, 6000, 50):
        probed = set(np.argsort(-(x[q] @ index.centres.T), kind="stable")[: index.probes].tolist())
        assert len(got[q]) == 20 and {int(home[j]) for j in got[q]} <= probed
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 120


def test_scan_abandons_early_and_raises_its_bound():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    ids, lists = np.arange(3000), np.arange(3000) % 30
    q = x[:20]
    probed = [rng.permutation(30).tolist() for _ in range(20)]
    work: list = []
    i, j, s = scan(ids[:20], q, np.full(20, -np.inf), probed, ids, x, lists, rotation, 10, 16, 3.0, work)
    done, whole = work[0]
    assert whole == 20 * 3000 * 64 and done < 0.75 * whole
    full = q @ x.T
    full[np.arange(20), np.arange(20)] = -np.inf
    want = np.sort(full, axis=1)[:, ::-1][:, :10]
    hits = sum(len(set(np.round(s[i == n], 9)) & set(np.round(want[n], 9))) for n in range(20))
    assert hits >= 0.97 * 200
    # without tests it is the exact answer
    i, j, s = scan(ids[:20], q, np.full(20, -np.inf), probed, ids, x, lists, rotation, 10, 64, 3.0)
    assert all(np.allclose(np.sort(s[i == n])[::-1], want[n]) for n in range(20))


def test_registered_search(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got: dict = {}
    for r in QUERIES["op8_vector_search"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q in got:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits += len(set(got[q]) & set(ids[np.argsort(-s)[:20]].tolist()))
        assert len(got[q]) == 20
    assert hits >= 0.95 * 20 * len(got)


# -- archives -------------------------------------------------------------------

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", 0) for k, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes int")


def expected(rows, least=100):
    first: dict = {}
    for k, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min(first.get(b, k), k)
    out, used = [], set()
    for k, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        again = b in first and (first[b] != k or (b, k) in used)
        used.add((b, k))
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    long = "é" * 60
    rows = [
        (1, "http://a/", "<p>" + long), (2, "http://b/\r\nX: y", "<p>" + long), (3, None, None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (-7, "neg", "<p>" + long),
        (8, "magic", "before\r\n\r\n" + RECORD * 3 + "after"), (9, "magic", RECORD), (10, "x", "a" * 99), (11, "x", "a" * 99), (12, "x", "b" * 100), (13, "x", "b" * 100), (13, "x", "b" * 100),
        (2**63 - 1, "big", "WARC/1.1\r\n\r\n\r\n"), (-(2**63), "least", "z" * 300_000), (14, "nul", "\x00\r\n\r\n\x00"),
    ]
    path = new_path(spark, "w")
    write_archives(pages(spark, rows).repartition(3), path)
    got = read_archives(spark, path, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    payload = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == payload[r.page_id] for r in got if r.record_type == "response")


def test_no_pages(spark):
    path = new_path(spark, "w")
    write_archives(pages(spark, []), path)
    assert read_archives(spark, path).count() == 0


def test_exits_by_pointer_jumping():
    starts = np.array([0, 10, 25, 30, 55, 70, 90])
    ends = np.array([25, 55, 70, -1, 70, 120, 95])  # 10, 30 and 55 stand in payloads; 90 points where no candidate is
    out, last = exits(starts, ends)
    assert out.tolist() == [120, 120, 120, -1, 120, 120, 95]
    assert last.tolist() == [70, 70, 70, 30, 70, 70, 90]
    assert successor(RECORD.encode()) == successor(RECORD.encode() * 2) == len(RECORD)
    assert successor(b"WARC/1.1\r\n\r\n") == successor(b"junk\r\nContent-Length: 5\r\n\r\n") == successor(b"WARC/1.1\r\nContent-Length: 5") == -1


@pytest.mark.parametrize("split", [1009, 4096, 50_000, 1 << 20])
def test_splits_across_records(spark, split, tmp_path):
    """One file in splits of a few bytes to all of it, with magic and whole records in payloads across them."""
    rng = np.random.default_rng(split)
    odd = ["\r\n\r\nWARC/1.1\r\n", RECORD, RECORD * 2, "\r\n\r\n" + RECORD, "WARC/1.1", "\r\n", "\r\n\r\n", "é", "x" * 50, "WARC/1.1\r\nContent-Length: 999999\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 61\r\n\r\n"]
    rows = [(k, f"http://a/{k}", "".join(odd[j] for j in rng.integers(0, len(odd), rng.integers(0, 30)))) for k in range(80)]
    rows += [(100, "u" * 70_000, "long header " * 20), (101, "v", "\r\n\r\nWARC/1.1\r\nz" * 300), (None, "no id", "y" * 200), (None, None, None), (102, "w", "y" * 200)]
    path = str(tmp_path / "w")
    write_archives(pages(spark, rows).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = read_archives(spark, path, with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    known = [r for r in rows if r[0] is not None]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None), key=repr) == expected(known)
    payload = {k: (h or "").encode() for k, _, h in known}
    assert all(bytes(r.payload) == payload[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert sorted((r.record_type, bytes(r.payload), r.url) for r in got if r.page_id is None and r.url) == [("response", b"y" * 200, "no%20id")]
    assert len(got) == len(rows) and {r.url for r in got if r.page_id == 100} == {"u" * 70_000}


@pytest.mark.parametrize("change", [lambda d: d[:-3], lambda d: b"junk" + d, lambda d: d.replace(b"payload payload", b"payloadpayload", 1), lambda d: d + b"tail", lambda d: d.replace(b"Content-Length: 3", b"Content-Length: 4", 1)])
def test_broken_chains_raise(spark, change, tmp_path):
    path = tmp_path / "w"
    write_archives(pages(spark, [(k, "u", "payload " * 40 + str(k)) for k in range(20)]).coalesce(1), str(path))
    (name,) = path.glob("part-*")
    data = name.read_bytes()
    for crc in path.glob(".*.crc"):
        crc.unlink()
    name.write_bytes(change(data))
    with pytest.raises(Exception, match="breaks|make it up"):
        read_archives(spark, str(path)).collect()


def test_record_ids(spark):
    from quillmark.llm.warc import _record_id

    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    rows = spark.createDataFrame([(i,) for i in ids], "i long")
    assert [page_of(r[0]) for r in rows.select(_record_id(rows.i)).collect()] == ids


def test_queries_unlike_the_other_rows(spark):
    """Rows in tight clusters, queries anywhere: a number of probes that serves rows serves no query."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.2 * rng.standard_normal((6000, 32))
    x[::50] = rng.standard_normal((120, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest(df, 50, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::50] @ x.T
    s[np.arange(120), np.arange(0, 6000, 50)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert sum(len(got.get(50 * i, set()) & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * 20 * 120


def test_candidates_that_repeat_an_id_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x) for _ in range(4)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest(df, 50, 20, z=9.0, target=1.0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(got[q]) == len(set(got[q])) == 20 for q in range(0, 300, 50))


def test_tests_hold_for_vectors_with_much_in_common():
    """A rotation errs alike for what all vectors share: it is not part of what is tested."""
    rng = np.random.default_rng(16)
    hits = 0
    for _ in range(20):
        x = rng.standard_normal((400, 64)) * 0.1 + 3 * rng.standard_normal(64)
        rotation, _ = np.linalg.qr(rng.standard_normal((64, 64)))
        ids = np.arange(400)
        full = x[:20] @ x.T
        full[np.arange(20), np.arange(20)] = -np.inf
        least = np.sort(full, axis=1)[:, -10]
        i, j, _ = scan(ids[:20], x[:20], least, [[0]] * 20, ids, x, np.zeros(400, int), rotation, 10, 16, 2.5)
        want = np.argsort(-full, axis=1)[:, :10]
        hits += sum(len(set(j[i == n].tolist()) & set(want[n].tolist())) for n in range(20))
    assert hits >= 0.97 * 20 * 200
