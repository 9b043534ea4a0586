"""Approximate nearest neighbours by adaptive dimension scan (operator 8).

Vectors are rotated at random, so d of D columns hold close to d / D of an inner product, with
a variance that the vectors' lengths give.  A query probes the lists whose centres are nearest
to it.  They are scanned in blocks of columns, best list first; after a block, a candidate is
abandoned when a test at ``z`` standard deviations rejects that its whole inner product
reaches the query's k-th best score so far, which every list raises for the next.  What is
tested is the candidate's difference from the mean of its list, as one rotation errs alike for
all that vectors have in common.  Survivors are scored exactly on the original vectors.

Queries need not be like most rows: one whose nearest vectors in the sample mostly lie beyond the
lists that rows in general need probes as many as hold these.

Nothing outside the probed lists is looked at.  Lists are grouped into cells of about equal size; a task scans one block of a cell's
candidates for one block of queries, so neither a large list nor a frequent one is one task's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table, written

_CELLS = pa.list_(pa.struct([("cell", pa.int32()), ("lists", pa.binary())]))
_NEAR = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


@dataclass(frozen=True)
class ListIndex:
    """Fitted on a bounded sample: rotation, list centres, lists to probe, cell of each list, and the sample itself."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    cell: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_list: np.ndarray

    @property
    def dim(self) -> int:
        return self.rotation.shape[0]


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) of rows with a key and a non-empty vector of finite components, not all 0."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _order(centres: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lists by inner product with the centre, best first; one row per query."""
    return np.argsort(-(q @ centres.T), axis=1, kind="stable")


def train_centres(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of length 1 by spherical k-means."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def probes_for(centres: np.ndarray, x: np.ndarray, k: int, target: float, asked: int = 512) -> int:
    """The fewest lists to probe that hold ``target`` of the k nearest rows of ``x`` of some rows of ``x``."""
    near = np.argmax(x @ centres.T, axis=1)
    own = np.arange(len(x))[:: max(1, len(x) // asked)]
    score = x[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    kth = min(k, len(x) - 1)
    if kth < 1:
        return len(centres)
    best = np.argpartition(-score, kth - 1, axis=1)[:, :kth]
    rank = np.argsort(_order(centres, x[own]), axis=1)  # rank[i, list]
    needed = np.sort(np.take_along_axis(rank, near[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def fit_index(rows: DataFrame, k: int, sample: int = 16_384, per_list: int = 50, per_cell: int = 8192, target: float = 0.95, seed: int = 11) -> ListIndex | None:
    """Centres from one half of at most ``sample`` vectors chosen by hash, the number of probes from the other half.

    There is a list for every ``per_list`` vectors, but at most one for every 16 of the half
    sample.  The number of probes is the smallest that finds ``target`` of the neighbours that
    queries of the other half have there; no centre was trained on these, and as neighbours
    among fewer vectors are farther off, all vectors' recall is expected above it.  None if
    there is no vector.
    """
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if found is None:
        return None
    dim, n = found["d"], found["count"]
    some = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toArrow()
    x = np.array(some["v"].to_pylist(), np.float64).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    lists = max(1, min(n // per_list, len(x) // 32))
    centres = train_centres(x[::2], lists, rng) if lists > 1 else np.zeros((1, dim))
    probes = probes_for(centres, x[1::2], k, target) if lists > 1 else 1
    # neighbouring lists along the main axis share a cell
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    cells = max(1, min(lists, -(-n // per_cell)))
    home = np.argmax(x @ centres.T, axis=1)
    held = np.bincount(home, minlength=lists)
    cell = np.zeros(lists, np.int32)
    order = np.argsort(centres @ axis, kind="stable")
    before = np.cumsum(held[order]) - held[order]
    cell[order] = np.minimum(before * cells // max(1, held.sum()), cells - 1)
    return ListIndex(rotation, centres, probes, cell, some["vec_id"].to_numpy(), x, home)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products pair by pair in double precision, summed in the order of the components."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids, in order."""
    if len(score) > k:
        bound = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= bound)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _by_id(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores with a column for each id, the best of those that repeat it."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    return score if len(first) == len(ids) else np.maximum.reduceat(score[:, order], first, axis=1)


class Best:
    """The k best candidates so far of each query; ties to smaller ids.  Of places that repeat an id (``repeats``) the best counts."""

    def __init__(self, least: np.ndarray, k: int, repeats: bool = False):
        self.k, self.bound, self.repeats = k, least.copy(), repeats
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, place, score = np.concatenate([self.query, query]), np.concatenate([self.place, place]), np.concatenate([self.score, score])
        if self.repeats:
            order = np.lexsort((-score, ids[place], query))
            query, place, score = query[order], place[order], score[order]
            first = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(ids[place]) != 0)])
            query, place, score = query[first], place[first], score[first]
        order = np.lexsort((ids[place], -score, query))
        query, place, score = query[order], place[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kth = rank == self.k - 1
        self.bound[query[kth]] = np.maximum(self.bound[query[kth]], score[kth])
        keep = rank < self.k
        self.query, self.place, self.score = query[keep], place[keep], score[keep]


def scan(q_ids, q, least, probed, x_ids, x, x_list, rotation, k: int, block: int, z: float, work: list | None = None):
    """For each query its best k among the candidates of its lists: (query places, candidate places, scores).

    ``probed`` holds the lists of each query, best first; in turn r every query scans its r-th
    one with the bound that the turns before left.  ``work`` gets (multiplications done, those
    of whole scans).
    """
    dim = q.shape[1]
    cuts = [*range(0, dim, block), dim]
    order = np.argsort(x_list, kind="stable")
    names, begin, sizes = np.unique(x_list[order], return_index=True, return_counts=True)
    members = {int(n): order[a : a + m] for n, a, m in zip(names, begin, sizes)}
    means = np.add.reduceat(x[order], begin, axis=0) / sizes[:, None] if len(order) else np.zeros((0, dim))
    rest = x - means[np.searchsorted(names, x_list)]
    at_mean = q @ means.T  # inner products with the means, which are taken as they are
    column = {int(n): i for i, n in enumerate(names)}
    rq, rx = q @ rotation, rest @ rotation
    size_q, size_x = np.sqrt((q**2).sum(axis=1)), np.sqrt((rest**2).sum(axis=1))
    best = Best(least, k, len(np.unique(x_ids)) < len(x_ids))
    done = whole = 0
    for turn in range(max(map(len, probed), default=0)):
        asks: dict[int, list[int]] = {}
        for i, lists in enumerate(probed):
            if turn < len(lists) and lists[turn] in members:
                asks.setdefault(lists[turn], []).append(i)
        found = []
        for name, asking in asks.items():
            who, what = np.asarray(asking), members[name]
            seen = rq[who, : cuts[1]] @ rx[what, : cuts[1]].T
            done, whole = done + seen.size * cuts[1], whole + seen.size * dim
            i = j = None
            for b in range(1, len(cuts)):
                part = cuts[b] / dim
                spread = z * np.sqrt(part * (1 - part) / dim)
                if b == 1:
                    mean = at_mean[who, column[name]]
                    bound, slack = (best.bound[who] - mean)[:, None], 1e-9 * (np.abs(best.bound[who]) + np.abs(mean))[:, None]
                    i, j = np.nonzero(seen + spread * np.outer(size_q[who], size_x[what]) >= bound * part - slack)
                    seen, i, j = seen[i, j], who[i], what[j]
                else:
                    mean = at_mean[i, column[name]]
                    bound, slack = best.bound[i] - mean, 1e-9 * (np.abs(best.bound[i]) + np.abs(mean))
                    keep = seen + spread * size_q[i] * size_x[j] >= bound * part - slack
                    seen, i, j = seen[keep], i[keep], j[keep]
                if b + 1 < len(cuts) and len(i):
                    seen = seen + np.einsum("nd,nd->n", rq[i, cuts[b] : cuts[b + 1]], rx[j, cuts[b] : cuts[b + 1]])
                    done += len(i) * (cuts[b + 1] - cuts[b])
            other = x_ids[j] != q_ids[i]
            found.append((i[other], j[other]))
        if found:
            i, j = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            best.add(i, j, exact_scores(q[i], x[j]), x_ids)
    if work is not None:
        work.append((done, whole))
    return best.query, best.place, best.score


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding", block: int = 16, z: float = 2.5, candidates: int = 8192, asked: int = 1024, **index_options) -> DataFrame:
    """The k nearest found (largest inner product) of each row whose key is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score, ties to the smaller vec_id; all
    candidates where there are fewer than k.  Vectors that are null or zero, hold null or
    non-finite components, or have another length than most, take no part; nor do null keys.
    Rows that repeat a key are one query, and none of them is its neighbour; as a candidate the
    key counts once, with its best vector.  Keys must be whole numbers.

    All rows are indexed (``fit_index``, whose options may be given).  Cells are dealt out in
    blocks of about ``candidates`` vectors and ``asked`` queries, so a list that holds a third
    of all rows is many groups; a group returns k rows a query at most.  Each query starts
    from its k-th best score among the sample's vectors in its probed lists, which is a true
    lower bound of what probing these lists finds.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    index = fit_index(rows, k, **index_options)
    empty = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(index)
    rows = rows.filter(F.size("v") == index.dim)

    def place(batches):
        at = shared.value
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, at.dim)
            near = np.argmax(x @ at.centres.T, axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(at.cell[near]), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "list", "cell", "x"])

    def ask(batches):
        at = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                ids = b.column(0).to_numpy()
                q = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, at.dim)
                order = _order(at.centres, q).astype(np.int32)
                score = q @ at.sample.T
                score[ids[:, None] == at.sample_ids[None, :]] = -np.inf
                turn = np.argsort(order, axis=1)  # turn[i, list]
                held = min(k, score.shape[1])
                closest = np.argpartition(-score, held - 1, axis=1)[:, :held]
                needed = np.take_along_axis(turn, at.sample_list[closest], axis=1)
                needed = np.sort(np.where(np.isfinite(np.take_along_axis(score, closest, axis=1)), needed, 0), axis=1)
                unlike = needed[:, -1 - held // 4] >= at.probes
                probes = np.where(unlike, needed[:, -1] + 1, at.probes)
                score[turn[:, at.sample_list] >= probes[:, None]] = -np.inf
                single = _by_id(score, at.sample_ids)
                least = np.partition(single, single.shape[1] - k, axis=1)[:, single.shape[1] - k] if single.shape[1] > k else np.full(len(q), -np.inf)
                near, cells = [], []
                for i in range(len(q)):
                    some = np.flatnonzero((score[i] > -np.inf) & (score[i] >= least[i] - 1e-9))
                    exact = exact_scores(np.broadcast_to(q[i], (len(some), at.dim)), at.sample[some])
                    best = _top(exact, at.sample_ids[some], k)
                    near.append([{"vec_id": int(at.sample_ids[some[j]]), "score": float(exact[j])} for j in best])
                    lists = order[i, : probes[i]]
                    home = at.cell[lists]
                    cells.append([{"cell": int(c), "lists": lists[home == c].tobytes()} for c in np.unique(home)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(least), pa.array(cells, _CELLS), pa.array(near, _NEAR)], names=["query_id", "q", "least", "cells", "near"])

    placed = written(rows.mapInArrow(place, "vec_id long, list int, cell int, x binary"), "lists")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = written(queries.mapInArrow(ask, "query_id long, q binary, least double, cells array<struct<cell:int,lists:binary>>, near array<struct<vec_id:long,score:double>>"), "asked")
    from_sample = queries.select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score")
    queries = queries.select("query_id", "q", "least", F.explode("cells").alias("c")).select("query_id", "q", "least", "c.cell", "c.lists")
    # per cell: how many blocks of candidates and of queries (as many rows as there are cells, at most as lists)
    n = placed.groupBy("cell").agg(F.ceil(F.count("*") / candidates).cast("int").alias("subs"))
    m = queries.groupBy("cell").agg(F.ceil(F.count("*") / asked).cast("int").alias("asks"))
    sizes = F.broadcast(n.join(m, "cell"))
    left = queries.join(sizes, "cell").select("query_id", "q", "least", "lists", "cell", F.pmod(F.xxhash64("query_id"), "asks").cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    right = placed.join(sizes, "cell").select("vec_id", "x", "list", "cell", F.pmod(F.xxhash64("vec_id"), "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))

    def answer(_, asked_rows: pa.Table, found_rows: pa.Table) -> pa.Table:
        at = shared.value
        unpack = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.float64).reshape(-1, at.dim)
        q_ids, x_ids = asked_rows["query_id"].to_numpy(), found_rows["vec_id"].to_numpy()
        if not len(q_ids) or not len(x_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        probed = [np.frombuffer(x, np.int32).tolist() for x in asked_rows["lists"].to_pylist()]
        i, j, s = scan(q_ids, unpack(asked_rows["q"]), asked_rows["least"].to_numpy(), probed, x_ids, unpack(found_rows["x"]), found_rows["list"].to_numpy(), at.rotation, k, block, z)
        return pa.table({"query_id": q_ids[i], "vec_id": x_ids[j], "score": s})

    keys = ["cell", "sub", "ask"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hits = hits.unionByName(from_sample).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
