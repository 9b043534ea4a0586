"""Near-duplicate embeddings (operator 12): Euclidean p-stable hashing, then exact cosines.

Vectors are brought to length 1, where a cosine is a distance.  A table of the index quantises
``k`` random projections, (a . v + b) / WIDTH rounded down, and vectors that agree in all of them
share its bucket.  ``k`` grows with the logarithm of the number of vectors so that vectors
that have nothing in common seldom meet, and there are as many tables as it takes for a pair
just at the threshold to meet in one of them with probability ``recall``; closer pairs meet
in more.  Vectors that share a bucket are compared exactly.

Equal vectors are one class throughout.  A bucket returns a spanning forest of its links, never
its pairs.  In a bucket of more than ``block`` vectors all are first compared with one of them;
what that leaves apart is compared in blocks, and a bucket whose vectors are all in one
component by then is done.  Links are counted within components.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import by_weight, forget, small_batches, table, written
from quillmark.llm.components import components

#: Of the projections' quantisation, for vectors of length 1; the rate of needless meetings hardly depends on it between 1.5 and 3.
WIDTH = 2.0
SEED = 12


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two vectors at this distance is equal."""
    r = width / max(distance, 1e-9)
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float, recall: float, meetings: float = 1 / 16) -> tuple[int, int]:
    """(projections of a table, tables): a vector meets ``meetings`` of ``n`` orthogonal ones in a table."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold)), same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / meetings) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


@lru_cache(maxsize=4)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions of all tables, offsets), the same in every task."""
    rng = np.random.default_rng((SEED, dim, k))
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)


def bucket_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(vectors x tables) keys; those of different tables or lengths of vectors have nothing in common."""
    directions, offsets = projections(unit.shape[1], k, tables)
    cell = np.floor((unit @ directions + offsets) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    out = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32), (len(unit), tables)).copy()
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, :, j] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def vectors_of(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.float64).reshape(len(codes), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two vectors of length 1, rounded once per sum."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` link with which of ``y``; what rounding may decide is computed anew."""
    cos = x @ y.T
    out = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
        out[i, j] = cosine(x[i], y[j]) >= threshold
    return out


def linked_rows(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The same for row i of ``x`` and row i of ``y``."""
    cos = np.einsum("nd,nd->n", x, y)
    out = cos >= threshold
    for i in np.flatnonzero(np.abs(cos - threshold) < 1e-12):
        out[i] = cosine(x[i], y[i]) >= threshold
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.ones(len(links), bool)
    out = []
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(links[i] & left).tolist():
                left[j] = False
                out.append((i, j))
                stack.append(j)
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _edges(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def classes_of(rows: DataFrame) -> DataFrame:
    """(class, code, n, least) of rows (vec_id, code): equal vectors are one class, written once as its number is not computed alike twice."""
    own = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return written(own.select(F.monotonically_increasing_id().alias("class"), "code", "n", "least"), "classes")


def coded(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, code): the components as doubles, null where a vector takes no part.

    No part take null, empty and zero vectors, those with null or non-finite components, and
    those whose key is null.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)

    def run(batches):
        for b in batches:
            x = b.column(1)
            flat = (x.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(np.float64)  # -0.0 counts as 0.0
            ends = np.cumsum([0 if v is None else v for v in pc.list_value_length(x).to_pylist()])
            there = x.is_valid().to_pylist()
            codes = [flat[(ends[i - 1] if i else 0) : ends[i]].tobytes() if there[i] else None for i in range(len(there))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return rows.select("vec_id", F.when(fit, F.col("v")).alias("v")).mapInArrow(run, "vec_id long, code binary")


def near_edges(classes: DataFrame, threshold: float, recall: float, block: int) -> DataFrame:
    """Edges (a, b) between classes that keep together what links found keep together."""
    total = classes.count()
    k, tables = shape(total, threshold, recall)

    def hashed(batches):
        for b in batches:
            codes = b.column(1).to_pylist()
            ids = b.column(0).to_numpy()
            size = np.array([len(c) for c in codes])
            for width in np.unique(size):
                some = np.flatnonzero(size == width)
                for low in range(0, len(some), 512):
                    at = some[low : low + 512]
                    keys = bucket_keys(units(vectors_of([codes[i] for i in at])), k, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at], tables))], names=["key", "class"])

    hashes = written(classes.select("class", "code").mapInArrow(hashed, "key long, class long"), "hashes")
    buckets = written(hashes.groupBy("key").agg(F.count("*").alias("m"), F.min("class").alias("head")).filter("m > 1"), "buckets")
    members = written(by_weight(hashes, buckets, "key", "m"), "members")
    forget(hashes)
    code = classes.select("class", "code")
    small = members.filter(F.col("m") <= block)
    groups = max(1, -(-small.count() // (4 * block)))

    def compare(found: pa.Table) -> pa.Table:
        found = found.sort_by([("key", "ascending"), ("class", "ascending")])
        ids, codes = found["class"].to_numpy(), found["code"].to_pylist()
        first, size = _runs(found["key"].to_numpy())
        a, b = [], []
        twos: dict[int, list[int]] = {}  # most buckets hold two: all of them at once
        for f in first[size == 2].tolist():
            if len(codes[f]) == len(codes[f + 1]):
                twos.setdefault(len(codes[f]), []).append(f)
        for some in twos.values():
            at = np.array(some)
            good = at[linked_rows(units(vectors_of([codes[i] for i in at])), units(vectors_of([codes[i + 1] for i in at])), threshold)]
            a += ids[good].tolist()
            b += ids[good + 1].tolist()
        for f, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            by_size: dict[int, list[int]] = {}
            for i in range(f, f + m):
                by_size.setdefault(len(codes[i]), []).append(i)
            for at in by_size.values():
                x = units(vectors_of([codes[i] for i in at]))
                for i, j in forest(linked(x, x, threshold)):
                    a.append(int(ids[at[i]]))
                    b.append(int(ids[at[j]]))
        return _edges(a, b)

    edges = written(
        small.select("key", "class").join(code, "class").groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")).applyInArrow(compare, "a long, b long").distinct(), "near"
    )
    large = buckets.filter(F.col("m") > block)
    if not large.isEmpty():
        edges = _large_buckets(members.filter(F.col("m") > block), large, code, edges, threshold, block)
    forget(members, buckets)
    return edges


def _large_buckets(members: DataFrame, buckets: DataFrame, code: DataFrame, edges: DataFrame, threshold: float, block: int) -> DataFrame:
    def hold(batches):
        for b in batches:
            own, head = b.column(1).to_pylist(), b.column(3).to_pylist()
            fits = [i for i in range(b.num_rows) if len(own[i]) == len(head[i])]
            for low in range(0, len(fits), 4096):
                at = fits[low : low + 4096]
                sizes = np.array([len(own[i]) for i in at])
                for width in np.unique(sizes):
                    some = [at[i] for i in np.flatnonzero(sizes == width)]
                    good = linked_rows(units(vectors_of([own[i] for i in some])), units(vectors_of([head[i] for i in some])), threshold)
                    some = np.array(some)[good]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(2).take(pa.array(some))], names=["a", "b"])

    heads = written(buckets.select("key", "m", F.col("head").alias("class")).join(code, "class").select("key", "m", F.col("class").alias("head"), F.col("code").alias("head_code")), "heads")
    own = members.filter("class <> head").select("key", "class").join(code, "class")
    star = by_weight(own, heads, "key", "m", most=20_000).select("class", "code", "head", "head_code").mapInArrow(hold, "a long, b long").distinct()
    first = written(edges.unionByName(star), "near")
    forget(edges, heads)
    labels = components(first)
    # what is in one component by now need not meet again
    named = members.select("key", "class", "m").join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("key", "class", "m", F.coalesce("label", "class").alias("label"))
    named = written(named, "named")
    parts = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("m"), F.count("*").alias("labels"))
    parts = parts.filter("labels > 1").select("key", "m", F.col("most.label").alias("main"), F.ceil(F.col("most.n") / block).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("most.n")) / block).cast("int").alias("others"))
    apart = by_weight(named.drop("m"), written(parts, "parts"), "key", "m")
    main = F.col("label") == F.col("main")
    part = F.pmod(F.xxhash64("class"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    each = F.sequence(F.lit(0), F.col("others") - 1)
    places = F.when(main, F.transform(each, lambda o: F.struct(F.lit(0).alias("kind"), F.col("part").alias("x"), o.alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda p: F.struct(F.lit(0).alias("kind"), p.alias("x"), F.col("part").alias("y"))),
            F.transform(each, lambda o: F.struct(F.lit(1).alias("kind"), F.least("part", o).alias("x"), F.greatest("part", o).alias("y"))),
        )
    )
    dealt = apart.withColumn("part", part).select("key", "class", "label", F.explode(places).alias("p")).select("key", "class", "label", "p.*").join(code, "class")

    def across(found: pa.Table) -> pa.Table:
        ids, label, codes = found["class"].to_numpy(), found["label"].to_numpy(), found["code"].to_pylist()
        size = np.array([len(c) for c in codes])
        a, b = [], []
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            x = units(vectors_of([codes[i] for i in at]))
            for i, j in forest(linked(x, x, threshold) & (label[at][:, None] != label[at][None, :])):
                a.append(int(ids[at[i]]))
                b.append(int(ids[at[j]]))
        return _edges(a, b)

    more = dealt.groupBy("key", "kind", "x", "y").applyInArrow(across, "a long, b long").distinct()
    out = written(first.unionByName(more), "near")
    forget(first, labels, named)
    return out


def link_counts(classes: DataFrame, labels: DataFrame, threshold: float, block: int) -> DataFrame:
    """(class, near): number of vectors of other classes that link with the class, all within its component.

    Components of at most ``block`` classes are compared whole.  In larger ones every class has
    an angle to the component's first; angles add up, so classes whose angles sum to the
    threshold's at most are linked for certain and those whose angles differ by more are not.
    They are told apart by bins of angles; the rest is compared in blocks.
    """
    own = written(classes.select("class", "code", "n").join(labels.select(F.col("node").alias("class"), "label"), "class"), "linked")
    sizes = written(own.groupBy("label").agg(F.count("*").alias("m")), "sizes")
    small = by_weight(own, sizes.filter(F.col("m") <= block), "label", "m")
    groups = max(1, -(-own.count() // (4 * block)))

    def count(found: pa.Table) -> pa.Table:
        found = found.sort_by([("label", "ascending")])
        n, codes = found["n"].to_numpy(), found["code"].to_pylist()
        near = np.zeros(len(n), np.int64)
        for f, m in zip(*_runs(found["label"].to_numpy())):
            x = units(vectors_of(codes[f : f + m]))
            near[f : f + m] = linked(x, x, threshold) @ n[f : f + m] - n[f : f + m]
        return pa.table({"class": found["class"], "near": near})

    out = small.groupBy(F.pmod(F.xxhash64("label"), F.lit(groups)).alias("group")).applyInArrow(count, "class long, near long")
    large = sizes.filter(F.col("m") > block)
    if large.isEmpty():
        return out
    pivots = written(large.join(own.select(F.col("class").alias("label"), F.col("code").alias("pivot")), "label"), "pivots")
    widest = math.acos(threshold)
    bins = 64

    def angles(batches):
        for b in batches:
            at = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            if b.num_rows:
                cos = np.einsum("nd,nd->n", units(vectors_of(at["code"].to_pylist())), units(vectors_of(at["pivot"].to_pylist())))
                where = np.floor(np.arccos(np.clip(cos, -1, 1)) / widest * bins).astype(np.int32)
                yield pa.RecordBatch.from_arrays([at["label"], at["class"], at["n"], at["code"], pa.array(where)], names=["label", "class", "n", "code", "bin"])

    placed = by_weight(own, pivots, "label", "m", most=20_000).select("label", "class", "n", "code", "pivot").mapInArrow(angles, "label long, class long, n long, code binary, bin int")
    placed = written(placed, "angles")
    held = written(placed.groupBy("label", "bin").agg(F.count("*").alias("m"), F.sum("n").alias("n")), "bins")
    mine, other = held.select("label", "bin", "m"), held.select("label", F.col("bin").alias("bin_"), F.col("m").alias("m_"), F.col("n").alias("n_"))
    both = mine.join(other, "label")
    # a bin's angles lie within its edges but for rounding, for which a bin is left
    sure = F.col("bin") + F.col("bin_") + 2 < bins
    never = F.abs(F.col("bin") - F.col("bin_")) > bins + 1
    known = F.sum(F.when(sure, F.col("n_")).otherwise(0))
    open_ = F.filter(F.collect_list(F.when(~sure & ~never, F.struct("bin_", F.ceil(F.col("m_") / block).cast("int").alias("parts")))), lambda x: x.isNotNull())
    plan = written(both.groupBy("label", "bin", "m").agg(known.alias("known"), open_.alias("open")).withColumn("key", F.xxhash64("label", "bin")), "plan")
    rows = by_weight(placed.withColumn("key", F.xxhash64("label", "bin")).drop("label", "bin"), plan, "key", "m")
    certain = rows.select("class", (F.col("known") - F.when(F.col("bin") * 2 + 2 < bins, F.col("n")).otherwise(0)).alias("near"))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("m") / block).cast("int")).cast("int")
    meet = F.flatten(F.transform("open", lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda p: F.struct(o["bin_"].alias("bin_"), p.alias("part_")))))
    here, there = F.struct("bin", "part"), F.struct("bin_", "part_")
    dealt = rows.withColumn("part", part).select("label", "class", "n", "code", "bin", "part", F.explode(meet).alias("x")).select("label", "class", "n", "code", "bin", "part", "x.*")
    dealt = dealt.select("label", "class", "n", "code", F.least(here, F.struct(F.col("bin_").alias("bin"), F.col("part_").alias("part"))).alias("p"), F.greatest(here, F.struct(F.col("bin_").alias("bin"), F.col("part_").alias("part"))).alias("q"), (here <= there).alias("left"))

    def products(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        ids, n = found["class"].to_numpy(), found["n"].to_numpy()
        x = units(vectors_of(found["code"].to_pylist()))
        if key[1].as_py() == key[2].as_py():
            near = linked(x, x, threshold) @ n - n
        else:
            left = np.asarray(found["left"].to_pylist(), bool)
            l, r = np.flatnonzero(left), np.flatnonzero(~left)
            links = linked(x[l], x[r], threshold)
            near = np.zeros(len(ids), np.int64)
            near[l], near[r] = links @ n[r], links.T @ n[l]
        return pa.table({"class": ids, "near": near.astype(np.int64)})

    compared = dealt.groupBy("label", "p", "q").applyInArrow(products, "class long, near long")
    return out.unionByName(certain).unionByName(compared).groupBy("class").agg(F.sum("near").alias("near"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, block: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept, by cosine in double precision of at least ``threshold``.

    ``n_links`` counts the other rows that link with the row, copies of it included,
    ``component_id`` is the smallest key it can reach by links, ``kept`` says whether that is
    its own.  A link is found if its vectors meet in a bucket (see the module's head) or are in
    one component by other links.  Vectors that are null, empty or zero, hold null or
    non-finite components or have no key link with nothing, nor do vectors of different
    lengths: n_links 0, their own key, kept.  Rows that repeat a key are vectors of their own.
    Other columns are not read; no rows give no rows.  Keys must be whole numbers.
    """
    rows = written(coded(vectors, key, column), "coded")
    classes = classes_of(rows.filter("code is not null"))
    edges = near_edges(classes, threshold, recall, block)
    labels = components(edges)
    forget(edges)
    near = link_counts(classes, labels, threshold, block)
    joined = classes.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("class", "code", "n", "least", F.coalesce("label", "class").alias("label"))
    joined = written(joined.join(near, "class", "left"), "found")
    low = joined.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    done = written(by_weight(joined, written(low, "components"), "label", "m").select("code", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id"), "done")
    out = by_weight(rows.filter("code is not null"), done, "code", "n").select("vec_id", "n_links", "component_id")
    alone = rows.filter("code is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair, in double precision; n_links and components by recursion over links.
SQL = {
    "op12_embedding_dedup": """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), fit AS (
  SELECT * FROM rows_ WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(r, met) AS (
  SELECT r, r FROM fit UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.met
), lowest AS (
  SELECT reach.r, min(f.vec_id) AS component_id FROM reach JOIN fit f ON f.r = reach.met GROUP BY reach.r
), counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(l.component_id, x.vec_id) AS component_id,
       x.vec_id IS NOT DISTINCT FROM coalesce(l.component_id, x.vec_id) AS kept
FROM rows_ x LEFT JOIN counts c ON c.r = x.r LEFT JOIN lowest l ON l.r = x.r
"""
}
