"""Content-addressed store of token ids (operator 3).

Layout under one folder:

* ``chunks``: each distinct chunk once: its digest and its ids, little-endian, two bytes
  each where all ids of the chunk are below 65,536, else four, compressed with zstd.
* ``recipes`` (kind doc): in ascending key order over shards and within one: key, place of the document
  in its shard's id stream, number of ids, digests of its chunks in order, Merkle root.
* ``recipes`` (kind shard), the manifest: per shard its documents, its ids and the Merkle root
  of its documents; the ids before a shard are the sum over the shards before it.
* ``recipes`` (kind store): the number of shards, documents and ids of the store and the
  Merkle root of its shards.

Reading holds chunks against their digests, documents against their chunks, shards against
their documents and the store against its shards, so whatever is lost, swapped or changed
raises an error.

Id streams are cut where a rolling hash of the last 16 ids is 0 modulo the target size, so
equal passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.bpe_automaton import automaton
from quillmark.llm.common import in_parts, keyed_text, local_rows, new_path, table, written

DIGEST = 20
LEAST, TARGET, MOST = 256, 1024, 4096
_ROLL = 16


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document in a stream of documents that end at ``ends``."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    with np.errstate(over="ignore"):
        factor, span = 0x94D049BB133111EB, 1
        while span < _ROLL:
            older = np.zeros_like(h)
            older[span:] = h[:-span]
            h = h + older * np.uint64(factor)
            factor, span = factor * factor & (1 << 64) - 1, span * 2
    marks = np.flatnonzero((h >> np.uint64(20)) % np.uint64(TARGET - LEAST) == 0) + 1
    out, low = [], 0
    for end in ends.tolist():
        cuts, at = [], low
        while end - at > LEAST:
            k = int(np.searchsorted(marks, at + LEAST))
            cut = min(int(marks[k]) if k < len(marks) else end, at + MOST, end)
            if cut == end:
                break
            cuts.append(cut)
            at = cut
        cuts.append(end)
        out.append(cuts)
        low = end
    return out


def _packed(ids: np.ndarray, compressor) -> bytes:
    small = int(ids.max(initial=0)) < 65536
    return (b"2" if small else b"4") + compressor.compress(ids.astype("<u2" if small else "<u4").tobytes())


def _unpacked(data: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(data[1:]), "<u2" if data[:1] == b"2" else "<u4").astype("<u4")


def _digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; a level's odd last node moves up as it is."""
    level = leaves or [b"\0" * DIGEST]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


class MerkleStream:
    """The same root from leaves that come one by one, in memory of their number's logarithm."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.stack and self.stack[-1][0] == height:
            leaf = hashlib.blake2b(b"\1" + self.stack.pop()[1] + leaf, digest_size=DIGEST).digest()
            height += 1
        self.stack.append((height, leaf))

    def root(self) -> bytes:
        if not self.stack:
            return b"\0" * DIGEST
        node = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            node = hashlib.blake2b(b"\1" + left + node, digest_size=DIGEST).digest()
        return node


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Writes every row's ids (null text: only the end id) to ``path``.

    Tasks drop chunks they have already sent on, one exchange by digest drops the others'
    copies, so ids are shuffled once and compressed.  Repeated keys are separate documents,
    next to each other; null keys come first.
    """

    def chunks(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        machine = automaton(tokenizer, False)
        sent: set[bytes] = set()
        for part, texts in in_parts(batches, tokenizes=True):
            keys, row = part.column(0).to_pylist(), 0
            for ids, sizes in machine.encode(texts):
                ends = np.cumsum(sizes + 1)
                stream = np.insert(ids, np.cumsum(sizes), end_id)
                out: list[tuple] = []
                low = 0
                for cuts in cut_points(stream, ends):
                    begin, names = low, []
                    for cut in cuts:
                        name = _digest(stream[low:cut])
                        names.append(name)
                        if name not in sent:
                            if len(sent) < 500_000:
                                sent.add(name)
                            out.append(("chunk", name, _packed(stream[low:cut], compressor), None, None))
                        low = cut
                    out.append(("recipe", None, b"".join(names), keys[row], low - begin))
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                    names=["kind", "digest", "data", "doc_id", "n_tokens"],
                )

    def first_of_each(batches):
        # sorted by digest, so copies follow each other
        last = None
        for b in batches:
            keep = []
            for k, name in enumerate(b.column(1).to_pylist()):
                if name is None or name != last:
                    keep.append(k)
                last = name
            yield b.take(pa.array(keep, pa.int64()))

    schema = "kind string, digest binary, data binary, doc_id long, n_tokens long"
    sent = keyed_text(docs, key, text).mapInArrow(chunks, schema)
    dealt = sent.repartition(F.coalesce(F.col("digest"), F.unhex(F.hex(F.xxhash64("doc_id", "data")))))
    dealt.sortWithinPartitions("digest").mapInArrow(first_of_each, schema).write.partitionBy("kind").parquet(f"{path}/chunks")
    _write_recipes(docs.sparkSession, path)


def _leaf(key: int | None, start: int, size: int, root: bytes) -> bytes:
    """What a document is in its shard's tree: its key, place and length as well as its chunks."""
    return hashlib.blake2b(b"\0" + repr((key, start, size)).encode() + root, digest_size=DIGEST).digest()


def _store_root(shards: list[tuple[int, int, int, bytes]]) -> bytes:
    """Merkle root over (shard, documents, ids, root) in order."""
    return merkle_root([_leaf(*s) for s in shards])


def _shards(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    rows = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("kind = 'shard'").select("shard", "doc_id", "n_tokens", "root").orderBy("shard", "doc_id").collect()
    return [(r.shard, r.doc_id, r.n_tokens, bytes(r.root)) for r in rows]


def _write_recipes(spark: SparkSession, path: str) -> None:
    def shard(batches):
        from pyspark import TaskContext

        number, tree, at, n = TaskContext.get().partitionId(), MerkleStream(), 0, 0
        for b in batches:
            keys, sizes, lists = (b.column(k).to_pylist() for k in range(3))
            starts, roots = [], []
            for key, size, names in zip(keys, sizes, lists):
                roots.append(merkle_root([names[i : i + DIGEST] for i in range(0, len(names), DIGEST)]))
                tree.add(_leaf(key, at, size, roots[-1]))
                starts.append(at)
                at += size
                n += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * len(keys)), pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.binary()), pa.array(roots, pa.binary())],
                names=_SHARD,
            )
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(("shard", number, n, 0, at, b"", tree.root()), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=_SHARD)

    recipes = spark.read.schema("digest binary, data binary, doc_id long, n_tokens long, kind string").parquet(f"{path}/chunks").filter("kind = 'recipe'")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = recipes.select("doc_id", "n_tokens", "data").repartitionByRange(parts, "doc_id", "n_tokens", "data").sortWithinPartitions("doc_id", "n_tokens", "data")
    in_order.mapInArrow(shard, "kind string, shard int, doc_id long, start long, n_tokens long, data binary, root binary").write.partitionBy("kind").parquet(f"{path}/recipes")
    shards = _shards(spark, path)
    total = {
        "kind": ("string", ["store"]), "shard": ("int", [len(shards)]), "doc_id": ("long", [sum(s[1] for s in shards)]), "start": ("long", [0]),
        "n_tokens": ("long", [sum(s[2] for s in shards)]), "data": ("binary", [b""]), "root": ("binary", [_store_root(shards)]),
    }
    local_rows(spark, total).coalesce(1).write.mode("append").partitionBy("kind").parquet(f"{path}/recipes")


_SHARD = ["kind", "shard", "doc_id", "start", "n_tokens", "data", "root"]
_RECIPES = "shard int, doc_id long, start long, n_tokens long, data binary, root binary, kind string"


def verified_shards(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(shard, ids in the shards before it), after the store was held against its manifest; as many entries as the recipes have partitions.

    The documents' recipes are read in order, shard by shard, for their number, their places
    and the shard's Merkle root; these must be the manifest's, and its shards those of the store.
    """
    shards = _shards(spark, path)
    whole = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("kind = 'store'").collect()
    if [(r.shard, r.doc_id, r.n_tokens, bytes(r.root)) for r in whole] != [(len(shards), sum(s[1] for s in shards), sum(s[2] for s in shards), _store_root(shards))]:
        raise ValueError("the store's shards are not those of its manifest")

    def recount(batches):
        shard, tree, n, at, gap = None, MerkleStream(), 0, 0, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, n, at, b"" if gap else tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "n", "ids", "root"])

        for b in batches:
            for one, key, start, size, root in zip(*(b.column(k).to_pylist() for k in range(5))):
                if one != shard:
                    if shard is not None:
                        yield row()
                    shard, tree, n, at, gap = one, MerkleStream(), 0, 0, False
                tree.add(_leaf(key, start, size, root))
                gap |= start != at
                n, at = n + 1, at + size
        if shard is not None:
            yield row()

    docs = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("kind = 'doc'").select("shard", "doc_id", "start", "n_tokens", "root")
    found = docs.repartition("shard").sortWithinPartitions("shard", "start").mapInArrow(recount, "shard int, n long, ids long, root binary").collect()
    if sorted((r.shard, r.n, r.ids, bytes(r.root)) for r in found) != shards:
        raise ValueError("the documents of a shard are not those of its manifest row")
    out, at = [], 0
    for shard, _, ids, _ in shards:
        out.append((shard, at))
        at += ids
    return out


def _offsets_table(spark: SparkSession, path: str) -> DataFrame:
    known = verified_shards(spark, path)
    return local_rows(spark, {"shard": ("int", [k for k, _ in known]), "before": ("long", [n for _, n in known])})


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(32):
        out ^= np.where((v >> np.uint32(k)) & np.uint32(1), matrix[k], np.uint32(0)).astype(np.uint32)
    return out


def _zero_operators(bits: int) -> list[np.ndarray]:
    """Operator k moves a CRC-32 register over 2**k zero bytes; column j is the image of bit j."""
    one = np.array([0xEDB88320] + [1 << (j - 1) for j in range(1, 32)], np.uint32)
    for _ in range(3):
        one = _times(one, one)
    out = [one]
    while len(out) < bits:
        out.append(_times(out[-1], out[-1]))
    return out


def joined_crcs(lists: list[list[tuple[int, int]]]) -> np.ndarray:
    """CRC-32 of each concatenation, from (bytes, CRC-32) of its parts."""
    operators = _zero_operators(40)
    out = np.zeros(len(lists), np.uint32)
    for at in range(max(map(len, lists), default=0)):
        rows = np.flatnonzero([len(x) > at for x in lists])
        size = np.array([lists[r][at][0] for r in rows], np.int64)
        moved = out[rows]
        for k, op in enumerate(operators):
            hit = (size >> k) & 1 == 1
            if hit.any():
                moved[hit] = _times(op, moved[hit])
        out[rows] = moved ^ np.array([lists[r][at][1] for r in rows], np.uint32)
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Per stored chunk, read and checked against its digest: digest, number of ids, CRC-32 of them."""

    def run(batches):
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        for b in batches:
            names, sizes, crcs = b.column(0).to_pylist(), [], []
            for name, data in zip(names, b.column(1).to_pylist()):
                ids = _unpacked(data, decompressor)
                if _digest(ids) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its digest says")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    stored = spark.read.schema("digest binary, data binary, doc_id long, n_tokens long, kind string").parquet(f"{path}/chunks").filter("kind = 'chunk'")
    return stored.select("digest", "data").mapInArrow(run, "digest binary, n long, crc long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, rebuilt from the files: doc_id, start, n_tokens, ids_crc32, n_chunks.

    Every chunk is read and held against its digest once; a document's checksum is composed
    from its chunks' checksums, so ids are not shuffled.  A recipe whose Merkle root or number
    of ids differs from what its chunks give raises an error, as does a missing chunk; the
    manifest is checked first (``verified_shards``).
    """
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("kind = 'doc'")
    first = _offsets_table(spark, path)
    parts = recipes.select(
        "shard", F.col("start").alias("at"), F.expr(f"posexplode(transform(sequence(1, length(data), {DIGEST}), i -> substring(data, i, {DIGEST})))").alias("pos", "digest")
    )
    found = written(read_chunks(spark, path), "chunks")
    lists = (
        parts.join(found, "digest", "left")
        .groupBy("shard", "at")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("parts"))
    )

    def compose(batches):
        for b in batches:
            rows = b.column(b.schema.get_field_index("parts")).to_pylist()
            roots, sizes = b.column(b.schema.get_field_index("root")).to_pylist(), b.column(b.schema.get_field_index("n_tokens")).to_pylist()
            for row, root, size in zip(rows, roots, sizes):
                if any(x["n"] is None for x in row) or sum(x["n"] for x in row) != size or merkle_root([x["digest"] for x in row]) != root:
                    raise ValueError("a recipe does not match the stored chunks")
            crc = joined_crcs([[(4 * x["n"], x["crc"]) for x in row] for row in rows])
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("start")), b.column(b.schema.get_field_index("n_tokens")), pa.array(crc.astype(np.int64)), pa.array([len(r) for r in rows], pa.int32())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"],
            )

    rows = recipes.select("shard", F.col("start").alias("at"), "doc_id", "n_tokens", "root").join(lists, ["shard", "at"]).join(first, "shard")
    return rows.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "root", "parts").mapInArrow(compose, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start and the array ``ids``, rebuilt from its chunks."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").filter("kind = 'doc'")
    stored = spark.read.schema("digest binary, data binary, doc_id long, n_tokens long, kind string").parquet(f"{path}/chunks").filter("kind = 'chunk'").select("digest", "data")
    first = _offsets_table(spark, path)
    parts = recipes.select("shard", "doc_id", F.col("start").alias("at"), F.expr(f"posexplode(transform(sequence(1, length(data), {DIGEST}), i -> substring(data, i, {DIGEST})))").alias("pos", "digest"))
    lists = parts.join(stored, "digest").join(first, "shard").groupBy("doc_id", (F.col("at") + F.col("before")).alias("start")).agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"))

    def join(batches):
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        for b in batches:
            ids = [np.concatenate([_unpacked(x["data"], decompressor) for x in row]).tolist() for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return lists.mapInArrow(join, "doc_id long, start long, ids array<long>")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")
