"""WARC archives with deduplicated payloads and boundary-chain verified reading (operator 9).

Archives are read in splits of Spark's size, whatever a file's size.  The text reader cuts
them at every version string; as its first letter stands nowhere else in it, every split sees
the same cuts.  Each cut is a candidate for a record's start, those in payloads included.  A
task reads the candidates' headers, emits (candidate, successor)
offsets and jumps within its split; pointer jumping by joins then goes from split to split,
from each file's start.  Only what is reachable is a record.  A second scan hashes the records'
payloads; pieces of records that cross splits are brought together.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import forget, local_rows, new_path, sized, table, written

VERSION = b"WARC/1.1"
_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_NO_PAGE = "urn:uuid:ffffffff-ffff-8fff-bfff-ffffffffffff"


def _record_id(page: Column) -> Column:
    """A version-8 UUID that carries the page id's 64 bits, so the reader gets the id back; one of its own kind for null."""
    h = F.lpad(F.lower(F.hex(page)), 16, "0")
    known = F.concat(F.lit("urn:uuid:00000000-000"), F.substring(h, 1, 1), F.lit("-8"), F.substring(h, 2, 3), F.lit("-8"), F.substring(h, 5, 3), F.lit("-"), F.lpad(F.substring(h, 8, 9), 12, "0"))
    return F.coalesce(known, F.lit(_NO_PAGE))


def page_of(record_id: str) -> int | None:
    """The page id in a record id that ``_record_id`` made."""
    if record_id == _NO_PAGE:
        return None
    p = record_id.rsplit(":", 1)[1].split("-")
    n = int(p[1][3] + p[2][1:] + p[3][1:] + p[4][3:], 16)
    return n - (1 << 64) if n >> 63 else n


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> None:
    """One record per row in uncompressed WARC 1.1 files under ``path``.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest page id
    is a response and the others are revisits that name it and hold no payload; shorter
    payloads are all responses.  Null html is an empty payload; a null url is left out, and
    white space and control characters in one are percent-encoded.  A row with a null page id is
    a response that nothing refers to.  Rows that repeat a page id and a payload are one
    response and revisits of it.  No rows give no records.

    Only (page id, digest) of repeated payloads is joined to the pages; that table is written
    and counted first, and sent to the pages only where it is small.
    """
    own = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    known = own.select("page", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    narrow = written(known.filter((F.col("size") >= least) & F.col("page").isNotNull()).select("page", F.unhex("digest").alias("digest")), "digests")
    first = narrow.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # a page id whose payload repeats, with the response of that payload and how often it has it itself
    again = written(
        narrow.join(first, "digest").groupBy("page", "digest", "first").agg(F.count("*").alias("times")).filter("page <> first or times > 1").select(F.col("page").alias("p"), F.col("digest").alias("d"), "first", "times"),
        "repeats",
    )
    forget(narrow)
    rows = own.withColumn("sha", F.sha2("html", 256)).join(sized(again), (F.col("page") == F.col("p")) & (F.unhex("sha") == F.col("d")), "left")
    # rows that repeat the response's own page id: all but one are revisits; they are few per id
    single = rows.filter("first is null or page <> first").withColumn("back", F.col("first"))
    nth = F.row_number().over(Window.partitionBy("page", "sha").orderBy(F.col("url").asc_nulls_first()))
    same = rows.filter("first = page").withColumn("nth", nth).withColumn("back", F.when(F.col("nth") > 1, F.col("first"))).drop("nth")
    rows = single.unionByName(same)

    payload = F.when(F.col("back").isNull(), F.col("html")).otherwise("")
    length = F.lit(len(_HTTP)) + F.octet_length(payload)
    clean = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("back").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page")), F.lit(">"))),
        line("WARC-Date", F.lit(_DATE)),
        F.when(clean.isNull(), "").otherwise(line("WARC-Target-URI", clean)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        F.when(F.col("back").isNull(), "").otherwise(
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("back")), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                # an extension field: the length of the payload that is not repeated here
                line("Payload-Length", F.octet_length("html").cast("string")),
            )
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + _HTTP),
        payload,
    )
    # the text writer ends each value with lineSep, which is how WARC ends a record
    rows.select(record.alias("value")).write.option("lineSep", _END.decode()).text(path)
    forget(again)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.IGNORECASE)


def successor(row: bytes) -> int:
    """Length of the record that begins with ``row`` by its header, its end included; -1 where there is no header."""
    stop = row.find(_END)
    m = _LENGTH.search(row, 0, stop + 2) if row.startswith(VERSION + b"\r\n") and stop >= 0 else None
    return stop + 4 + int(m[1]) + 4 if m else -1


def exits(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chain from each candidate leaves a split, and its last candidate there, by pointer jumping.

    Every candidate points to the one at its successor offset; pointers of length 1, 2, 4, ...
    are composed, so the number of rounds is the logarithm of the number of records.  -1 where
    a chain breaks: at a candidate without a header, or at an offset inside the split where no
    candidate is.
    """
    n = len(starts)
    at = np.searchsorted(starts, ends)
    jump = np.where((at < n) & (starts[np.minimum(at, n - 1)] == ends), at, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    out = ends[jump]
    return np.where(out > starts[-1], out, -1), starts[jump]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", VERSION.decode()).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _rows(batches):
    """(file, its size, block, offset in the block, bytes, whether they end the block) of each cut, in the order of the file.

    The bytes begin with the version string, but for a file's first, which are empty in an
    archive, so they follow each other without a gap.
    """
    here, at, held, first = None, 0, None, True
    for b in batches:
        for file, size, block, value in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
            if held is not None:
                yield *here, *held, here != (file, size, block)
                held = None
            if here != (file, size, block):
                here, at, first = (file, size, block), 0, True
            row = value.as_py()
            if first and block == 0:
                first = False
                if not row:
                    continue
            else:
                row = VERSION + row
            held = (at, row)
            at += len(row)
    if held is not None:
        yield *here, *held, True


_CANDIDATES = "file string, size long, block long, at long, last long, exit long, total long"


def candidates(lines: DataFrame) -> DataFrame:
    """(file, its size, block, at, last, exit, total): each candidate's offset in its block, the last candidate on its chain there and where the chain goes on.

    Offsets count from the block's first cut.  ``total`` is the bytes of a block's cuts, in
    the row of the last of them.
    """

    def run(batches):
        starts, ends = [], []
        for file, size, block, at, row, done in _rows(batches):
            length = successor(row)
            starts.append(at)
            ends.append(at + length if length >= 0 else -1)
            if done:
                n, (out, last) = len(starts), exits(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
                columns = [[file] * n, [size] * n, [block] * n, starts, last, out, [None] * (n - 1) + [at + len(row)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["file", "size", "block", "at", "last", "exit", "total"])
                starts, ends = [], []

    return lines.mapInArrow(run, _CANDIDATES)


def reachable(found: DataFrame) -> dict[str, dict[int, tuple[int, int, int, int]]]:
    """By file and block: (offset of its first cut, first record that begins in it, the record that goes on into it, where that ends); -1 for none.

    ``found`` is a written table of candidates.  Marks spread from offset 0 of each file along
    pointers from block to block, which are composed with themselves each round, so rounds are
    the logarithm of a file's blocks.  The driver gets one row a block, as many as there are
    splits of the scan.  Raises if the blocks don't make up a file, or a file's chain does not
    end where the file does.
    """
    spark = found.sparkSession
    sizes: dict[str, int] = {}
    begin: dict[str, dict[int, int]] = {}
    for r in sorted(found.filter("total is not null").select("file", "size", "block", "total").collect(), key=lambda r: (r.file, r.block)):
        at = begin.setdefault(r.file, {})
        at[r.block] = sizes.get(r.file, 0)
        sizes[r.file] = at[r.block] + r.total
        at[-1] = r.size
    for file, at in begin.items():
        if sizes[file] != at.pop(-1):
            raise ValueError(f"the splits of {file} do not make it up")
    if not begin:
        return {}
    # files go by number from here on; pointers are joined by sorting, never sent to all tasks
    number = {file: k for k, file in enumerate(begin)}
    known = [(f, b, x) for f, at in begin.items() for b, x in at.items()]
    offsets = local_rows(spark, {"file": ("string", [f for f, _, _ in known]), "block": ("long", [b for _, b, _ in known]), "f": ("int", [number[f] for f, _, _ in known]), "x": ("long", [x for _, _, x in known])})
    whole = found.join(F.broadcast(offsets), ["file", "block"]).select("f", (F.col("x") + F.col("at")).alias("at"), (F.col("x") + F.col("last")).alias("last"), F.when(F.col("exit") >= 0, F.col("x") + F.col("exit")).alias("exit"))
    pointers = written(whole, "pointers")
    whole = pointers.hint("merge")
    jump, marks = whole.select("f", "at", "exit").filter("exit is not null"), whole.filter("at = 0").select("f", "at")
    temporary = []
    while True:
        nxt = jump.toDF("f", "exit", "further")
        ahead = marks.hint("merge").join(jump.hint("merge"), ["f", "at"]).select("f", F.col("exit").alias("at"))
        marks = written(marks.union(ahead).join(whole.select("f", "at"), ["f", "at"], "left_semi").distinct(), "marks")
        jump = written(jump.hint("merge").join(nxt.hint("merge"), ["f", "exit"]).select("f", "at", F.col("further").alias("exit")), "jump")
        temporary += [marks, jump]
        if not jump.limit(1).count():
            break
    chain: dict[str, list[tuple[int, int, int]]] = {}
    names = list(begin)
    for r in whole.join(marks.hint("merge"), ["f", "at"], "left_semi").collect():
        chain.setdefault(names[r.f], []).append((r.at, r.last, -1 if r.exit is None else r.exit))
    forget(pointers, *temporary)
    out: dict[str, dict[int, tuple[int, int, int, int]]] = {}
    for file, at in begin.items():
        steps = sorted(chain.get(file, []))
        if not steps or steps[-1][2] != sizes[file]:
            raise ValueError(f"the chain of records of {file} breaks at {steps[-1][2] if steps else 0} of {sizes[file]}")
        blocks, mine = sorted((x, b) for b, x in at.items()), out.setdefault(file, {})
        k, owner, until = 0, -1, -1
        for (x, b), (stop, _) in zip(blocks, [*blocks[1:], (sizes[file], 0)]):
            entry = steps[k][0] if k < len(steps) and steps[k][0] < stop else -1
            mine[b] = (x, entry, owner if until > x else -1, until)
            if entry >= 0:
                owner, until = steps[k][1], steps[k][2]
                k += 1
    return out


def _parsed(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload), the payload checked against its digest."""
    split = record.index(_END)
    head = {}
    for row in record[:split].decode("utf-8").split("\r\n")[1:]:
        name, _, value = row.partition(":")
        head[name.lower()] = value.strip()
    block = memoryview(record)[split + 4 : -4]
    body = record.index(_END, split + 4) + 4 - (split + 4)
    digest, kind, back = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"], None
    if kind == "response":
        size = len(block) - body
        if hashlib.sha256(block[body:]).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    elif kind != "revisit":
        raise ValueError(f"{head['warc-record-id']} is of type {kind}, neither response nor revisit")
    else:
        size, back = int(head["payload-length"]), page_of(head["warc-refers-to"].strip("<>"))
    return page_of(head["warc-record-id"].strip("<>")), size, digest, kind, back, head.get("warc-target-uri"), bytes(block[body:]) if kind == "response" else None


_FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "file", "at", "offset", "piece")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())
_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string, at long, offset long, piece binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=list(_FIELDS))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record on the chain from each file's start: what is in its header, checked.

    A response's payload is hashed and held against its digest.  Files may be of any size: tasks
    hold one cut at a time and the record that it belongs to.  Headers may be of any length.
    ``with_payload`` adds the column ``payload`` (null for revisits).  An empty folder gives no
    rows; a file whose chain of records breaks raises.
    """
    lines = _scan(spark, path)
    found = written(candidates(lines), "candidates")
    plan = spark.sparkContext.broadcast(reachable(found))
    forget(found)

    def run(batches):
        out, held = [], 0
        here, at, end, parts, first = None, -1, -1, [], -1
        for file, _, block, offset, row, done in _rows(batches):
            if here != (file, block):
                here = (file, block)
                x, entry, owner, until = plan.value[file][block]
                # what stands before the first record belongs to the one that goes on into the block
                at, end = (owner, until) if owner >= 0 else (-1, entry)
            place = x + offset
            if place == end:
                at, end = place, place + successor(row)
            if not parts:
                first = place
            parts.append(row)
            if place + len(row) >= end or done:
                data = b"".join(parts)
                if first == at and first + len(data) >= end:
                    values = _parsed(data[: end - at])
                    out.append((*(values if with_payload else (*values[:6], None)), None, None, None, None))
                else:
                    out.append((*(None,) * 7, file, at, first, data[: end - first]))
                held += len(data)
                parts = []
            if len(out) >= 2000 or held > 4_000_000:
                yield from _table(out).to_batches()
                out, held = [], 0
        if out:
            yield from _table(out).to_batches()

    read = written(lines.mapInArrow(run, _FOUND), "records")

    def together(pieces: pa.Table) -> pa.Table:
        order = np.argsort(pieces["offset"].to_numpy())
        found = _parsed(b"".join(pieces["piece"][int(k)].as_py() for k in order))
        return _table([(*(found if with_payload else (*found[:6], None)), None, None, None, None)])

    joined = read.filter("piece is not null").groupBy("file", "at").applyInArrow(together, _FOUND)
    return read.filter("piece is null").unionByName(joined).select(*_FIELDS[: 7 if with_payload else 6])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS nth FROM q
      WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first END AS refers_to
FROM r
"""
}
