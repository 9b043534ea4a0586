"""Conversation structure repair (operator 13): weighted finite-state composition.

Three machines are composed: an acceptor of the conversation's rows, one state a row; a
transducer of edits (keep, rerole, delete, insert); and an acceptor of the roles' grammar.  A
state of the composition is (row, inserts made before it, grammar state).  States are made
when they are met; what follows a row depends only on the row's symbol and on the costs behind it,
so a step is computed once for each such pair and looked up from then on.

Weights are (cost, string of labels), compared in this order.  Strings are extended at the
front, from the last row to the first, as an order of strings holds when the same label is put before
both but not when it is put behind.  The states are topologically ordered (rows, then inserts), so
one pass gives the cheapest path.  The grammar allows one role in each state that an insert
or rerole gives, so paths that differ leave a common state by different labels, and of equal
costs the first label decides.

Rows are sorted by conversation and turn over all tasks, so a conversation may span many of
them.  It is cut into pieces of at most ``PIECE`` rows; of a conversation in several
pieces, the costs of crossing each piece compose as matrices, and a scan of these gives every piece the
costs behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import forget, small_batches, table, written

PIECE = 4096
FAR = 1 << 60

#: The grammar (s?(ua)+)?: from each state, the initial that may follow and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Two inserts in a row lead from any state to any that an insert can reach; a third would only go back.
INSERTS = 2

#: Symbols of the input: initial of the role (o: any other) and fault (b: blank or duplicate, t: truncated, k: none).
SYMBOLS = {a + b: chr(65 + 3 * i + j) for i, a in enumerate("suao") for j, b in enumerate("btk")}
MEANING = {v: k for k, v in SYMBOLS.items()}


def edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, str, int]]:
    """(label, cost, role that comes out, grammar state behind) of the edits that take a row."""
    yield DELETE, COST[DELETE], "", state
    if fault == "b":
        return
    extra = int(fault == "t")
    if initial in GRAMMAR[state]:
        yield KEEP, COST[KEEP] + extra, initial, GRAMMAR[state][initial]
    for role in ROLES:
        if role in GRAMMAR[state] and role != initial:
            yield REROLE, COST[REROLE] + extra, role, GRAMMAR[state][role]


def inserts(state: int) -> Iterator[tuple[str, int, str, int]]:
    for role in ROLES:
        if role in GRAMMAR[state]:
            yield INSERT, COST[INSERT], role, GRAMMAR[state][role]


@lru_cache(maxsize=1 << 16)
def step(symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, str, int] | None, ...]]:
    """One row of the composition: (cost from each grammar state before it, (labels, roles, state behind) of each).

    An empty symbol is the end, where only inserts are left.  Roles are those inserted, then the
    row's own outcome: an initial, or ``-`` where it is deleted.
    """
    layers: list[dict] = [{} for _ in range(INSERTS + 2)]
    for done in range(INSERTS, -1, -1):
        for state in GRAMMAR:
            found = []
            if symbol:
                for label, cost, role, to in edits(*MEANING[symbol], state):
                    if behind[to] < FAR:
                        found.append((cost + behind[to], label, label, role or "-", to))
            elif behind[state] < FAR:
                found.append((behind[state], "", "", "", state))
            if done < INSERTS:
                for label, cost, role, to in inserts(state):
                    if (then := layers[done + 1].get(to)) is not None:
                        found.append((cost + then[0], label, label + then[2], role + then[3], then[4]))
            if found:
                layers[done][state] = min(found, key=lambda x: x[:2])
    best = [layers[0].get(state) for state in GRAMMAR]
    return tuple(FAR if x is None else x[0] for x in best), tuple(None if x is None else x[2:] for x in best)


def relative(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """(least, each cost above it): few such tuples exist, whatever a conversation's length."""
    least = min(costs)
    return (0, costs) if least >= FAR else (least, tuple(FAR if c >= FAR else c - least for c in costs))


#: Costs behind the last row: those of the inserts that lead to a final state, and these.
END = tuple(0 if state in FINAL else FAR for state in GRAMMAR)
CLOSING, TAIL = step("", END)


def costs_before(symbols: str, behind: tuple[int, ...]) -> tuple[int, ...]:
    total = 0
    for symbol in reversed(symbols):
        more, behind = relative(behind)
        total += more
        behind = step(symbol, behind)[0]
    return tuple(FAR if c >= FAR else c + total for c in behind)


def crossing(symbols: str) -> list[int]:
    """Cost of going through the rows from state i to state j, at 4 * i + j."""
    columns = [costs_before(symbols, tuple(0 if k == j else FAR for k in GRAMMAR)) for j in GRAMMAR]
    return [columns[j][i] for i in GRAMMAR for j in GRAMMAR]


def paths(symbols: str, behind: tuple[int, ...], starts: tuple[int, ...]) -> list[tuple[str, list[str], int] | None]:
    """For each state of ``starts``: (labels, roles of each row, state behind the rows) of the cheapest path, None where there is none."""
    ways = []
    for symbol in reversed(symbols):
        behind, way = step(symbol, relative(behind)[1])
        ways.append(way)
    ways.reverse()
    out: list[tuple[str, list[str], int] | None] = []
    for state in starts:
        labels, roles = [], []
        for way in ways:
            if way[state] is None:
                break
            label, role, state = way[state]
            labels.append(label)
            roles.append(role)
        out.append(("".join(labels), roles, state) if len(labels) == len(symbols) else None)
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by the CRC-32 of ``conv_id:turn``; a null is one space there and in role and text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), kind.alias("kind"))
    out = out.filter("kind <> 0").withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The damaged rows with ``pos``, which ascends by conversation, turn (nulls first), role and text."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(dealt.withColumn("pos", F.monotonically_increasing_id()), "rows")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, symbol, blank, duplicate, truncated): each row's first fault."""
    solid = F.translate("text", "\t\n\x0b\x0c\r ", "")
    same = F.unhex(F.md5(F.concat_ws(":", F.md5("role"), F.md5("text"))))
    first = rows.groupBy("conv_id", same.alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    short = rows.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), (F.length(solid) == 0).alias("blank"), F.substring(solid, -1, 1).isin(".", "!", "?").alias("ended"))
    one = short.join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    one = one.withColumn("fault", fault)
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "b").when(F.col("fault") == "truncated", "t").otherwise("k")
    return one.select("conv_id", "turn", "pos", F.concat(initial, kind).alias("symbol"), "fault")


_PIECE = "conv_id long, pos long, symbols string, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long"


def pieces_of(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows of a conversation that stand next to one another, at most ``piece`` in a piece, as one string of symbols with counts."""

    def gather(found: pa.Table) -> pa.Table:
        found = found.sort_by("pos")
        conv, turn, pos = found["conv_id"].to_pylist(), found["turn"].to_pylist(), found["pos"].to_pylist()
        symbol, fault = found["symbol"].to_pylist(), found["fault"].to_pylist()
        out, f = [], 0
        while f < len(conv):
            e = f + 1
            while e < len(conv) and conv[e] == conv[f]:
                e += 1
            turns = [t for t in turn[f:e] if t is not None]  # ascending
            out.append(
                (
                    conv[f], pos[f], "".join(SYMBOLS[s] for s in symbol[f:e]), *(fault[f:e].count(x) for x in ("blank", "duplicate", "truncated")),
                    sum(not legal(symbol[i - 1][0], symbol[i][0]) for i in range(f + 1, e)), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
                )
            )
            f = e
        kinds = (pa.int64(), pa.int64(), pa.string(), *(pa.int64(),) * 9)
        return pa.table({name.split()[0]: pa.array(c, t) for name, c, t in zip(_PIECE.split(", "), zip(*out), kinds)})

    return rows.withColumn("at", F.floor(F.col("pos") / piece)).groupBy("at").applyInArrow(gather, _PIECE)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation, of input sorted by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def _answer(parts: list[dict], cost: int, audit: str) -> tuple:
    """The counts of all pieces of a conversation, in order."""
    turned = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    illegal = sum(p["illegal"] for p in parts) + sum(not legal(MEANING[a["symbols"][-1]][0], MEANING[b["symbols"][0]][0]) for a, b in zip(parts, parts[1:]))
    gaps = turned[-1]["high"] - turned[0]["low"] + 1 - turns if turned else 0
    return (parts[0]["conv_id"], gaps, *(sum(p[x] for p in parts) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit)


_DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<struct<pos:long,roles:array<string>>>, tail string"
_DONE_KINDS = (*(pa.int64(),) * 7, pa.string(), pa.list_(pa.struct([("pos", pa.int64()), ("roles", pa.list_(pa.string()))])), pa.string())


def _batch(rows: list[tuple], schema: str, kinds) -> pa.RecordBatch:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "tail"] if schema == _DONE else [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def solved(pieces: DataFrame) -> DataFrame:
    """Cheapest edits of each conversation, with the roles that come out of its rows by piece."""
    number = pieces.groupBy(F.col("conv_id").alias("own")).agg(F.count("*").alias("n"))
    counted = written(pieces.join(number, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own"), "pieces")

    def short(batches):
        out = []
        for parts in _by_conversation(batches):
            symbols = parts[0]["symbols"]
            cost = costs_before(symbols, CLOSING)[START]
            labels, roles, state = paths(symbols, CLOSING, (START,))[0]
            out.append((*_answer(parts, cost, labels + TAIL[state][0]), [{"pos": parts[0]["pos"], "roles": roles}], TAIL[state][1]))
            if len(out) == 1024:
                yield _batch(out, _DONE, _DONE_KINDS)
                out = []
        if out:
            yield _batch(out, _DONE, _DONE_KINDS)

    whole = counted.filter("n = 1").drop("n").mapInArrow(short, _DONE)
    cut = counted.filter("n > 1").drop("n")
    if cut.isEmpty():
        return whole

    def cross(batches):
        for b in batches:
            rows = [(r["conv_id"], r["pos"], crossing(r["symbols"])) for r in b.to_pylist()]
            if rows:
                yield _batch(rows, "conv_id long, pos long, cross array<long>", (pa.int64(), pa.int64(), pa.list_(pa.int64())))

    def scan(batches):
        for parts in _by_conversation(batches):
            behind, rows = CLOSING, []
            for p in reversed(parts):
                rows.append((p["conv_id"], p["pos"], list(behind)))
                behind = tuple(min(FAR, min(p["cross"][4 * i + j] + behind[j] for j in GRAMMAR)) for i in GRAMMAR)
            yield _batch(rows, "conv_id long, pos long, behind array<long>", (pa.int64(), pa.int64(), pa.list_(pa.int64())))

    def walk(batches):
        for b in batches:
            for r in b.to_pylist():
                behind = tuple(r["behind"])
                found = paths(r["symbols"], behind, tuple(GRAMMAR))
                cost = costs_before(r["symbols"], behind)[START]
                r |= {"cost": cost, "ways": [None if x is None else {"audit": x[0], "roles": x[1], "state": x[2]} for x in found]}
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in walked}], schema=pa.schema(list(walked.items())))

    walked = {x.split()[0]: pa.string() if x.split()[1] == "string" else pa.int64() for x in _PIECE.split(", ")}
    walked |= {"cost": pa.int64(), "ways": pa.list_(pa.struct([("audit", pa.string()), ("roles", pa.list_(pa.string())), ("state", pa.int64())]))}

    def chain(batches):
        for parts in _by_conversation(batches):
            state, audit, roles = START, [], []
            for p in parts:
                way = p["ways"][state]
                audit.append(way["audit"])
                roles.append({"pos": p["pos"], "roles": way["roles"]})
                state = way["state"]
            yield _batch([(*_answer(parts, parts[0]["cost"], "".join(audit) + TAIL[state][0]), roles, TAIL[state][1])], _DONE, _DONE_KINDS)

    # the pieces of long conversations are spread over tasks; a scan holds 16 numbers a piece
    spread = written(cut.repartition("pos"), "cut")
    crossed = _sorted(spread.select("conv_id", "pos", "symbols").mapInArrow(cross, "conv_id long, pos long, cross array<long>"))
    behind = crossed.mapInArrow(scan, "conv_id long, pos long, behind array<long>").select("pos", "behind")
    ways = spread.join(behind, "pos").select(*spread.columns, "behind").mapInArrow(walk, _PIECE + ", cost long, ways array<struct<audit:string,roles:array<string>,state:long>>")
    return whole.unionByName(_sorted(ways).mapInArrow(chain, _DONE))


def hashes(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired conversations, each streamed through one hash.

    A hash is sequential, so a conversation's repaired rows pass one task, in order and one Arrow
    batch at a time; nothing is held of them but the hash.
    """
    outcome = answers.select("conv_id", F.explode("roles").alias("x")).select(F.posexplode("x.roles").alias("k", "roles"), F.col("x.pos").alias("first")).select((F.col("first") + F.col("k")).alias("pos"), "roles")
    blank = lambda roles: F.transform(roles, lambda r: F.when(r == "u", "user:").otherwise("assistant:"))
    kept = rows.join(outcome, "pos")
    own = F.right("roles", F.lit(1))
    role = F.when(own == F.substring("role", 1, 1), F.col("role")).when(own == "u", "user").otherwise("assistant")
    put = F.filter(F.split(F.substring(F.col("roles"), F.lit(1), F.length("roles") - 1), ""), lambda r: r != "")
    lines = F.concat(blank(put), F.when(own == "-", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), F.col("text")))))
    kept = kept.select("conv_id", "pos", lines.alias("lines"))
    tail = answers.filter("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("pos"), blank(F.filter(F.split("tail", ""), lambda r: r != "")).alias("lines"))
    out = kept.filter(F.size("lines") > 0).unionByName(tail).select("conv_id", "pos", F.array_join("lines", "\n").alias("text"))

    def run(batches):
        now, digest, any_ = None, None, False
        for b in batches:
            done = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if not any_ or conv != now:
                    if any_:
                        done.append((now, digest.hexdigest()))
                    now, digest, any_ = conv, hashlib.sha256(), True
                    digest.update(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            if done:
                yield _batch(done, "conv_id long, repaired_sha256 string", (pa.int64(), pa.string()))
        if any_:
            yield _batch([(now, digest.hexdigest())], "conv_id long, repaired_sha256 string", (pa.int64(), pa.string()))

    return _sorted(out).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Per conversation of ``rows``, after damage: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Damage, faults and edits are those of the query's contract.  Rows of equal turn are taken
    by role and text, null turns first.  A role is known by its first character; one that is
    not s, u or a, or an empty one, has to be reroled or deleted.  Nulls of role and text are
    one space, so they are blank texts and unknown roles; rows without a conversation are one
    conversation, whose conv_id is null; rows that repeat are duplicates.  A conversation
    without rows after damage has zeros, an empty audit and the hash of an empty string.
    Other columns are not read; no rows give no rows.  conv_id and turn must be whole numbers.
    """
    small_batches(rows.sparkSession)
    placed = sorted_rows(damaged(rows, conv, turn, role, text))
    pieces = written(pieces_of(marked(placed), piece), "symbols")
    answers = written(solved(pieces), "answers")
    forget(pieces)
    digests = hashes(placed, answers)
    every = rows.select(F.col(conv).cast("long").alias("own")).distinct()
    a = answers.drop("roles", "tail")
    d = digests.select(F.col("conv_id").alias("conv_d"), "repaired_sha256")
    out = every.join(a, F.col("own").eqNullSafe(F.col("conv_id")), "left").join(d, F.col("own").eqNullSafe(F.col("conv_d")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("own").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
