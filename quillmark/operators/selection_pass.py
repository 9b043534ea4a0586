"""The whole selection pass of a build: pins, keyword matches, topic coverage, greedy fill, pruning, warnings.

A run is a group of questions (an exam's year, say) that a request selects from.  Forced pins
need no order and are one join.  Coverage asks, topic by topic, for the best option over all
of a run's questions: an aggregate.  Only first fit depends on what was taken before; it goes
through a run's candidates by slices of the seeded order, which are ranges of a hash, and on to
the next slice only while some run is not full.  A task holds a slice of those that still fit,
and no run is ranked or sorted.

Whatever is left to chance is taken from md5(seed:id), so results don't depend on the cluster.
In SKIP mode a question has one option for every total that its leaves can make: of these
subsets the one with most leaves, then the smallest mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.detection import ancestors
from quillmark.operators.facets import effective_topic
from quillmark.operators.selection import LARGEST, PLACES, SelectionConfig, place, slices
from quillmark.operators.storage import kept, release

Option = tuple[int, int, int]  # marks, leaves, mask
_PICK = "question_id long, mask long, marks int, origin string, topics array<string>"


@dataclass(frozen=True)
class Request(SelectionConfig):
    """What a build asks for beyond the marks."""

    topics: tuple[str, ...] = ()
    force_topics: bool = True
    keyword_mode: bool = False
    backfill: bool = True
    greedy: bool | None = None
    min_questions: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_questions < 1:
            raise ValueError("min_questions must be over 0")
        if self.max_questions is not None and self.max_questions < self.min_questions:
            raise ValueError("max_questions must not be under min_questions")

    @property
    def fills(self) -> bool:
        return not self.keyword_mode if self.greedy is None else self.greedy


def chance(*what: object) -> float:
    """0 to 1 from the first eight hex digits of md5(what joined by colons)."""
    return int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:8], 16) / 2**32


def question_options(leaves: list[dict], mode: str, most: int) -> list[Option]:
    """Options of a question's usable leaves by marks, then leaves, both descending, then mask.

    leaves in order, each with marks, usable.  ALL: all of them; PRUNE: prefixes; SKIP: for each
    total of up to ``most`` marks the best subset, and all of them.
    """
    own = [(x["marks"], k) for k, x in enumerate(leaves) if x["usable"]]
    if not own:
        return []
    whole = (sum(m for m, _ in own), len(own), sum(1 << k for _, k in own))
    if mode == "ALL":
        out = {whole}
    elif mode == "PRUNE":
        out, marks, mask = set(), 0, 0
        for n, (m, k) in enumerate(own):
            marks, mask = marks + m, mask | 1 << k
            out.add((marks, n + 1, mask))
    else:
        best: dict[int, tuple[int, int]] = {0: (0, 0)}
        for m, k in own:
            for s, (n, neg) in sorted(best.items(), reverse=True):
                if s + m <= most:
                    best[s + m] = max(best.get(s + m, (-1, 0)), (n + 1, neg - (1 << k)))
        out = {(s, n, -neg) for s, (n, neg) in best.items() if n} | {whole}
    return sorted(out, key=lambda o: (-o[0], -o[1], o[2]))


def topics_of(leaves: list[dict], mask: int) -> list[str]:
    return sorted({x["topic"] for k, x in enumerate(leaves) if mask >> k & 1 and x["topic"]})


def coverage_option(options: list[Option], leaves: list[dict], topic: str, remaining: int, open_topics: int, seed: int, ident: object) -> tuple[float, Option] | None:
    """(score, option): closeness to an equal share of the remaining marks up to 10, 5 for all leaves, chance up to 5.

    Of the options of at most the remaining marks, else the smallest, those that hold the topic.
    """
    fitting = [o for o in options if 1 <= o[0] <= max(1, remaining)] or options[-1:]
    share = remaining / max(1, open_topics)
    best = None
    for o in fitting:
        if topic in topics_of(leaves, o[2]):
            score = max(0.0, 10 - abs(o[0] - share)) + 5.0 * (o[1] == len(leaves)) + 5 * chance(seed, ident, o[2])
            if best is None or score > best[0]:
                best = (score, o)
    return best


def fill_option(options: list[Option], room: int, size: float, seed: int, ident: object) -> Option | None:
    """One of the options that fit: by chance of the three largest, the three smallest or all, as ``size`` says."""
    fitting = [o for o in options if 1 <= o[0] <= room]
    if not fitting:
        return None
    pool = fitting[:3] if size > 0.3 else fitting[-3:] if size < -0.3 else fitting
    return pool[int(chance(seed, ident, "pick") * len(pool))]


def pruned(picks: list[dict], target: int, tolerance: int, mode: str) -> set[tuple]:
    """(question, leaf) of what goes, one at a time, from plans of over target + tolerance marks.

    picks: question_id, k, marks, kept, in document order.  SKIP: the smallest leaf that is not
    kept; PRUNE: the smallest of the plans' last ones.  A plan keeps a leaf; the end is where a
    step would lead further off the target.  Ties go by question and leaf.
    """
    left = [dict(p) for p in picks]
    total, gone = sum(p["marks"] for p in left), set()
    while total > target + tolerance:
        by: dict = {}
        for p in left:
            by.setdefault(p["question_id"], []).append(p)
        free = []
        for plan in by.values():
            own = [p for p in plan if not p["kept"]]
            if own and len(plan) - len(own) < len(plan) - 1:
                free += own[-1:] if mode == "PRUNE" else own
        if not free:
            break
        x = min(free, key=lambda p: (p["marks"], p["question_id"], p["k"]))
        if abs(total - x["marks"] - target) > abs(total - target):
            break
        total -= x["marks"]
        left.remove(x)
        gone.add((x["question_id"], x["k"]))
    return gone


def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.select("question_id").distinct().withColumn(name, F.lit(True))


def _labels(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("question_id").agg(F.collect_set("label").alias(name))


def _below(listed: str) -> F.Column:
    """Whether a leaf is one of the listed labels or below one."""
    return F.coalesce(F.arrays_overlap(ancestors(F.col("label")), listed), F.lit(False))


def _pool(questions: DataFrame, parts: DataFrame, run: list[str], c: Request, pinned: DataFrame, part_pins: DataFrame, matched: DataFrame) -> DataFrame:
    """(run, question_id, leaf, whole, hit, q_topic): questions that the request may use with their leaves in order.

    A leaf has marks, topic, usable, pinned; ``whole``: the question itself is pinned; ``hit``: it matches keywords.
    """
    # a question's pins and matches come to its leaves as lists: all joins, windows and groups are by question
    q = questions.select("question_id", *run, F.col("topic").alias("__q")).join(_flag(pinned, "__whole"), "question_id", "left")
    q = q.join(_labels(part_pins, "__pins"), "question_id", "left").join(_labels(matched, "__matches").withColumn("__hit", F.lit(True)), "question_id", "left")
    rows = parts.join(q, "question_id").withColumns({"topic_": effective_topic(F.col("topic"), F.col("__q")), "__pin": _below("__pins"), "__match": _below("__matches")}).drop("__pins", "__matches")
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    by_question = Window.partitionBy("question_id")
    fits = F.col("topic_").isin(*c.topics) if c.topics else F.lit(True)
    special = no("__whole") | no("__hit") | F.max(no("__pin")).over(by_question)
    if c.topics:
        named = F.col("__q").isin(*c.topics) | F.coalesce(F.max(F.col("topic").isin(*c.topics)).over(by_question), F.lit(False))
        rows = rows.withColumn("__in", special | named).filter("__in")
    if c.keyword_mode:
        wanted = no("__match") | no("__pin")
        some = F.max(wanted).over(by_question)
        usable = wanted | ~some
        if not c.fills:
            rows = rows.withColumn("__some", some | no("__whole")).filter("__some")
    elif not c.topics or c.mode == "ALL":
        usable = F.lit(True)
    elif c.mode == "PRUNE":
        usable = F.col("ord") <= F.max(F.when(fits, F.col("ord"))).over(by_question)
    else:
        usable = fits
    leaf = F.struct("ord", "label", F.col("marks").cast("int").alias("marks"), F.col("topic_").alias("topic"), (F.coalesce(usable, F.lit(False)) & F.col("is_valid")).alias("usable"), no("__pin").alias("pinned"))
    rows = rows.withColumn("__leaf", leaf)
    out = rows.groupBy(*run, "question_id").agg(F.array_sort(F.collect_list("__leaf")).alias("leaf"), F.max(no("__whole")).alias("whole"), F.max(no("__hit")).alias("hit"), F.first("__q").alias("q_topic"))
    return out.filter(F.exists("leaf", lambda x: x["usable"]))


def _kinds(df: DataFrame, run: list[str]) -> str:
    return ", ".join(f"`{r}` {df.schema[r].dataType.simpleString()}" for r in run)


def _rows(rows: list[tuple], run: list[str], source: pa.Schema) -> pa.RecordBatch:
    types = [source.field(r).type for r in run] + [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]
    names = [*run, "question_id", "mask", "marks", "origin", "topics"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _forced(pool: DataFrame, run: list[str], c: Request) -> DataFrame:
    """Picks for pins: all usable leaves of a pinned question, else its smallest option that holds the pinned leaves."""
    mode = "SKIP" if c.keyword_mode else c.mode

    def pick(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                options = question_options(r["leaf"], mode, sum(x["marks"] for x in r["leaf"]))
                pins = sum(1 << k for k, x in enumerate(r["leaf"]) if x["pinned"])
                # the pins themselves are an option where every subset is one
                if mode == "SKIP" and not r["whole"] and all(x["usable"] for x in r["leaf"] if x["pinned"]):
                    options = options + [(sum(x["marks"] for x in r["leaf"] if x["pinned"]), bin(pins).count("1"), pins)]
                o = options[0] if r["whole"] else next((o for o in sorted(options, key=lambda o: (o[0], o[1], -o[2])) if o[2] & pins == pins), options[0])
                out.append((*(r[k] for k in run), r["question_id"], o[2], o[0], "pinned", topics_of(r["leaf"], o[2])))
            if out:
                yield _rows(out, run, b.schema)

    own = pool.filter(F.col("whole") | F.exists("leaf", lambda x: x["pinned"]))
    return own.select(*run, "question_id", "leaf", "whole").mapInArrow(pick, f"{_kinds(pool, run)}, {_PICK}")


def _least(mode: str) -> F.Column:
    """Marks of a question's smallest option."""
    own = F.transform(F.filter("leaf", lambda x: x["usable"]), lambda x: x["marks"])
    if mode == "ALL":
        return F.aggregate(own, F.lit(0), lambda a, m: a + m)
    return F.element_at(own, 1) if mode == "PRUNE" else F.array_min(own)


def _first_fit(pool: DataFrame, picks: DataFrame, run: list[str], c: Request, seed: int, origin: str, first: int = 1024) -> DataFrame:
    """Picks that first fit adds, by slices of about ``first`` of a run's candidates that still fit, in seeded order.

    Keyword matches take the largest option within the target; the fill one by chance within
    target + tolerance while a run is under the target.
    """
    keyword = origin == "keyword"
    mode = "SKIP" if c.keyword_mode else c.mode
    most = c.target if keyword else c.target + c.tolerance
    left = pool.join(picks.select("question_id").distinct(), "question_id", "left_anti")
    own = kept(left.select(*run, "question_id", "leaf", _least(mode).alias("__least"), place(seed, "question_id").alias("__place")).filter(F.col("__least") <= most))
    start = own.select(*run).distinct().join(picks.groupBy(*run).agg(F.sum("marks").alias("total"), F.count("*").alias("n")), run, "left")
    open_ = (F.col("total") < c.target) & (F.lit(True) if keyword or c.max_questions is None else F.col("n") < c.max_questions)
    state = kept(start.select(*run, F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("low")).filter(open_))
    source = pool.select(*run)

    def fit(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        names = [k.as_py() for k in key]
        total, n = found["total"][0].as_py(), found["n"][0].as_py()
        size_ = 2 * chance(seed, *names, "size") - 1
        order = lambda r: (hashlib.md5(f"{seed}:{r['question_id']}".encode()).hexdigest(), r["question_id"])
        out = []
        for r in sorted(found.select(["question_id", "leaf"]).to_pylist(), key=order):
            if total >= c.target or (not keyword and c.max_questions is not None and n >= c.max_questions):
                break
            room = most - total
            options = question_options(r["leaf"], mode, room)
            o = next((o for o in options if o[0] <= room), None) if keyword else fill_option(options, room, size_, seed, r["question_id"])
            if o is None:
                continue
            total, n = total + o[0], n + 1
            out.append((*names, r["question_id"], o[2], o[0], origin, topics_of(r["leaf"], o[2])))
        return pa.Table.from_batches([_rows(out, run, found.schema)])

    fits = F.col("__least") <= most - F.col("total")
    out, done, size = picks.limit(0), [own], first
    while not state.isEmpty():
        part, bounds = slices(own, state, run, fits, size)
        size = min(4 * size, LARGEST)
        new = kept(part.select(*run, "question_id", "leaf", "total", "n").groupBy(*run).applyInArrow(fit, f"{_kinds(source, run)}, {_PICK}"))
        out = out.unionByName(new)
        added = new.groupBy(*run).agg(F.sum("marks").alias("__m"), F.count("*").alias("__k"))
        then = bounds.join(added, run, "left").select(*run, (F.col("total") + F.coalesce("__m", F.lit(0))).alias("total"), (F.col("n") + F.coalesce("__k", F.lit(0))).alias("n"), F.col("high").alias("low"))
        before, state = state, kept(then.filter(open_ & (F.col("low") < PLACES)))
        release(before, bounds)
    release(state, *done)
    return out


def _whole_score(seed: int, marks: F.Column, remaining: F.Column, open_topics: F.Column) -> F.Column:
    """What ``coverage_option`` gives a question's ``topic`` for all its leaves, should it take them; null where these are no option."""
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("question_id").cast("string"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.size("leaf")) - 1).cast("string")))
    luck = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") / 2**32
    close = F.greatest(F.lit(0.0), F.lit(10.0) - F.abs(marks - remaining / open_topics))
    whole = F.forall("leaf", lambda x: x["usable"]) & F.exists("leaf", lambda x: x["topic"] == F.col("topic"))
    return F.when(whole, close + 5 + 5 * luck)


def _cover(pool: DataFrame, picks: DataFrame, run: list[str], c: Request, seed: int) -> DataFrame:
    """Picks that give each requested topic that is not covered yet its best option, topics of few questions first.

    Topics with as many questions go by chance.  One aggregate over all candidates a topic.
    """
    names = F.array(*map(F.lit, c.topics))
    mine = pool.withColumn("__t", F.array_intersect(names, F.array_union(F.array("q_topic"), F.transform("leaf", lambda x: x["topic"]))))
    counts = mine.select(*run, F.explode("__t").alias("topic")).groupBy(*run, "topic").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*run).orderBy("n", F.md5(F.concat(F.lit(f"{seed}:"), "topic"))))
    topics = kept(counts.withColumn("place", place).select(*run, "topic", "place"))
    mine = kept(mine)
    mode = "SKIP" if c.keyword_mode else c.mode
    wanted = len(c.topics)

    def best(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                covered = set(r["covered"] or [])
                if r["topic"] in covered:
                    continue
                remaining = c.target - (r["total"] or 0)
                found = coverage_option(question_options(r["leaf"], mode, max(1, remaining)), r["leaf"], r["topic"], remaining, wanted - len(covered & set(c.topics)), seed, r["question_id"])
                if found:
                    score, o = found
                    out.append((*(r[k] for k in run), r["question_id"], o[2], o[0], "topic", topics_of(r["leaf"], o[2]), score))
            if out:
                yield _rows([x[:-1] for x in out], run, b.schema).append_column("score", pa.array([x[-1] for x in out], pa.float64()))

    added = None
    for k in range(1, wanted + 1):
        now = picks if added is None else picks.unionByName(added)
        state = now.groupBy(*run).agg(F.sum("marks").alias("total"), F.array_distinct(F.flatten(F.collect_list("topics"))).alias("covered"))
        turn = topics.filter(F.col("place") == k).join(state, run, "left").select(*run, "topic", "total", "covered")
        # a row for each run: what is sent is no more than there are runs
        open_ = mine.join(turn, run).filter(F.array_contains("__t", F.col("topic"))).join(now.select("question_id"), "question_id", "left_anti")
        # what is not all leaves scores 15 at most, all leaves what SQL says: others than the best of these need no options
        remaining = F.lit(c.target) - F.coalesce("total", F.lit(0))
        open_count = F.greatest(F.lit(1), F.lit(wanted) - F.size(F.array_intersect(names, F.coalesce("covered", F.array().cast("array<string>")))))
        marks = F.aggregate("leaf", F.lit(0), lambda a, x: a + x["marks"])
        open_ = open_.withColumn("__most", _whole_score(seed, marks, remaining, open_count))
        least = open_.filter(marks.between(1, F.greatest(F.lit(1), remaining))).groupBy(*run).agg(F.max("__most").alias("__least"))
        open_ = open_.join(least, run, "left").filter(F.col("__least").isNull() | (F.greatest("__most", F.lit(15.0)) >= F.col("__least") - 1e-6))
        scored = open_.select(*run, "question_id", "leaf", "topic", "total", "covered").mapInArrow(best, f"{_kinds(pool, run)}, {_PICK}, score double")
        top = scored.groupBy(*run).agg(F.max_by(F.struct("question_id", "mask", "marks", "origin", "topics"), F.struct("score", -F.col("question_id"))).alias("x")).select(*run, "x.*")
        top = kept(top)
        added = top if added is None else added.unionByName(top)
    release(mine, topics)
    return added


def select_pass(questions: DataFrame, parts: DataFrame, run: list[str], c: Request, pinned: DataFrame, part_pins: DataFrame, matched: DataFrame, attempt: int = 0) -> DataFrame:
    """(run, question_id, mask, marks, origin, topics): the plans that one pass picks for every run, before pruning.

    Forced pins, keyword matches while they fit the target, the coverage of requested topics,
    and the fill.  pinned: question_id; part_pins, matched: question_id, label.
    """
    return picks_of(kept(_pool(questions, parts, run, c, pinned, part_pins, matched)), run, c, attempt)


def picks_of(pool: DataFrame, run: list[str], c: Request, attempt: int = 0) -> DataFrame:
    """``select_pass`` from a pool, which all attempts share."""
    seed = c.seed + attempt
    picks = kept(_forced(pool, run, c))
    add = lambda more: picks.unionByName(more)
    under = lambda: pool.join(picks.groupBy(*run).agg(F.sum("marks").alias("__m")).filter(F.col("__m") >= c.target).select(*run), run, "left_anti")
    if c.backfill:
        picks = add(_first_fit(under().filter("hit"), picks, run, c, seed, "keyword"))
    if c.force_topics and c.topics:
        picks = add(_cover(under(), picks, run, c, seed))
    if c.fills:
        picks = add(_first_fit(under(), picks, run, c, seed, "normal"))
    return picks


def prune_pass(picks: DataFrame, pool_leaves: DataFrame, run: list[str], c: Request) -> DataFrame:
    """Leaves that stay: (run, question_id, k, marks, origin); in ALL mode all of them.

    pool_leaves: question_id, k, marks, topic, pinned, whole.  A run's picks are as many as its
    marks allow, so a task holds a few hundred leaves.
    """
    rows = picks.select(*run, "question_id", "mask", "origin").join(pool_leaves, "question_id").filter(F.getbit("mask", F.col("k").cast("int")) == 1)
    rows = rows.select(*run, "question_id", "k", "marks", "origin", "topic", (F.col("pinned") | F.col("whole")).alias("kept"))
    if c.mode == "ALL":
        return rows

    def cut(held: pa.Table) -> pa.Table:
        own = held.sort_by([("question_id", "ascending"), ("k", "ascending")])
        gone = pruned(own.select(["question_id", "k", "marks", "kept"]).to_pylist(), c.target, c.tolerance, c.mode)
        keep = [(q, k) not in gone for q, k in zip(own["question_id"].to_pylist(), own["k"].to_pylist())]
        return own.filter(pa.array(keep))

    return rows.groupBy(*run).applyInArrow(cut, rows.schema)


def warnings(leaves: DataFrame, run: list[str], c: Request) -> DataFrame:
    """(run, total, excess, mismatched, pinned_marks, keyword_parts): what a user is warned of.

    ``excess``: marks over the target where target + tolerance is passed; ``mismatched``: up to
    three topics that were not asked for, sorted; null where there is nothing to say.
    """
    odd = F.sort_array(F.collect_set(F.when(~F.col("topic").isin(*c.topics), F.col("topic")))) if c.topics else F.array().cast("array<string>")
    out = leaves.groupBy(*run).agg(F.sum("marks").alias("total"), odd.alias("__odd"), F.sum(F.when(F.col("origin") == "pinned", F.col("marks")).otherwise(0)).alias("pinned_marks"), F.count_if(F.col("origin") == "keyword").alias("keyword_parts"))
    return out.select(*run, "total", F.when(F.col("total") > c.target + c.tolerance, F.col("total") - c.target).alias("excess"), F.when(F.size("__odd") > 0, F.array_join(F.slice("__odd", 1, 3), ", ")).alias("mismatched"), "pinned_marks", "keyword_parts")


def pool_leaves(questions: DataFrame, parts: DataFrame, pinned: DataFrame, part_pins: DataFrame) -> DataFrame:
    """(question_id, k, ord, marks, topic, pinned, whole) of all leaves; k is the place in the question from 0."""
    q = questions.select("question_id", F.col("topic").alias("__q")).join(_flag(pinned, "__whole"), "question_id", "left").join(_labels(part_pins, "__pins"), "question_id", "left")
    rows = parts.join(q, "question_id").withColumn("__pin", _below("__pins"))
    k = (F.row_number().over(Window.partitionBy("question_id").orderBy("ord")) - 1).alias("k")
    return rows.select("question_id", k, "ord", F.col("marks").cast("int").alias("marks"), effective_topic(F.col("topic"), F.col("__q")).alias("topic"), F.col("__pin").alias("pinned"), F.coalesce("__whole", F.lit(False)).alias("whole"))


def build(questions: DataFrame, parts: DataFrame, run: list[str], c: Request, pinned: DataFrame, part_pins: DataFrame, matched: DataFrame, attempts: int = 5) -> DataFrame:
    """(run, question_id, k, marks, origin, topic): the leaves that are selected for every run.

    Where topics must be covered, runs that miss one after a pass are selected again with the
    next seed, up to ``attempts`` times in all; the last attempt stands.
    """
    pool, done = kept(_pool(questions, parts, run, c, pinned, part_pins, matched)), None
    todo = pool
    for attempt in range(attempts):
        picks = kept(picks_of(todo, run, c, attempt))
        # the leaves of what was picked, not of all questions
        own = [df.join(picks.select("question_id").distinct(), "question_id", "left_semi") for df in (questions, parts)]
        found = kept(prune_pass(picks, pool_leaves(*own, pinned, part_pins), run, c))
        if not (c.force_topics and c.topics) or attempt + 1 == attempts:
            return found if done is None else done.unionByName(found)
        missing = found.groupBy(*run).agg(F.collect_set("topic").alias("t")).filter(F.size(F.array_except(F.array(*map(F.lit, c.topics)), "t")) > 0).select(*run)
        missing = kept(missing)
        good = found.join(missing, run, "left_anti")
        done = good if done is None else done.unionByName(good)
        if not missing.limit(1).count():
            return done
        todo = todo.join(missing, run, "left_semi")
    return done


def part_pins_of(pins: Iterable[str], spark) -> DataFrame:
    """(question_id, label) of pins 'question_id::label'; others are left out."""
    known = [p.split("::", 1) for p in pins if "::" in p]
    return spark.createDataFrame(pa.table({"question_id": pa.array([int(q) for q, _ in known], pa.int64()), "label": pa.array([label for _, label in known], pa.string())}))
