"""Choosing parts for a mark target: options, scoring, greedy fill, pruning.

Order that the task leaves to chance is md5(seed:id), so the same seed gives the same result
on every cluster.  Recurrences that no window can say are folds over slices of a run.  As the
order is a hash, a slice is a range of the hash's first bits: no run is ever ranked or sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.numbering import before, numbered
from quillmark.operators.search import seeded_order
from quillmark.operators.storage import kept, release

#: Bits of a mask that an exploded array lists at once; higher bits are exploded first.
LOW_BITS = 16


@dataclass(frozen=True)
class SelectionConfig:
    """What a run asks for: marks within target +- tolerance."""

    target: int
    tolerance: int = 2
    seed: int = 42
    mode: str = "ALL"
    max_questions: int | None = None

    def __post_init__(self) -> None:
        if self.target <= 0:
            raise ValueError("target must be over 0")
        if self.tolerance < 0:
            raise ValueError("tolerance must not be negative")
        if self.mode not in ("ALL", "PRUNE", "SKIP"):
            raise ValueError("mode is one of ALL, PRUNE, SKIP")
        if self.max_questions is not None and self.max_questions < 1:
            raise ValueError("max_questions must be over 0")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def options(parts: DataFrame, mode: str, key: str = "question_id") -> DataFrame:
    """(key, mask, marks, n_parts) of each candidate subset of a question's valid leaves.

    ALL: the full set; PRUNE: all prefixes; SKIP: every non-empty subset, by bit mask (bit k is
    leaf k in order).  Questions have at most 62 leaves; more fail.
    """
    leaves = _leaves(parts.filter("is_valid"), key)
    n = F.size("leaf")
    if mode == "SKIP":
        return _subsets(leaves, key)
    masks = {"ALL": F.array(_bit(n) - 1), "PRUNE": F.transform(F.sequence(F.lit(1), n), lambda k: _bit(k) - 1)}[mode]
    return _with_marks(leaves.select(key, "leaf", F.explode(masks).alias("mask")), key)


def _subsets(leaves: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Every non-empty subset of ``_leaves``; blocks of them spread over ``tasks`` where given."""
    n = F.size("leaf")
    high = F.sequence(F.lit(0).cast("long"), _bit(F.greatest(n - LOW_BITS, F.lit(0))) - 1)
    low = F.sequence(F.lit(0).cast("long"), _bit(F.least(n, F.lit(LOW_BITS))) - 1)
    rows = leaves.select(key, "leaf", F.explode(high).alias("__high"))
    if tasks:
        rows = rows.repartition(tasks, key, "__high")
    rows = rows.select(key, "leaf", "__high", F.explode(low).alias("__low"))
    return _with_marks(rows.select(key, "leaf", (F.col("__high") * (1 << LOW_BITS) + F.col("__low")).alias("mask")).filter("mask > 0"), key)


def _with_marks(rows: DataFrame, key: str) -> DataFrame:
    chosen = F.filter("leaf", lambda x, i: F.getbit(F.col("mask"), i) == 1)
    return rows.select(key, "mask", F.aggregate(chosen, F.lit(0), lambda a, x: a + x["marks"]).alias("marks"), F.size(chosen).alias("n_parts"))


def _leaves(parts: DataFrame, key: str) -> DataFrame:
    """(key, leaf): the leaves of each question in order; questions of over 62 leaves, which a mask can't hold, fail."""
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "marks"))).alias("leaf"))
    return listed.withColumn("leaf", F.when(F.size("leaf") <= 62, F.col("leaf")).otherwise(F.raise_error(F.lit("a question has over 62 leaves; use operators.wide"))))


def best_of_leaves(parts: DataFrame, most: int, key: str = "question_id") -> DataFrame:
    """``best_within`` of all subsets without listing them: the best of each sum up to ``most``, leaf by leaf.

    Marks must not be negative.  A sum's best has most parts, then the smallest mask.
    """
    leaf = F.transform("leaf", lambda x, i: F.struct(x["marks"].cast("int").alias("m"), _bit(i).alias("bit")))
    start = F.expr(f"transform(sequence(0, {most}), s -> if(s = 0, named_struct('n', 0, 'neg', 0L), null))")

    def step(a, x):
        def with_leaf(v, s):
            before = F.get(a, s - x["m"])
            taken = F.when((s >= x["m"]) & before.isNotNull(), F.struct((before["n"] + 1).alias("n"), (before["neg"] - x["bit"]).alias("neg")))
            return F.greatest(v, taken)

        return F.transform(a, with_leaf)

    sums = F.transform(F.aggregate(leaf, start, step), lambda v, s: F.struct(s.alias("marks"), v["n"].alias("n"), v["neg"].alias("neg")))
    best = _leaves(parts.filter("is_valid"), key).select(key, F.array_max(F.filter(sums, lambda x: x["n"] > 0)).alias("x"))
    return best.filter("x is not null").select(key, (-F.col("x.neg")).alias("mask"), F.col("x.marks").alias("marks"))


def covering_leaves(parts: DataFrame, pinned: DataFrame, key: str = "question_id") -> DataFrame:
    """``covering_option`` of all subsets without listing them, for marks that are over 0.

    The smallest subset that holds the pins is the pins; where a pin is no leaf, the largest is all leaves.
    """
    both = _leaves(parts.filter("is_valid"), key).join(pinned.select(key, F.col("mask").alias("pins")), key)
    full = _bit(F.size("leaf")) - 1
    mask = F.when((F.col("pins") != 0) & (F.col("pins").bitwiseAND(full) == F.col("pins")), F.col("pins")).otherwise(full)
    chosen = F.filter("leaf", lambda x, i: F.getbit(F.col("mask"), i) == 1)
    return both.withColumn("mask", mask).select(key, "mask", F.aggregate(chosen, F.lit(0), lambda a, x: a + x["marks"]).alias("marks"))


def ranked_options(opts: DataFrame, key: str = "question_id") -> DataFrame:
    """Options by marks, then parts, both descending; ties by mask."""
    return opts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("marks"), F.desc("n_parts"), "mask")))


def ranked_subsets(parts: DataFrame, key: str = "question_id") -> DataFrame:
    """``ranked_options`` of all subsets of a question's valid leaves (SKIP), without sorting the listed rows.

    A subset of up to 16 leaves is one number whose order is the rank: marks, leaves, mask.  A question's
    are listed by doubling and sorted as an array, so a task holds one question's.  Subsets of more leaves, or
    with unknown marks, are listed by many tasks and ranked by ranges of their order.
    """
    leaves = kept(_leaves(parts.filter("is_valid"), key))
    one = (F.size("leaf") <= LOW_BITS) & ~F.exists("leaf", lambda x: x["marks"].isNull())
    none = LOW_BITS << LOW_BITS  # no leaf yet: no marks, as many leaves to come as there may be, no bit
    steps = F.transform("leaf", lambda x, i: F.coalesce(x["marks"].cast("long"), F.lit(0)) * -(1 << LOW_BITS + 5) - (1 << LOW_BITS) + _bit(i))
    listed = F.aggregate(steps, F.array(F.lit(none).cast("long")), lambda a, x: F.concat(a, F.transform(a, lambda s: s + x)))
    rows = leaves.filter(one).select(key, F.posexplode(F.sort_array(F.slice(listed, 2, 1 << LOW_BITS))).alias("__pos", "__s"))
    out = rows.select(
        key,
        F.col("__s").bitwiseAND((1 << LOW_BITS) - 1).alias("mask"),
        (-F.shiftright("__s", LOW_BITS + 5)).cast("int").alias("marks"),
        (LOW_BITS - F.shiftright("__s", LOW_BITS).bitwiseAND(31)).cast("int").alias("n_parts"),
        (F.col("__pos") + 1).alias("place"),
    )
    rest = leaves.filter(~one)
    if rest.isEmpty():
        return out
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = before(_subsets(rest, key, tasks), [key], [F.desc("marks"), F.desc("n_parts"), F.col("mask")], {"place": F.lit(1)})
    return out.unionByName(large.withColumn("place", (F.col("place") + 1).cast("int")))


def best_within(opts: DataFrame, most: int, key: str = "question_id") -> DataFrame:
    """Per question the best option of at most ``most`` marks."""
    return opts.filter(F.col("marks") <= most).groupBy(key).agg(F.max_by("mask", F.struct("marks", "n_parts", -F.col("mask"))).alias("mask"), F.max("marks").alias("marks"))


def jitter(seed: int, key: str) -> Column:
    """0 to 1 from the first eight hex digits of the seeded order."""
    return F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def topic_scores(opts: DataFrame, budget: float, seed: int, full: Column) -> DataFrame:
    """Adds ``score``: closeness to the budget up to 10, 5 for a full question, jitter up to 5."""
    return opts.withColumn("score", F.greatest(F.lit(0.0), 10 - F.abs(F.col("marks") - budget)) + F.when(full, 5.0).otherwise(0.0) + jitter(seed, "question_id") * 5)


#: Candidates of a slice at most: slices grow from one to the next, as the more of them a run needs the less they hold that fits.
LARGEST = 1 << 16
#: Places of the seeded order: the first 32 bits of its hash.
PLACES = 1 << 32


def place(seed: int, key: str) -> Column:
    """The first 32 bits of a row's seeded order; rows are spread over them evenly."""
    return F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("long")


def slices(candidates: DataFrame, state: DataFrame, run: list[str], fits: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds): the next candidates of each run of ``state`` (run, low, ...), about ``size`` of those that ``fits`` leaves, from place ``low`` on.

    ``bounds`` is the state of the runs that have candidates left, with ``high``, the place before
    which their slice ends; a slice may be empty by chance.  Counting is an aggregate of a row
    a run; then a slice is a filter, as places are spread evenly.
    """
    ahead = (F.col("__place") >= F.col("low")) & fits
    n = candidates.join(state, run).filter(ahead).groupBy(*run).agg(F.count("*").alias("__n"))
    width = F.greatest(F.ceil((PLACES - F.col("low")) * (size / F.col("__n"))), F.lit(1))
    high = F.when(F.col("__n") <= size, F.lit(PLACES)).otherwise(F.least(F.lit(PLACES), F.col("low") + width)).cast("long")
    bounds = kept(state.join(n, run).withColumn("high", high).drop("__n"))
    return candidates.join(bounds, run).filter(ahead & (F.col("__place") < F.col("high"))), bounds


def greedy_fill(totals: DataFrame, run: list[str], config: SelectionConfig, key: str = "question_id", first: int = 2048) -> DataFrame:
    """First fit in seeded order: a question is taken while under the target if it keeps within target + tolerance.

    totals: run columns, key, marks.  Candidates are folded by slices of about ``first`` and then more that still
    fit, the lowest places of each run first.  The first candidate of a slice is taken, so a run
    ends after about as many slices as it takes questions at most, mostly after one.
    """
    kind = totals.schema[key].dataType.simpleString()
    most = config.max_questions or 2**31 - 1
    own = kept(totals.select(*run, F.col(key), F.col("marks").cast("int").alias("marks"), place(config.seed, key).alias("__place")).filter(F.col("marks").between(1, config.target + config.tolerance)))
    state = own.select(*run).distinct().withColumns({"sum": F.lit(0), "n": F.lit(0), "low": F.lit(0).cast("long")})
    fits = F.col("marks") <= config.target + config.tolerance - F.col("sum")
    out, done, size = None, [], first
    while True:
        part, bounds = slices(own, state, run, fits, size)
        size = min(4 * size, LARGEST)
        listed = part.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("__place", seeded_order(config.seed, key).alias("o"), F.col(key).alias("q"), F.col("marks").alias("m")))).alias("c"))
        fold = F.aggregate(
            "c",
            F.struct(F.col("sum"), F.expr(f"cast(array() as array<{kind}>)").alias("picked")),
            lambda a, x: F.when(
                (a["sum"] < config.target) & (a["sum"] + x["m"] <= config.target + config.tolerance) & (F.size(a["picked"]) + F.col("n") < most),
                F.struct((a["sum"] + x["m"]).alias("sum"), F.concat(a["picked"], F.array(x["q"])).alias("picked")),
            ).otherwise(F.struct(a["sum"].alias("sum"), a["picked"].alias("picked"))),
        )
        nothing = F.struct(F.col("sum"), F.expr(f"cast(array() as array<{kind}>)").alias("picked"))
        folded = kept(bounds.join(listed, run, "left").select(*run, "n", "high", F.when(F.col("c").isNull(), nothing).otherwise(fold).alias("f")))
        release(bounds)
        done.append(folded)
        picks = folded.select(*run, "n", F.posexplode("f.picked").alias("pos", key)).select(*run, (F.col("pos") + F.col("n") + 1).alias("pos"), key)
        out = picks if out is None else out.unionByName(picks)
        state = folded.select(*run, F.col("f.sum").alias("sum"), (F.col("n") + F.size("f.picked")).alias("n"), F.col("high").alias("low")).filter((F.col("sum") < config.target) & (F.col("n") < most) & (F.col("low") < PLACES))
        if state.isEmpty():
            if len(done) > 1:
                out = kept(out)
                release(*done)
            release(own)
            return out


def prune_to_target(parts: DataFrame, target: int, key: str = "question_id") -> DataFrame:
    """Leaves that stay when the last ones go until a question has at most ``target`` marks; the first always stays."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("running", F.sum("marks").over(w)).filter((F.col("running") <= target) | (F.col("ord") == 1))


def prune_plan(leaves: DataFrame, target: int, mode: str, min_parts: int = 1, key: str = "question_id") -> DataFrame:
    """Leaves that stay when a plan is pruned, one leaf at a time, until it has at most ``target`` marks or ``min_parts`` leaves.

    SKIP: the smallest leaf goes, the first in order of equal ones; PRUNE: the last one; ALL:
    none.  leaves: key, ord, marks.  Who goes next does not depend on who has gone, so running
    sums over a question's leaves say where it ends.
    """
    if mode not in ("ALL", "PRUNE", "SKIP"):
        raise ValueError("mode is one of ALL, PRUNE, SKIP")
    if mode == "ALL":
        return leaves
    turn = [F.col("marks"), F.col("ord")] if mode == "SKIP" else [F.desc("ord")]
    before = Window.partitionBy(key).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    left = F.sum("marks").over(whole) - F.coalesce(F.sum("marks").over(before), F.lit(0))
    parts = F.count("*").over(whole) - F.count("*").over(before)
    return leaves.withColumns({"__left": left, "__parts": parts}).filter((F.col("__left") <= target) | (F.col("__parts") <= min_parts)).drop("__left", "__parts")


def prune_smallest(parts: DataFrame, run: list[str], target: int, tolerance: int, protected: Column) -> DataFrame:
    """Leaves that stay when the globally smallest unprotected ones go while a run is over target + tolerance.

    A leaf goes only if what remains is no further from the target than before and its plan
    keeps a leaf.  All leaves that may go do so smallest first until the first one that must not.
    Among leaves of m marks what is left falls by m each time, so sums and counts of a run's
    leaves by marks say how many of each go; only those with the marks at which it ends are
    put in order, over all tasks.  Marks are whole numbers; leaves without any stay.
    """
    plan = [*run, "question_id"]
    marks = F.col("marks").cast("long")
    # of a plan without a protected leaf, the last in order stays
    by_plan = Window.partitionBy(*plan)
    held = F.max(F.coalesce(protected, F.lit(False))).over(by_plan)
    last = F.row_number().over(by_plan.orderBy(F.col("marks").cast("int").desc(), F.desc("question_id"), F.desc("ord"))) == 1
    rows = kept(parts.withColumn("__may", ~F.coalesce(protected, F.lit(False)) & (held | ~last) & F.col("marks").isNotNull()))
    # a row for each run and number of marks: what is left before any of these goes, and how many may
    by_marks = rows.groupBy(*run, marks.alias("__m")).agg(F.sum(marks).alias("__s"), F.count_if("__may").alias("__n"))
    before = Window.partitionBy(*run).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    steps = by_marks.withColumn("__total", F.sum("__s").over(Window.partitionBy(*run))).filter("__n > 0")
    steps = steps.withColumn("__left", F.col("__total") - F.coalesce(F.sum(F.col("__m") * F.col("__n")).over(before), F.lit(0)))
    # a leaf goes while what is left is over target + tolerance and at least half its marks over the target
    over = F.greatest(F.lit(target + tolerance + 1), F.ceil(F.lit(target) + F.col("__m") / 2).cast("long"))
    goes = F.when((F.col("__m") < 0) | (F.col("__left") < over), 0).when(F.col("__m") == 0, F.col("__n")).otherwise(F.least("__n", F.floor((F.col("__left") - over) / F.greatest("__m", F.lit(1))) + 1))
    steps = steps.withColumn("__go", goes.cast("long")).withColumn("__end", F.min(F.when(F.col("__go") < F.col("__n"), F.col("__m"))).over(Window.partitionBy(*run)))
    ends = kept(steps.groupBy(*run).agg(F.max("__m").alias("__most"), F.min("__end").alias("__end"), F.max(F.when(F.col("__m") == F.col("__end"), F.col("__go"))).alias("__go")))
    # null runs are runs as well
    other = lambda df: F.broadcast(df.withColumnsRenamed({r: f"__{r}" for r in run}))
    same = [F.col(r).eqNullSafe(F.col(f"__{r}")) for r in run]
    own = rows.join(other(ends), same, "left").select(*rows.columns, "__most", "__end", "__go")
    whole = F.col("__may") & (F.col("__end").isNull() & F.col("__most").isNotNull() | (marks < F.col("__end")))
    at_end = F.col("__may") & (marks == F.col("__end")) & (F.col("__go") > 0)
    sure = own.filter(~F.coalesce(whole, F.lit(False)) & ~F.coalesce(at_end, F.lit(False))).select(parts.columns)
    ordered = numbered(own.filter(at_end), [F.col(c) for c in (*plan, "ord")], "__place")
    firsts = ordered.groupBy(*run).agg(F.min("__place").alias("__first"))
    rest = ordered.join(other(firsts), same).filter(F.col("__place") - F.col("__first") >= F.col("__go"))
    return sure.unionByName(rest.select(parts.columns))


def missing_topics(wanted: DataFrame, covered: DataFrame) -> DataFrame:
    return wanted.select("topic").distinct().join(covered.select("topic").distinct(), "topic", "left_anti")


def covering_option(opts: DataFrame, pinned: DataFrame, key: str = "question_id") -> DataFrame:
    """The smallest option that holds all pinned leaves (``mask`` of them); the largest where none does."""
    both = opts.join(pinned.select(key, F.col("mask").alias("pins")), key)
    holds = F.col("mask").bitwiseAND(F.col("pins")) == F.col("pins")
    order = F.struct(F.when(holds, 0).otherwise(1).alias("a"), F.when(holds, F.col("marks")).otherwise(-F.col("marks")).alias("b"), F.when(holds, F.col("n_parts")).otherwise(-F.col("n_parts")).alias("c"), F.col("mask").alias("d"))
    return both.groupBy(key).agg(F.min_by(F.struct("mask", "marks"), order).alias("x")).select(key, "x.mask", "x.marks")


def deviation(total: Column, target: int) -> list[Column]:
    """Signed and absolute difference from the target."""
    return [(total - target).alias("difference"), F.abs(total - target).alias("deviation")]
