"""Pages by break pointers: where the page that begins at a group ends is a search in running heights.

A run's groups are cut into blocks of consecutive numbers.  Within a block a page's end is found
by binary search, so each start points to the next one.  Pages that go on past a block find
the block of their end by its running height, and the group within it.  What is left of a
run then is one pointer a block, from where a page first begins in it to where one first begins
in a later one; pointer jumping from the run's first group finds those that are real, and each
block lays out its own pages from there.  A task holds a block, whatever a run's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.storage import kept, release

BLOCK = 4096
#: How a page leaves a block: its end is looked for behind it; the next block begins a page; the page has no height yet and goes on.
CROSSES, BREAKS, OPEN = 0, 1, 2


@dataclass
class Block:
    """Groups of a block in order, with running heights (gaps included) from the run's beginning."""

    grp: np.ndarray
    height: np.ndarray
    bottom: np.ndarray
    page: int

    def __post_init__(self) -> None:
        solid = np.where(self.height > 0, np.arange(len(self.grp)), len(self.grp))
        #: the first group with a height, from each on
        self.first = np.minimum.accumulate(solid[::-1])[::-1]
        self.reach = self.page + self.bottom - self.height
        self.next = np.maximum(np.searchsorted(self.bottom, self.reach, "right"), np.arange(len(self.grp)) + 1)

    def starts(self, at: int) -> list[int]:
        """Places where pages begin, from one on."""
        out = []
        while at < len(self.grp):
            out.append(at)
            f = self.first[at]
            at = int(self.next[f]) if f < len(self.grp) else len(self.grp)
        return out

    def leaves(self, start: int) -> tuple[int, int, int]:
        """(kind, group with a height, reach) of a page that begins at the last start of a block."""
        f = int(self.first[start])
        if f == len(self.grp):
            return OPEN, int(self.grp[start]), 0
        return (CROSSES if self.reach[f] >= self.bottom[-1] else BREAKS), int(self.grp[f]), int(self.reach[f])


def _block(rows: pa.Table, page: int) -> Block:
    return Block(rows["grp"].to_numpy(), rows["height"].to_numpy(), rows["before"][0].as_py() + np.cumsum(rows["height"].to_numpy() + rows["gap"].to_numpy()), page)


def _loop(heights: list[int], gaps: list[int], page_height: int) -> list[tuple[int, int]]:
    page, y, at = 1, 0, []
    for h, gap in zip(heights, gaps):
        top = y + gap if y else 0
        if y and top + h > page_height:
            page, top = page + 1, 0
        at.append((page, top))
        y = top + h
    return at


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def paginate(groups: DataFrame, run: list[str], page_height: int, spacing: int, block: int = BLOCK) -> DataFrame:
    """(run, grp, page, top): groups in order, a new page where one doesn't fit and the page is not empty.

    groups: run, grp, height.  A group higher than a page stands alone and runs over (see ``oversize``).
    """
    return paged(groups.withColumn("gap", F.lit(spacing)), run, page_height, block)


def oversize(groups: DataFrame, run: list[str], page_height: int) -> DataFrame:
    """(run, grp, height, excess, warning) of groups that no page holds."""
    excess = F.col("height") - page_height
    says = F.format_string("group %d is %d higher than a page", F.col("grp").cast("int"), excess.cast("int"))
    return groups.filter(excess > 0).select(*run, F.col("grp").cast("int").alias("grp"), F.col("height").cast("int").alias("height"), excess.cast("int").alias("excess"), says.alias("warning"))


def paged(groups: DataFrame, run: list[str], page_height: int, block: int = BLOCK) -> DataFrame:
    """``paginate`` of groups with their own ``gap`` before them, which the first of a page leaves out.

    Heights and gaps must not be negative; grp numbers a run's groups in order, each once.
    Groups without height take no place and stand where they come.
    """
    listed = groups.select(*run, F.col("grp").cast("int").alias("grp"), F.col("height").cast("long").alias("height"), F.col("gap").cast("long").alias("gap"))
    listed = kept(listed.withColumn("block", F.floor(F.col("grp") / block)))
    sums = listed.groupBy(*run, "block").agg(F.sum(F.col("height") + F.col("gap")).alias("sum"), F.min("grp").alias("first"))
    ordered = Window.partitionBy(*run).orderBy("block")
    blocks = sums.withColumns({"upto": F.sum("sum").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.lead("first").over(ordered), "__n": F.count("*").over(Window.partitionBy(*run))})
    blocks = kept(blocks.withColumn("before", F.col("upto") - F.col("sum")))
    out = f"{_kinds(listed, run)}, grp int, page int, top int"

    def small(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("grp")
        at = _loop(rows["height"].to_pylist(), rows["gap"].to_pylist(), page_height)
        return rows.select([*run, "grp"]).append_column("page", pa.array([p for p, _ in at], pa.int32())).append_column("top", pa.array([t for _, t in at], pa.int32()))

    short = listed.join(blocks.filter("__n = 1").select(*run), run, "left_semi").groupBy(*run).applyInArrow(small, out)
    if blocks.filter("__n > 1").isEmpty():
        return short
    long_ = blocks.filter("__n > 1")
    rows = listed.join(long_.select(*run, "block", "before"), [*run, "block"])
    keys = [*run, "block"]

    def crossing(found: pa.Table) -> pa.Table:
        found = found.sort_by("grp")
        b = _block(found, page_height)
        f = np.unique(b.first[b.first < len(b.grp)])
        f = f[(b.next[f] == len(b.grp)) & (b.reach[f] >= b.bottom[-1])]
        take = found.select(run).take(pa.array(f))
        return take.append_column("start", pa.array(b.grp[f], pa.int32())).append_column("reach", pa.array(b.reach[f], pa.int64()))

    tails = rows.groupBy(*keys).applyInArrow(crossing, f"{_kinds(listed, run)}, start int, reach long")
    # the first block that ends below a page's reach: of all blocks that do, the one seen last from below
    nothing = lambda kind: F.lit(None).cast(kind)
    both = tails.select(*run, "start", "reach", nothing("long").alias("block"), F.lit(0).alias("side")).unionByName(long_.select(*run, nothing("int").alias("start"), F.col("upto").alias("reach"), "block", F.lit(1).alias("side")))
    below = Window.partitionBy(*run).orderBy(F.desc("reach"), "side", F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    aimed = both.withColumn("block", F.when(F.col("side") == 0, F.last("block", True).over(below)).otherwise(F.col("block"))).filter("side = 0 and block is not null").drop("side")

    def land(found: pa.Table, at: pa.Table) -> pa.Table:
        if not at.num_rows or not found.num_rows:
            return at.select([*run, "start"]).slice(0, 0).append_column("entry", pa.array([], pa.int32()))
        b = _block(found.sort_by("grp"), page_height)
        where = np.searchsorted(b.bottom, at["reach"].to_numpy(), "right")
        return at.select([*run, "start"]).append_column("entry", pa.array(b.grp[where], pa.int32()))

    landed = kept(rows.groupBy(*keys).cogroup(aimed.groupBy(*keys)).applyInArrow(land, f"{_kinds(listed, run)}, start int, entry int"))
    # where a page may be the first to begin in a block
    entries = landed.select(*run, "entry").unionByName(long_.select(*run, F.col("first").alias("entry"))).distinct()
    entries = entries.withColumn("block", F.floor(F.col("entry") / block))

    def leave(found: pa.Table, at: pa.Table) -> pa.Table:
        out = []
        if found.num_rows:
            b = _block(found.sort_by("grp"), page_height)
            for e in at["entry"].to_pylist():
                starts = b.starts(int(np.searchsorted(b.grp, e)))
                out.append((e, *b.leaves(starts[-1]), len(starts) - 1))
        take = found.select(keys).take(pa.array(np.zeros(len(out), np.int64)))
        for name, kind, k in (("entry", pa.int32(), 0), ("kind", pa.int32(), 1), ("start", pa.int32(), 2), ("reach", pa.int64(), 3), ("pages", pa.int32(), 4)):
            take = take.append_column(name, pa.array([x[k] for x in out], kind))
        return take

    left = kept(rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(leave, f"{_kinds(listed, keys)}, entry int, kind int, start int, reach long, pages int"))
    ways = left.join(landed.withColumnRenamed("entry", "to"), [*run, "start"], "left").join(long_.select(*keys, "ahead"), keys)
    to = F.when(F.col("kind") == CROSSES, F.col("to")).otherwise(F.col("ahead"))
    hops = kept(ways.select(*run, F.col("entry").alias("at"), to.alias("to"), (F.col("pages") + F.when(F.col("kind") == OPEN, 0).otherwise(1)).alias("pages")).filter(F.col("to").isNotNull()))
    reached = kept(long_.groupBy(*run).agg(F.min("first").alias("at")).withColumn("page", F.lit(1)))
    while not hops.isEmpty():
        more = reached.join(hops, [*run, "at"]).select(*run, F.col("to").alias("at"), (F.col("page") + F.col("pages")).alias("page"))
        onward = hops.select(*run, F.col("at").alias("to"), F.col("to").alias("__to"), F.col("pages").alias("__pages"))
        new = kept(reached.unionByName(more).distinct()), kept(hops.join(onward, [*run, "to"]).select(*run, "at", F.col("__to").alias("to"), (F.col("pages") + F.col("__pages")).alias("pages")))
        release(reached, hops)
        reached, hops = new
    # each block: the page that goes on into it, and the first that begins in it
    ends = reached.withColumnRenamed("at", "entry").join(left, [*run, "entry"]).select(*keys, "entry", F.col("page").alias("first_page"), (F.col("page") + F.col("pages")).alias("last_page"), (F.col("reach") - page_height).alias("base"))
    earlier = Window.partitionBy(*run).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    given = long_.select(*keys, "before").join(ends, keys, "left").withColumns({"into": F.last("last_page", True).over(earlier), "into_base": F.last("base", True).over(earlier)})
    given = given.select(*keys, "before", "entry", "first_page", "into", "into_base")

    def lay(found: pa.Table) -> pa.Table:
        found = found.sort_by("grp")
        b = _block(found, page_height)
        n = len(b.grp)
        page, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
        entry = found["entry"][0].as_py()
        first = n if entry is None else int(np.searchsorted(b.grp, entry))
        if first:
            page[:first], top[:first] = found["into"][0].as_py(), b.bottom[:first] - b.height[:first] - found["into_base"][0].as_py()
        if first < n:
            starts = b.starts(first)
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], n])):
                f = min(int(b.first[s]), n - 1)
                base = b.bottom[f] - b.height[f]
                page[s:e] = found["first_page"][0].as_py() + k
                top[s:e] = np.where(np.arange(s, e) <= b.first[s], 0, b.bottom[s:e] - b.height[s:e] - base)
        return found.select([*run, "grp"]).append_column("page", pa.array(page, pa.int32())).append_column("top", pa.array(top, pa.int32()))

    placed = listed.join(given, keys).groupBy(*keys).applyInArrow(lay, out)
    return short.unionByName(placed)
