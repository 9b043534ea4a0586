"""Placing assets on pages, and the monotone sequence of question numbers."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.numbering import before, ranged, with_earlier
from quillmark.operators.pagination import paginate  # noqa: F401
from quillmark.operators.storage import kept


def atomic_groups(assets: DataFrame, run: list[str], sticky: Column, question: str = "question_id", order: tuple[str, ...] = ("ord",), number: str | None = None) -> DataFrame:
    """Numbers groups that must not be parted: a sticky asset (header, context) goes with the next of its question.

    ``number`` names a column for each asset's place in its run.  Windows go over ranges of a run:
    a range's first asset is held against the last of the range before.
    """
    at = ranged(assets.withColumn("__sticky", sticky), run, [*order])
    last = F.struct("__sticky", F.col(question).alias("question"))
    ends = at.groupBy(*run, "__range").agg(F.max_by(last, F.struct(*order)).alias("__last"))
    at = with_earlier(at, ends, run, {"__earlier": F.lag("__last").over(Window.partitionBy(*run).orderBy("__range"))})
    w = Window.partitionBy("__range", *run).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = at.withColumn("__before", F.coalesce(F.lag(last).over(w), F.col("__earlier")))
    joined = F.coalesce(F.col("__before.__sticky"), F.lit(False)) & (F.col(question) == F.col("__before.question"))
    rows = rows.withColumn("__new", F.when(joined, 0).otherwise(1)).withColumns({"__grp": F.sum("__new").over(upto), "__place": F.count("*").over(upto)})
    rows = kept(rows.drop("__sticky", "__earlier", "__before", "__new"))
    sizes = rows.groupBy(*run, "__range").agg(F.max("__grp").alias("__groups"), F.count("*").alias("__assets"))
    ahead = Window.partitionBy(*run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_earlier(rows, sizes, run, {"__groups_ahead": F.sum("__groups").over(ahead), "__ahead": F.sum("__assets").over(ahead)})
    out = rows.withColumn("grp", F.col("__grp") + F.coalesce("__groups_ahead", F.lit(0)))
    if number:
        out = out.withColumn(number, (F.col("__place") + F.coalesce("__ahead", F.lit(0))).cast("int"))
    return out.drop("__range", "__grp", "__place", "__groups_ahead", "__ahead")


def question_pages(placed: DataFrame, run: list[str], question: str = "question_id") -> DataFrame:
    """Distinct pages of each question, in order, comma-joined."""
    return placed.groupBy(*run, question).agg(F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


def resolved_sequence(candidates: DataFrame, document: str, number: str, order: list[str], ident: str, pseudo: str | None = None, real: str | None = None) -> DataFrame:
    """(document, n, id, pos): question numbers in reading order, one loop per document.

    Behind the last one taken, the next expected number is looked for; where it does not come any
    more, the next candidate whose number is not taken yet goes on.  Of those with the expected
    number, real positions (column ``real``) and then others than pseudo code (``pseudo``) go first.
    Null numbers are left out.
    """
    code = F.coalesce(F.col(pseudo), F.lit(False)) if pseudo else F.lit(False)
    placed = F.coalesce(F.col(real), F.lit(True)) if real else F.lit(True)
    listed = candidates.filter(F.col(number).isNotNull()).select(F.col(document).alias("__d"), F.struct(*order, F.col(number).cast("int").alias("n"), F.col(ident).alias("id")).alias("__o"), code.alias("__p"), placed.alias("__r"))
    ordered = listed.groupBy("__d").agg(F.array_sort(F.collect_list(F.struct("__o", "__p", "__r"))).alias("c"))
    rows = ordered.select("__d", F.transform("c", lambda x: x["__o"]["n"]).alias("n"), F.transform("c", lambda x: x["__o"]["id"]).alias("id"), F.transform("c", lambda x: x["__p"]).alias("p"), F.transform("c", lambda x: x["__r"]).alias("r"))

    def run(batches):
        for b in batches:
            docs, ns, out, at = [], [], [], []
            for k, (n, i, p, r) in enumerate(zip(b["n"].to_pylist(), b["id"].to_pylist(), b["p"].to_pylist(), b["r"].to_pylist())):
                for pos, j in enumerate(resolved(n, p, r)):
                    docs.append(k)
                    ns.append(n[j])
                    out.append(i[j])
                    at.append(pos + 1)
            yield pa.RecordBatch.from_arrays([b["__d"].take(pa.array(docs, pa.int64())), pa.array(ns, pa.int32()), pa.array(out, b["id"].type.value_type), pa.array(at, pa.int32())], names=["document", "n", "id", "pos"])

    kind = candidates.schema
    found = rows.mapInArrow(run, f"document {kind[document].dataType.simpleString()}, n int, id {kind[ident].dataType.simpleString()}, pos int")
    return found.withColumnRenamed("document", document)


def resolved(number: list[int], pseudo: list[bool], real: list[bool]) -> list[int]:
    """Places of the candidates taken, of candidates in reading order."""
    places: dict[int, list[int]] = {}
    for k, n in enumerate(number):
        places.setdefault(n, []).append(k)
    taken, seen, behind, wanted = [], set(), 0, 1
    while True:
        best = None
        same = places.get(wanted, [])
        for k in same[bisect_left(same, behind) :]:
            if best is None:
                best = k
            elif not real[best] and real[k]:
                best = k
            elif pseudo[best] and not pseudo[k]:
                best = k
                break
            else:
                continue
            if real[best] and not pseudo[best]:
                break
        if best is None:
            best = next((k for k in range(behind, len(number)) if number[k] not in seen), None)
            if best is None:
                return taken
        taken.append(best)
        seen.add(number[best])
        behind, wanted = best + 1, number[best] + 1


def composite_offsets(segments: DataFrame, run: list[str], order: str | list[str], height: str, number: str | None = None) -> DataFrame:
    """Where each stitched segment begins: the sum of the heights before it. ``number`` names a column for its place in the run."""
    order = [order] if isinstance(order, str) else order
    out = before(segments, run, order, {"y_offset": F.col(height), **({number: F.lit(1)} if number else {})})
    return out.withColumn(number, (F.col(number) + 1).cast("int")) if number else out
