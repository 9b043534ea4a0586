"""Question numbers, pseudo code, text spans and page groups: what is read off a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.cells import by_cells

#: Words that mark a line as pseudo code (fixed values).
KEYWORDS = ("DECLARE", "INPUT", "OUTPUT", "FOR", "NEXT", "WHILE", "UNTIL", "CASE", "ELSE", "ENDIF", "END IF", "ELSEIF", "THEN")


def looks_like_code(text: Column, only_span: Column) -> Column:
    """Whether a line looks like pseudo code; ``only_span`` is the text of its one span, null where it has several.

    A leading number is passed over.  Keywords are upper case; so are assignments' names.
    """
    body = F.regexp_replace(F.trim(text), r"^\d+\s+", "")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    short = (words <= 2) & ~body.rlike(r"[.?:;]") & ~body.rlike(r"(?i)\bquestion\b") & body.rlike(r"\p{L}")
    span = F.trim(only_span)
    shout = (F.upper(span) == span) & (F.lower(span) != span)
    return (
        body.rlike(r"\b(?:" + "|".join(KEYWORDS) + r")\b") | F.contains(body, F.lit("←")) | F.contains(body, F.lit(":=")) | body.rlike(r"(?i)^(?:IF |ELSE|END|REPEAT|UNTIL)")
        | body.rlike(r"^[A-Z]\w*\s*<-\s*") | short | F.coalesce(shout, F.lit(False))
    )


def page_clip(x0: Column, x1: Column, sidebar: float, least: float = 0.4) -> tuple[Column, Column]:
    """Left and right edge of a page without its side bars; the whole page where less than ``least`` of it would be left."""
    width = x1 - x0
    left, right = x0 + width * sidebar, x1 - width * sidebar
    narrow = right - left < width * least
    return F.when(narrow, x0).otherwise(left), F.when(narrow, x1).otherwise(right)


def question_numbers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, n, x, y, text, code): numbers at the left margin, and 'question N' in a page's text at y = 0 where no line has N.

    lines: doc, page, x0, y0, text, only_span; pages: doc, page, width, height, plain.  Lines with
    four dots or more, right of 12 % of the width or below 92 % of the height don't count.
    """
    n = F.regexp_extract("text", r"^([1-9]\d?)(?:\s|$|\()", 1)
    own = lines.withColumn("text", F.trim("text")).join(pages.select("doc", "page", "width", "height"), ["doc", "page"])
    own = own.filter((n != "") & (F.regexp_count("text", F.lit(r"\.")) < 4) & (F.col("x0") <= F.col("width") * 0.12) & (F.col("y0") <= F.col("height") * 0.92))
    found = own.select("doc", "page", n.try_cast("int").alias("n"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"), "text", looks_like_code(F.col("text"), F.col("only_span")).alias("code"))
    named = pages.select("doc", "page", F.explode(F.regexp_extract_all("plain", F.lit(r"(?i)\bquestion\s*(\d{1,2})\b"), 1)).alias("n")).select("doc", "page", F.col("n").cast("int").alias("n"))
    more = named.join(found.select("doc", "page", "n").distinct(), ["doc", "page", "n"], "left_anti")
    return found.unionByName(more.select("doc", "page", "n", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.concat(F.lit("Question "), F.col("n").cast("string")).alias("text"), F.lit(False).alias("code")))


def char_box(chars: Column) -> Column:
    """Least left and top, greatest right and bottom of an array of boxes; null for none."""
    edge = lambda pick, name: pick(F.transform(chars, lambda c: c[name])).alias(name)
    return F.when(F.size(chars) > 0, F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")))


def numeral_box(chars: Column, numeral: Column) -> Column:
    """The box of the first characters, blanks passed over, where they spell the numeral; else null.

    chars: array of structs c, x0, y0, x1, y1.
    """
    own = F.slice(F.filter(chars, lambda c: F.trim(c["c"]) != ""), F.lit(1), F.length(numeral))
    return F.when(F.array_join(F.transform(own, lambda c: c["c"]), "") == numeral, char_box(own))


def best_candidates(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order): of each group in order the first one, unless a later one is better.

    A real place beats one at y = 0; what is not pseudo code beats what is.  The search ends
    with the first that is both, or that is the better by the second rule.
    """
    listed = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, (F.col("y") > 0).alias("real"), "code"))).alias("c"))
    known = lambda x, done: F.struct(x[order].alias("k"), x["real"].alias("real"), x["code"].alias("code"), done.alias("done"))

    def step(a, x):
        return (
            F.when(a["done"], a)
            .when(~a["real"] & x["real"], known(x, ~x["code"]))
            .when(a["code"] & ~x["code"], known(x, F.lit(True)))
            .otherwise(a)
        )

    first = F.element_at("c", 1)
    best = F.aggregate(F.slice("c", F.lit(2), F.size("c")), known(first, first["real"] & ~first["code"]), step)
    return listed.select(*keys, best["k"].alias(order))


def page_groups(parts: DataFrame, key: str, gap: int) -> DataFrame:
    """Adds ``page_group`` from 0: a part begins a new one where its top is over ``gap`` below the bottom of the one before."""
    w = Window.partitionBy(key).orderBy("top", "ord")
    fresh = F.when(F.col("top") - F.lag("bottom").over(w) > gap, 1).otherwise(0)
    return parts.withColumn("__f", fresh).withColumn("page_group", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def label_edges(labels: DataFrame, key: str, gap: int) -> DataFrame:
    """Adds ``edge``: the least left edge among the labels of the same kind and page, pages parted by gaps in y."""
    w = Window.partitionBy(key, "kind").orderBy("y", "ord")
    fresh = F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)
    paged = labels.withColumn("__f", fresh).withColumn("__p", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return paged.withColumn("edge", F.min("x0").over(Window.partitionBy(key, "kind", "__p"))).drop("__f", "__p")


def page_shift(labels: DataFrame, key: str, page: str) -> DataFrame:
    """(key, page, shift): mean letter x less that of the page before, by romans where a page has no letters, cut to a whole number; else 0."""
    mean = labels.groupBy(key, page).agg(F.avg(F.when(F.col("kind") == "letter", F.col("x0"))).alias("l"), F.avg(F.when(F.col("kind") == "roman", F.col("x0"))).alias("r"))
    w = Window.partitionBy(key).orderBy(page)
    return mean.select(key, page, F.coalesce((F.col("l") - F.lag("l").over(w)).cast("int"), (F.col("r") - F.lag("r").over(w)).cast("int"), F.lit(0)).alias("shift"))


def text_between(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, region, text): text of the spans that overlap each range of y, in order, space-joined.

    spans: key, y0, y1, text, ord; ranges: key, region, top, bottom.
    """
    r = ranges.select(key, "region", "top", "bottom")
    hit = by_cells(r, spans.select(key, "y0", "y1", "text", "ord"), key, "top", "bottom", "y0", "y1")
    hit = hit.filter((F.col("y1") > F.col("top")) & (F.col("y0") < F.col("bottom"))).unionByName(r, allowMissingColumns=True)
    rows = hit.groupBy(key, "region").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("y0", "ord", "text")))).alias("t"))
    return rows.select(key, "region", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def labels_on_pages(pages: DataFrame, labels: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, page, label): the labels of a kind from the top to the bottom of each page, both included."""
    own = labels.filter(F.col("kind") == kind).select(key, "label", "y")
    return by_cells(pages.select(key, "page", "top", "bottom"), own, key, "top", "bottom", "y", "y").select(key, "page", "label")


def scheme_pages(pages: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(key, n, pages): pages of a mark scheme for each known question number, in order.

    A page without numbers goes on with those of the page before.  pages: key, page, tokens array
    of numbers; numbers: key, n.
    """
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = pages.withColumn("tokens", F.last(F.when(F.size("tokens") > 0, F.col("tokens")), True).over(w))
    hit = own.select(key, "page", F.explode("tokens").alias("n")).join(numbers.select(key, "n").distinct(), [key, "n"], "left_semi")
    return hit.groupBy(key, "n").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def content_edges(parts: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, content_right, sub_topics, is_valid, top, bottom) of each question: greatest right edge of its marks, its parts' sub-topics and extent."""
    m = marks.groupBy(key).agg(F.max("right").alias("content_right"))
    p = parts.groupBy(key).agg(F.sort_array(F.collect_set("sub_topic")).alias("sub_topics"), F.bool_and("is_valid").alias("is_valid"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return p.join(m, key, "left")


def span_rows(pages: DataFrame, scale: float, offset: int) -> DataFrame:
    """(doc, page, text, x0, y0, x1, y1) of each line of nested blocks, in whole pixels: not below 0, at least one wide and high.

    pages: doc, page, blocks array of structs with lines array of structs x0, y0, x1, y1, spans
    array of texts.  Lines without text are left out.
    """
    lines = pages.select("doc", "page", F.explode(F.flatten(F.transform("blocks", lambda b: b["lines"]))).alias("l"))
    px = lambda c, add=0: F.greatest(F.lit(0), F.bround(F.col(f"l.{c}") * scale, 0).cast("int") + add)
    rows = lines.select("doc", "page", F.trim(F.array_join("l.spans", "")).alias("text"), px("x0").alias("x0"), px("y0", offset).alias("y0"), px("x1").alias("x1"), px("y1", offset).alias("y1"))
    return rows.filter("text <> ''").withColumn("x1", F.greatest("x1", F.col("x0") + 1)).withColumn("y1", F.greatest("y1", F.col("y0") + 1))
