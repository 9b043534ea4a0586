"""Keyword search and weighted rule classification over texts."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import search_form
from quillmark.operators.patterns import matched, ordered_sum

#: No letter, digit or underscore of any script: what parts words in every engine alike.
_EDGE = r"[^\p{L}\p{N}_]"


@dataclass(frozen=True)
class Keyword:
    """One search term; ``exact`` is a whole word, else a substring without regard to spaces."""

    term: str
    exact: bool

    @staticmethod
    def parse(raw: str) -> Keyword | None:
        """A quoted term of two or more characters is exact; blank ones are none."""
        term = raw.strip()
        if len(term) >= 2 and term[0] == term[-1] == '"':
            return Keyword(term[1:-1], True) if term[1:-1].strip() else None
        return Keyword(term, False) if term else None


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def matches(text: Column, keyword: Keyword) -> Column:
    if keyword.exact:
        return F.coalesce(text, F.lit("")).rlike(f"(?iu)(^|{_EDGE}){_quoted(keyword.term)}({_EDGE}|$)")
    return F.contains(search_form(F.coalesce(text, F.lit(""))), F.lit(keyword.term.lower().replace(" ", "")))


def keyword_hits(texts: DataFrame, keywords: list[str], key: str, text: str) -> DataFrame:
    """(keyword, key) of each hit; a scan with one condition per keyword, no join.

    Keywords are parameters, so their number is bounded; a term given twice counts once.
    """
    found = {raw: k for raw in keywords if (k := Keyword.parse(raw))}
    if not found:
        return texts.select(F.lit("").alias("keyword"), F.col(key)).limit(0)
    flags = F.array_compact(F.array(*[F.when(matches(F.col(text), k), F.lit(raw)) for raw, k in found.items()]))
    return texts.select(key, F.explode(flags).alias("keyword"))


def question_hits(parts: DataFrame, keywords: list[str], root_text: str = "root_text", text: str = "text") -> DataFrame:
    """(keyword, question_id, label): parts that hold the keyword; a hit in the root text is a hit of all the question's parts.

    A question without parts has none.
    """
    out = None
    for raw in keywords:
        k = Keyword.parse(raw)
        if k is None:
            continue
        some = parts.filter(matches(F.col(text), k) | matches(F.col(root_text), k)).select(F.lit(raw).alias("keyword"), "question_id", "label")
        out = some if out is None else out.unionByName(some)
    return out if out is not None else parts.select(F.lit("").alias("keyword"), "question_id", "label").limit(0)


def snippet(text: Column, term: str, around: int = 60, plain: int = 150) -> Column:
    """Squeezed text around the first hit in brackets; the first ``plain`` characters without one."""
    t = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    at = F.locate(term.lower(), F.lower(t))
    low = F.greatest(F.lit(1), at - around)
    hit = F.concat(F.substring(t, low, at - low), F.lit("["), F.substring(t, at, F.lit(len(term))), F.lit("]"), F.substring(t, at + len(term), F.lit(around)))
    return F.when(at > 0, hit).otherwise(F.substring(t, F.lit(1), F.lit(plain)))


@dataclass(frozen=True)
class Rule:
    topic: str
    pattern: str
    weight: float = 1.0


#: Rules up to this number are conditions of one scan; more go by what they require (``patterns``).  Results are the same.
FEW = 64


def rule_scores(texts: DataFrame, rules: list[Rule], key: str, text: str) -> DataFrame:
    """(key, topic, topic_ord, score) of topics with a score: sums of the weights of the patterns found, each once.

    Rules are parameters.  Keys must not repeat.
    """
    order = {t: k for k, t in enumerate(dict.fromkeys(r.topic for r in rules))}
    if len(rules) > FEW:
        hits = _hits(texts, rules, key, text).groupBy(key, "topic", "topic_ord").agg(F.array_sort(F.collect_list(F.struct("k", "weight"))).alias("h"))
        return hits.select(key, "topic", "topic_ord", ordered_sum(F.transform("h", lambda x: x["weight"])).alias("score")).filter("score > 0")
    by_topic = [
        F.struct(F.lit(t).alias("topic"), F.lit(k).alias("topic_ord"), sum((F.when(F.col(text).rlike(r.pattern), r.weight).otherwise(0.0) for r in rules if r.topic == t), F.lit(0.0)).alias("score"))
        for t, k in order.items()
    ]
    return texts.select(key, F.inline(F.filter(F.array(*by_topic), lambda s: s["score"] > 0)))


def _hits(texts: DataFrame, rules: list[Rule], key: str, text: str) -> DataFrame:
    """(key, k, text, pattern, topic, topic_ord, weight) of the rules that each text matches."""
    order = {t: k for k, t in enumerate(dict.fromkeys(r.topic for r in rules))}
    table = pa.table({"k": pa.array(range(len(rules)), pa.int32()), "topic": [r.topic for r in rules], "topic_ord": pa.array([order[r.topic] for r in rules], pa.int32()), "weight": pa.array([float(r.weight) for r in rules], pa.float64())})
    return matched(texts, [r.pattern for r in rules], key, text).join(F.broadcast(texts.sparkSession.createDataFrame(table)), "k")


def rule_details(texts: DataFrame, rules: list[Rule], key: str, text: str) -> DataFrame:
    """(key, topic, score, matched, margin, tied) of every topic with a score.

    ``matched``: the first 50 characters that each of its patterns finds, in the order of the
    rules; ``margin``: to the best other topic; ``tied``: whether another has the same score.
    Keys must not repeat.
    """
    hits = _hits(texts, rules, key, text).withColumn("found", F.substring(F.expr(f"regexp_extract(`{text}`, pattern, 0)"), 1, 50))
    topics = hits.groupBy(key, "topic").agg(F.array_sort(F.collect_list(F.struct("k", "weight", "found"))).alias("h"))
    scored = topics.select(key, "topic", ordered_sum(F.transform("h", lambda x: x["weight"])).alias("score"), F.array_join(F.transform("h", lambda x: x["found"]), "|").alias("matched")).filter("score > 0")
    out = scored.groupBy(key).agg(F.collect_list(F.struct("topic", "score", "matched")).alias("__t")).select(key, "__t", F.explode("__t").alias("x"))
    others = F.filter("__t", lambda o: o["topic"] != F.col("x.topic"))
    best = F.coalesce(F.array_max(F.transform(others, lambda o: o["score"])), F.lit(0.0))
    return out.select(key, "x.topic", "x.score", "x.matched", (F.col("x.score") - best).alias("margin"), F.exists(others, lambda o: F.abs(o["score"] - F.col("x.score")) < 1e-9).alias("tied"))


def classify(scores: DataFrame, keys: DataFrame, key: str, least: float = 0.7, lead: float = 0.3) -> DataFrame:
    """(key, topic, score, margin, reason): the best topic where it has ``least`` and is ``lead`` ahead.

    Ties keep the order of topics.  Other texts are '00. Unknown'; the reason says why.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "topic_ord")
    best = scores.withColumns({"r": F.row_number().over(w), "second": F.coalesce(F.lead("score").over(w), F.lit(0.0))}).filter("r = 1")
    out = keys.join(best.select(key, "topic", "score", "second"), key, "left")
    margin = F.col("score") - F.col("second")
    good = (F.col("score") >= least) & (margin >= lead - 1e-9)
    reason = F.when(F.col("score").isNull(), "no match").when(F.col("score") < least, "low score").when(margin < lead - 1e-9, "close call").otherwise("ok")
    return out.select(key, F.when(good, F.col("topic")).otherwise("00. Unknown").alias("topic"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(margin, F.lit(0.0)).alias("margin"), reason.alias("reason"))


def pattern_precision(texts: DataFrame, labels: DataFrame, patterns: list[tuple[str, object]], key: str, text: str, label: str, tp_least: int, precision_least: float) -> DataFrame:
    """Per (pattern, wanted label): tp, fp, precision and coverage to three places, and whether to keep it."""
    rows = texts.join(labels.select(key, label), key)
    aggs = []
    for k, (p, want) in enumerate(patterns):
        hit = F.col(text).rlike(p)
        aggs += [F.count_if(hit & (F.col(label) == want)).alias(f"tp{k}"), F.count_if(hit & (F.col(label) != want)).alias(f"fp{k}"), F.count_if(F.col(label) == want).alias(f"n{k}")]
    one = rows.agg(*aggs)
    out = one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(str(want)).alias("wanted"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"n{k}").alias("n")) for k, (p, want) in enumerate(patterns)])))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    return out.select("pattern", "wanted", "tp", "fp", F.round(precision, 3).alias("precision"), F.round(F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), 3).alias("coverage"), ((F.col("tp") >= tp_least) & (precision >= precision_least)).alias("keep"))


def capped(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group; Spark limits groups before the exchange."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def seeded_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """size // strata rows of each stratum (at least one), topped up in seeded order to ``size``.

    Keys must not repeat.  A task passes on the first rows of each stratum and the first of all,
    no more; the rows that top up are among the first ``size`` of all.
    """
    strata = df.select(stratum).distinct().count()
    quota = max(1, size // max(1, strata))
    ordered = df.withColumn("__o", seeded_order(seed, key))
    chosen = capped(ordered, [stratum], ["__o", key], quota).drop("place")
    rest = ordered.orderBy("__o", key).limit(size).join(chosen.select(key), key, "left_anti").select(ordered.columns)
    both = chosen.withColumn("__r", F.lit(0)).unionByName(rest.withColumn("__r", F.lit(1)))
    return both.orderBy("__r", "__o", key).limit(size).drop("__o", "__r")


def new_only(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose keys are not there yet; copies among the candidates stay."""
    return candidates.join(existing.select(*keys).distinct(), keys, "left_anti")
