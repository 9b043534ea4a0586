"""A topic model over rule hits and word weights, with its confidence, and duels of topics that it can't tell apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, IndexToString, PolynomialExpansion, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as tx

_FEATURES = 1 << 12


def _with_hits(rows: DataFrame, patterns: list[str], text: str) -> DataFrame:
    clean = tx.token_text(F.col(text))
    return rows.withColumn("__text", clean).withColumns({f"__hit{k}": F.col("__text").rlike(p).cast("double") for k, p in enumerate(patterns)})


def fit_topics(rows: DataFrame, patterns: list[str], text: str = "text", label: str = "topic", bound: int = 100_000) -> PipelineModel:
    """A multinomial logistic model of pattern hits and hashed tf-idf words, fitted on at most ``bound`` labelled rows chosen by hash."""
    some = rows.filter(F.col(label).isNotNull()).orderBy(F.xxhash64(text, label)).limit(bound)
    stages = [
        StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=_FEATURES),
        IDF(inputCol="__tf", outputCol="__idf"),
        VectorAssembler(inputCols=[*(f"__hit{k}" for k in range(len(patterns))), "__idf"], outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__raw", regParam=0.01, maxIter=30),
    ]
    model = Pipeline(stages=stages).fit(_with_hits(some, patterns, text))
    names = IndexToString(inputCol="__p", outputCol="__topic", labels=model.stages[0].labels)
    return PipelineModel([*model.stages[1:], names])


def predicted_topics(rows: DataFrame, model: PipelineModel, patterns: list[str], text: str = "text", least: float = 0.0) -> DataFrame:
    """Adds ``topic`` and ``confidence``; the topic is null for a blank text or under ``least``."""
    names = [c for c in rows.columns if c not in ("topic", "confidence")]
    out = model.transform(_with_hits(rows.select(*names), patterns, text)).withColumn("confidence", F.array_max(vector_to_array("__prob")))
    known = (F.trim("__text") != "") & (F.col("confidence") >= least)
    return out.select(*names, F.when(known, F.col("__topic")).alias("topic"), F.when(F.trim("__text") != "", F.col("confidence")).otherwise(0.0).alias("confidence"))


@dataclass(frozen=True)
class Duels:
    """Binary models of pairs of topics, by the pair in order; the second topic is 1."""

    models: dict[tuple[str, str], LogisticRegressionModel]


def _ranked(rows: DataFrame, model: PipelineModel, patterns: list[str], text: str) -> DataFrame:
    """Predictions with the two likeliest topics, as ``__one``, ``__two`` (p, topic), and the features of a duel: all of the model's and products of two hits."""
    out = model.transform(_with_hits(rows, patterns, text))
    names = F.array(*map(F.lit, model.stages[-1].getLabels()))
    order = F.reverse(F.array_sort(F.zip_with(vector_to_array("__prob"), names, lambda p, t: F.struct(p.alias("p"), t.alias("topic")))))
    out = out.withColumns({"__one": order[0], "__two": F.get(order, F.lit(1))})
    if not patterns:
        return out.withColumn("__duel", F.col("__features"))
    hits = VectorAssembler(inputCols=[f"__hit{k}" for k in range(len(patterns))], outputCol="__hits").transform(out)
    products = PolynomialExpansion(degree=2, inputCol="__hits", outputCol="__products").transform(hits)
    return VectorAssembler(inputCols=["__features", "__products"], outputCol="__duel").transform(products)


def fit_duels(rows: DataFrame, model: PipelineModel, patterns: list[str], text: str = "text", label: str = "topic", close: float = 0.3, least: int = 20, most: int = 10, bound: int = 100_000) -> Duels:
    """A model of its own for each of the ``most`` pairs of topics that are the likeliest two, by less than ``close`` apart, of at least ``least`` labelled rows.

    At most ``bound`` labelled rows are used, chosen by hash.
    """
    some = rows.filter(F.col(label).isNotNull()).orderBy(F.xxhash64(text, label)).limit(bound)
    seen = _ranked(some.withColumnRenamed(label, "__known"), model, patterns, text).filter("__two is not null")
    a, b = F.least("__one.topic", "__two.topic"), F.greatest("__one.topic", "__two.topic")
    pairs = seen.filter(F.col("__one.p") - F.col("__two.p") < close).groupBy(a.alias("a"), b.alias("b")).count().filter(F.col("count") >= least).orderBy(F.desc("count"), "a", "b").limit(most).collect()
    fitted = {}
    for r in pairs:
        own = seen.filter(F.col("__known").isin(r.a, r.b)).withColumn("__second", (F.col("__known") == r.b).cast("double"))
        if own.select("__second").distinct().count() == 2:
            fit = LogisticRegression(featuresCol="__duel", labelCol="__second", predictionCol="__dp", probabilityCol="__dprob", rawPredictionCol="__draw", regParam=0.01, maxIter=50)
            fitted[r.a, r.b] = fit.fit(own.select("__duel", "__second"))
    return Duels(fitted)


def decided_topics(rows: DataFrame, model: PipelineModel, duels: Duels, patterns: list[str], text: str = "text", least: float = 0.0, sure: float = 0.6) -> DataFrame:
    """``predicted_topics``, where a duel of the two likeliest topics decides if its winner has more than ``sure``; the confidence is the mean of both then."""
    names = [c for c in rows.columns if c not in ("topic", "confidence")]
    out = _ranked(rows.select(*names), model, patterns, text)
    pair = F.concat_ws("\x1f", F.least("__one.topic", "__two.topic"), F.greatest("__one.topic", "__two.topic"))
    out = out.withColumn("__pair", F.when(F.col("__two").isNotNull(), pair))
    keys = ["\x1f".join(p) for p in duels.models]
    base = out.filter(F.col("__pair").isNull() | ~F.col("__pair").isin(*keys)) if keys else out
    done = base.select(*names, "__text", F.col("__one.topic").alias("__t"), F.col("__one.p").alias("__c"))
    for (a, b), duel in duels.models.items():
        some = duel.transform(out.filter(F.col("__pair") == "\x1f".join((a, b))))
        second = vector_to_array("__dprob")[1]
        won = F.greatest(second, 1 - second)
        topic = F.when(won > sure, F.when(second >= 0.5, b).otherwise(a)).otherwise(F.col("__one.topic"))
        done = done.unionByName(some.select(*names, "__text", topic.alias("__t"), F.when(won > sure, (F.col("__one.p") + won) / 2).otherwise(F.col("__one.p")).alias("__c")))
    known = (F.trim("__text") != "") & (F.col("__c") >= least)
    return done.select(*names, F.when(known, F.col("__t")).alias("topic"), F.when(F.trim("__text") != "", F.col("__c")).otherwise(0.0).alias("confidence"))
