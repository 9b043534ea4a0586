"""Assessment views over the star schema: questions, parts, detections, issues.

Every view is a plan over Parquet scans; nothing is cached or collected.  The matching CTEs
for the SQL oracle are below, side by side with the views they mirror.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.storage import kept, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, exam_code, year, paper, variant, topic."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.lpad((F.col("o_custkey") % 5).cast("string"), 4, "0").alias("exam_code"),
        F.year("o_orderdate").alias("year"),
        (1 + F.col("o_custkey") % 9).cast("int").alias("paper"),
        (1 + F.col("o_orderkey") % 9).cast("int").alias("variant"),
        F.col("o_orderpriority").alias("topic"),
    )


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place in the order, ``ord``, and the sum of quantities up to it, ``y``."""
    li = table(spark, sf_dir, "lineitem")
    by_question = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return li.withColumn("ord", F.row_number().over(by_question)).withColumn("y", F.sum(F.col("l_quantity").cast("long")).over(by_question.rowsBetween(Window.unboundedPreceding, 0)))


def leaf_label(question: Column, ord_: Column) -> Column:
    return F.concat(question.cast("string"), F.lit("("), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ord_, F.lit(1)), F.lit(")"))


def _leaves(rows: DataFrame, p: DataFrame) -> DataFrame:
    return rows.join(p.select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("question_id"),
        "ord",
        leaf_label(F.col("l_orderkey"), F.col("ord")).alias("label"),
        (1 + F.col("l_quantity").cast("int") % 6).alias("marks"),
        F.when(F.col("l_returnflag") != "N", F.col("p_type")).alias("topic"),
        (F.col("l_linestatus") == "O").alias("is_valid"),
        F.col("p_name").alias("name"),
        "y",
        F.col("l_extendedprice").alias("price"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves: question_id, ord (from 1), label, marks, topic (null: unknown), is_valid, name, y (top), price."""
    return _leaves(_lines(spark, sf_dir), table(spark, sf_dir, "part"))


_LINE_OF = {"marks": "l_quantity", "topic": "l_returnflag", "is_valid": "l_linestatus", "price": "l_extendedprice"}


def kept_parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of ``parts`` as a table, written in two steps: the shuffle that numbers a question's lines is gone before that by part begins."""
    lines = kept(_lines(spark, sf_dir).select("l_orderkey", "l_partkey", "ord", *[_LINE_OF[c] for c in columns if c in _LINE_OF], *(["y"] if "y" in columns else [])))
    # columns that nothing asks for are never read
    rows = lines.withColumns({c: F.lit(None).cast(t) for c, t in (("l_quantity", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_extendedprice", "double"), ("y", "long")) if c not in lines.columns})
    out = kept(_leaves(rows, table(spark, sf_dir, "part")).select(*columns))
    release(lines)
    return out


QUESTIONS_SQL = """
questions AS (
  SELECT o_orderkey AS question_id, lpad(CAST(o_custkey % 5 AS VARCHAR), 4, '0') AS exam_code,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(1 + o_custkey % 9 AS INTEGER) AS paper,
         CAST(1 + o_orderkey % 9 AS INTEGER) AS variant, o_orderpriority AS topic
  FROM orders)
"""

PARTS_SQL = """
numbered AS (
  SELECT *, row_number() OVER w AS ord, sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS y
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
), parts AS (
  SELECT l_orderkey AS question_id, CAST(ord AS INTEGER) AS ord,
         CAST(l_orderkey AS VARCHAR) || '(' || substr('abcdefghijklmnopqrstuvwxyz', CAST(ord AS INTEGER), 1) || ')' AS label,
         CAST(1 + CAST(l_quantity AS INTEGER) % 6 AS INTEGER) AS marks,
         CASE WHEN l_returnflag <> 'N' THEN p_type END AS topic, l_linestatus = 'O' AS is_valid,
         p_name AS name, CAST(y AS BIGINT) AS y, l_extendedprice AS price
  FROM numbered JOIN part ON l_partkey = p_partkey)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and timings: user_id as document, y = seconds since the month's start, value, event_type."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", F.unix_timestamp("ts").alias("at"), "ts")


EVENTS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, props, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_, ts FROM events)
"""
