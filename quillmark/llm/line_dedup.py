"""Line deduplication by overlapping three-line windows (operator 7); SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import forget, free_name, sized, table, written

WINDOW = 3


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key as ``doc_id``, sorted array ``drop`` of line numbers from 0) of documents that lose lines.

    Lines that hold only white space are passed over; every ``window`` consecutive others
    make a window, known by the MD5 of its lines.  Of a window that occurs more than once
    anywhere, the occurrence with the smallest (doc_id, line) stays, a null doc_id coming
    first; the lines of all others are covered, and overlapping covers merge.  Windows are
    counted before they are joined, so a window that a third of the documents share is one
    row of the counts; on the windows' side of that join Spark splits its partition.  Rows with the same doc_id and text are the same place: none removes the other.
    """
    lines = docs.select(F.col(key).alias("doc_id"), _lines(F.col(text)).alias("line"))
    # (number, digest) of each line with something in it
    full = lines.select(
        "doc_id",
        F.filter(
            F.transform("line", lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
            lambda s: F.length(F.trim(F.translate(s["line"], "\t\r\x0b\x0c", "    "))) > 0,
        ).alias("own"),
    ).filter(F.size("own") >= window)
    windows = full.select(
        "doc_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("own") - (window - 1)),
                lambda i: F.struct(
                    F.unhex(F.md5(F.concat_ws("\n", *[F.element_at("own", i.cast("int") + k)["line"] for k in range(window)]))).alias("digest"),
                    F.array(*[F.element_at("own", i.cast("int") + k)["at"] for k in range(window)]).alias("covers"),
                ),
            )
        ).alias("w", "x"),
    ).select("doc_id", "x.digest", "x.covers")
    windows = written(windows, "windows")
    first = (
        windows.groupBy("digest")
        .agg(F.min(F.struct("doc_id", F.col("covers")[0].alias("at"))).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    later = windows.join(first, "digest").filter(~F.struct("doc_id", F.col("covers")[0].alias("at")).eqNullSafe(F.col("first")))
    out = later.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("drop"))
    out.quillmark_path = windows.quillmark_path  # for forget()
    return out


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, the covered lines gone from ``text``, with ``n_lines`` and ``n_dropped``.

    ``n_lines`` counts the lines before (0 for a null text, which stays null; an empty text
    has one empty line).  A document whose lines all go has an empty text.  Columns named
    n_lines or n_dropped are replaced.  An empty table gives no rows.
    """
    found = repeated_lines(docs, key, text, window)
    drops = written(found, "drops")
    forget(found)
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own, gone, line = (free_name(c, docs.columns) for c in ("own_key", "gone", "line"))
    d = sized(drops).select(F.col("doc_id").alias(own), F.col("drop").alias(gone))
    joined = docs.select(*rest).join(d, F.col(key).eqNullSafe(F.col(own)), "left").withColumn(line, _lines(F.col(text)))
    # positions that stay, by a hash set; the lines themselves are looked up by position
    stay = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(line, i + 1)), "\n")
    return joined.select(
        *[F.when(F.col(gone).isNull() | F.col(text).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in rest],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(line)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, and the remaining text's length and MD5."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_left"), F.md5("text").alias("text_md5"))


#: The kept-text relation, shared with the pipeline's SQL: documents(doc_id, text) -> deduped(doc_id, n_lines, n_dropped, text).
DEDUP_SQL = """
lines AS (
  SELECT doc_id, text, line, pos FROM (
    SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents)
), solid AS (
  SELECT doc_id, pos, line,
         lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3,
         lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3
  FROM lines WHERE length(trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '))) > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, pos, pos2, pos3, md5(line || chr(10) || line2 || chr(10) || line3) AS digest
  FROM solid WHERE line3 IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS FIRST, pos) AS nth FROM windows
), covered AS (
  SELECT doc_id, pos FROM ranked WHERE nth > 1
  UNION SELECT doc_id, pos2 FROM ranked WHERE nth > 1
  UNION SELECT doc_id, pos3 FROM ranked WHERE nth > 1
), deduped AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
  GROUP BY l.doc_id
)
"""

SQL = {
    "op7_line_dedup": f"""
WITH {DEDUP_SQL}
SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS BIGINT) AS n_left, md5(text) AS text_md5 FROM deduped
"""
}
