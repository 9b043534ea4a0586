"""Sinks over folders, and the topic model on held-out texts."""

from __future__ import annotations

import json
import random

from quillmark.operators import topic_model
from quillmark.sources import catalogue_files as cf


def test_question_folders_and_documents(spark, tmp_path):
    q = spark.createDataFrame([("a", "0478", 3), ("b", "0455", 1)], "question_id string, exam_code string, marks int")
    p = spark.createDataFrame([("a", "1(b)", 2), ("a", "1(a)", 1)], "question_id string, label string, marks int")
    cf.write_questions(q, p, str(tmp_path / "q"))
    back = {r.question_id: r for r in spark.read.json(str(tmp_path / "q")).collect()}
    assert [x.label for x in back["a"].parts] == ["1(a)", "1(b)"] and back["b"].parts is None
    assert sorted(x.name for x in (tmp_path / "q").iterdir() if x.is_dir()) == ["exam_code=0455", "exam_code=0478"]
    cf.write_document(spark, str(tmp_path / "m"), {"b": "é", "a": [1, 2]})
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert json.loads(line) == {"a": [1, 2], "b": "é"}


def test_upsert_of_a_folder(spark, tmp_path):
    at, schema = str(tmp_path / "u"), "k string, v int"
    cf.upsert_file(spark, spark.createDataFrame([("a", 1), ("b", 2)], schema), at, "k")
    cf.upsert_file(spark, spark.createDataFrame([("b", 5), ("c", 6)], schema), at, "k")
    assert sorted((r.k, r.v) for r in spark.read.json(at).collect()) == [("a", 1), ("b", 5), ("c", 6)]
    assert [x.name for x in tmp_path.iterdir() if x.is_dir()] == ["u"]


def test_topic_model_on_held_out_texts(spark):
    rng = random.Random(4)
    words = {"01. Loops": "while repeat until counter loop".split(), "02. Data": "binary hexadecimal byte bit register".split(), "03. Nets": "router packet address protocol cable".split()}
    common = "the of a question explain state value give two and".split()
    rows = [(k, " ".join(rng.choice(words[t]) if rng.random() < 0.25 else rng.choice(common) for _ in range(20)), t) for k, t in enumerate(rng.choices(list(words), k=600))]
    df = spark.createDataFrame(rows, "id int, text string, topic string")
    patterns = [r"\b(?:while|loop)", r"\b(?:byte|bit)\b", r"\bpackets?\b"]
    model = topic_model.fit_topics(df.filter("id < 400"), patterns)
    got = topic_model.predicted_topics(df.filter("id >= 400").withColumnRenamed("topic", "wanted"), model, patterns).collect()
    assert sum(r.topic == r.wanted for r in got) >= 0.95 * len(got) and all(1 / 3 <= r.confidence <= 1 for r in got)
    blank = spark.createDataFrame([(1, " "), (2, None)], "id int, text string")
    assert [(r.topic, r.confidence) for r in topic_model.predicted_topics(blank, model, patterns).collect()] == [(None, 0.0), (None, 0.0)]


def test_duels_tell_topics_apart_that_differ_in_pairs_of_words(spark):
    """Two topics with the same words: both or none of two in one, exactly one in the other; no weight of single words tells."""
    rng = random.Random(7)
    common = "the of a question explain state value give two and".split()
    rows = []
    for k in range(1500):
        topic = rng.choice(["01. Loops", "02. Data", "03. Nets"])
        words = [rng.choice(common) for _ in range(8)]
        if topic == "03. Nets":
            words += ["router"] * 2
        else:
            first = rng.random() < 0.5
            words += ["while"] * first + ["byte"] * (first if topic == "01. Loops" else not first)
        rng.shuffle(words)
        rows.append((k, " ".join(words), topic))
    df = spark.createDataFrame(rows, "id int, text string, topic string").cache()
    patterns = ["while", "byte", "router"]
    fit, held = df.filter("id < 1000"), df.filter("id >= 1000").withColumnRenamed("topic", "wanted")
    model = topic_model.fit_topics(fit, patterns)
    duels = topic_model.fit_duels(fit, model, patterns)
    assert list(duels.models) == [("01. Loops", "02. Data")]
    base = topic_model.predicted_topics(held, model, patterns).collect()
    got = topic_model.decided_topics(held, model, duels, patterns).collect()
    right = lambda found: sum(r.topic == r.wanted for r in found) / len(found)
    assert len(got) == len(base) and right(base) < 0.8 and right(got) > 0.97
    none = topic_model.decided_topics(held, model, topic_model.Duels({}), patterns).collect()
    assert {(r.id, r.topic) for r in none} == {(r.id, r.topic) for r in base}
    df.unpersist()


def test_gap_sessions_of_a_stream(spark, tmp_path):
    from quillmark.streaming import ingest

    at = tmp_path / "in"
    at.mkdir()
    (at / "a.json").write_text("\n".join(json.dumps({"u": u, "t": f"2024-01-01T{h:02}:{m:02}:00"}) for u, h, m in [(1, 1, 0), (1, 1, 20), (1, 3, 0), (2, 1, 0)]))
    (at / "b.json").write_text(json.dumps({"u": 9, "t": "2024-01-09T00:00:00"}))
    (at / "c.json").write_text(json.dumps({"u": 9, "t": "2024-01-19T00:00:00"}))
    stream = spark.readStream.schema("u int, t timestamp").option("maxFilesPerTrigger", 1).json(str(at))
    q = ingest.gap_sessions(stream, "u", "t", "30 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.u, r.n) for r in spark.sql("select u, n from sessions where u < 9").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_patterns_that_do_not_compile_are_left_out(spark):
    from quillmark.operators import topics

    good, bad = [".*?", "a+", r"\*", r"\(", "(a|b)", "[ab]*", "x??"], ["*a", "a**", "(a", "[a", "+"]
    rows = [("t", k, p, k % 2 == 0, None) for k, p in enumerate(good + bad)]
    out = topics.weighted_patterns(spark.createDataFrame(rows, "topic string, ord int, pattern string, weighted boolean, weight double")).collect()
    assert sorted(r.pattern for r in out) == sorted(good) and {r.weight for r in out} == {1.0, None}
