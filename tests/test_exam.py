"""A build from files to files, archives, free folders and plan pruning."""

from __future__ import annotations

import json
import random
import zipfile

import pytest

from quillmark.operators import exam, selection, selection_pass
from quillmark.sources import archives


def loop(heights, room, spacing, margin):
    page, y, out = 1, 0, []
    for h in heights:
        top = y + spacing if y else 0
        if y and top + h > room:
            page, top = page + 1, 0
        out.append((page, top + margin))
        y = top + h
    return out


def test_a_build_from_files_to_files(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "c.jsonl", "w") as c, open(tmp_path / "in" / "r.json", "w") as r:
        for k in range(40):
            labels = [f"{k}", f"{k}(a)", f"{k}(b)", f"{k}(b)(i)", f"{k}(b)(ii)"]
            leaves = [labels[1], *labels[3:]]
            marks = {x: rng.randint(1, 5) for x in leaves}
            record = {"schema_version": 9, "question_id": f"q{k:02}", "exam_code": "0478", "year": 2020 + k % 3, "paper": 1, "variant": 1, "question_number": k, "total_marks": sum(marks.values()), "part_count": 3, "topic": "01. Loops" if k % 2 else "02. Data", "relative_path": f"q{k}", "child_text": {x: f"text of {x}" + (" magic" if k == 7 and x == labels[1] else "") for x in leaves}, "child_topics": {labels[1]: "02. Data"}}
            c.write(json.dumps(record) + "\n")
            regions = {x: {"bounds": {"top": 100 * n, "bottom": 100 * n + rng.randint(40, 90), "left": 0, "right": 500}, "marks": marks.get(x)} for n, x in enumerate(labels)}
            r.write(json.dumps({"schema_version": 3, "question_id": f"q{k:02}", "regions": regions}) + "\n")
        c.write("no record\n")
    s = exam.Settings(selection_pass.Request(20, 1, 5, "ALL", topics=("01. Loops",)), years=("2020", "2021"), keywords=("magic",), page_height=600, margin_top=50, margin_bottom=100, spacing=10)
    c, r, base = str(tmp_path / "in" / "c.jsonl"), str(tmp_path / "in" / "r.json"), str(tmp_path / "out")
    at, got = exam.exam_from_files(spark, c, r, s, base, "build")
    slices = sorted(got.slices.collect(), key=lambda x: x.place)
    records = {x.record for x in slices}
    assert "q07" in records and all(int(x[1:]) % 3 < 2 for x in records)
    assert 19 <= sum(x.marks for x in slices) <= 21
    assert not any(x.label.endswith("(b)") or "(" not in x.label for x in slices)
    pages = sorted(got.pages.collect(), key=lambda x: x.grp)
    assert [(p.page, p.top) for p in pages] == loop([x.bottom - x.top for x in slices], 450, 10, 50)
    document = json.loads(got.documents.first().json)
    assert document["total_marks"] == sum(x.marks for x in slices) and document["question_count"] == len(records)
    assert at == f"{base}/build"
    (name,) = [x for x in (tmp_path / "out" / "build" / "archives").iterdir() if not x.name.startswith(".")]
    with zipfile.ZipFile(name) as z:
        own = z.namelist()
        assert own[0] == "README.txt" and f"Total marks: {document['total_marks']}" in z.read("README.txt").decode()
        assert [json.loads(z.read(n))["label"] for n in own[1:]] == [x.label for x in slices]
    assert exam.write_exam(got, s, base, "build") == f"{base}/build(1)" and exam.free_folder(spark, base, "build") == f"{base}/build(2)"
    assert exam.free_folder(spark, base, "build", " ({})") == f"{base}/build (1)" and exam.free_folder(spark, base, "else") == f"{base}/else"
    with pytest.raises(exam.BuildError):
        exam.exam_from_files(spark, c, r, exam.Settings(s.request, years=("1999",)), base, "none")
    with pytest.raises(exam.BuildError):
        exam.exam_from_files(spark, c, r, exam.Settings(selection_pass.Request(20, keyword_mode=True), keywords=("nowhere",)), base, "none")


def test_files_are_written_all_or_none(spark, tmp_path):
    rows = [(f"f{k}.zip", archives.zipped([("a", b"1" * k)])) for k in range(20)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    archives.write_files(df, str(tmp_path / "z"))
    assert sorted(x.name for x in (tmp_path / "z").iterdir()) == sorted(n for n, _ in rows)
    assert {(r.archive, r.place, r.entry, bytes(r.content)) for r in archives.entries_of(spark, str(tmp_path / "z")).collect()} == {(n, 0, "a", b"1" * k) for k, (n, _) in enumerate(rows)}
    broken = df.selectExpr("if(name = 'f7.zip', cast(raise_error('no') as string), name) as name", "content")
    with pytest.raises(Exception):
        archives.write_files(broken, str(tmp_path / "y"), "overwrite")
    assert not (tmp_path / "y").exists() or not [x for x in (tmp_path / "y").iterdir() if not x.name.startswith(".")]


@pytest.mark.parametrize("mode, least", [("SKIP", 1), ("SKIP", 3), ("PRUNE", 1), ("PRUNE", 2), ("ALL", 1)])
def test_plans_are_pruned_as_by_a_loop(spark, mode, least):
    rng = random.Random(8)
    plans = {q: [rng.randint(0, 6) for _ in range(rng.randint(1, 7))] for q in range(40)}
    df = spark.createDataFrame([(q, k, m) for q, own in plans.items() for k, m in enumerate(own)], "question_id int, ord int, marks int")
    want = set()
    for q, own in plans.items():
        left = list(enumerate(own))
        while mode != "ALL" and sum(m for _, m in left) > 8 and len(left) > least:
            left.remove(min(left, key=lambda x: x[1]) if mode == "SKIP" else left[-1])
        want |= {(q, k, m) for k, m in left}
    assert {tuple(r) for r in selection.prune_plan(df, 8, mode, least).collect()} == want


def test_question_folders_and_absent_catalogues(spark, tmp_path):
    from quillmark.sources import catalogue_files as cf

    q = spark.createDataFrame([("a", "01. Loops", 3), ("b", "x/y", 1)], "question_id string, topic string, marks int")
    regions = spark.createDataFrame([("a", '{"r":1}')], "question_id string, json string")
    images = spark.createDataFrame([("b", "composite.png", b"png")], "question_id string, file string, content binary")
    cf.write_question_folders(q, regions, str(tmp_path / "q"), images)
    files = {str(p.relative_to(tmp_path / "q")): p.read_bytes() for p in (tmp_path / "q").rglob("*") if p.is_file()}
    assert set(files) == {"01. Loops/a/metadata.json", "01. Loops/a/regions.json", "x_y/b/metadata.json", "x_y/b/composite.png"}
    assert json.loads(files["x_y/b/metadata.json"]) == {"question_id": "b", "topic": "x/y", "marks": 1} and files["01. Loops/a/regions.json"] == b'{"r":1}'
    gone = str(tmp_path / "none.jsonl")
    assert cf.read_catalogue(spark, gone, absent="none").count() == 0
    with pytest.raises(Exception):
        cf.read_catalogue(spark, gone).count()
