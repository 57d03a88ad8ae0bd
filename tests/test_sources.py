"""Readers and writers, on small files."""

import json

from pyspark.sql import functions as F

from folioscope.sources import files


def test_shards_with_file_names_and_merged_columns(spark, tmp_path):
    files.write_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string"), str(tmp_path / "x/1"))
    files.write_shards(spark.createDataFrame([(2, 5)], "doc_id long, n long"), str(tmp_path / "x/2"))
    df = files.shards(spark, str(tmp_path / "x"))
    rows = [(r["doc_id"], r["title"], r["n"]) for r in df.collect()]
    assert sorted(df.columns) == ["doc_id", "n", "shard", "title"] and len(rows) == 3
    assert all(r["shard"].endswith(".parquet") for r in df.select("shard").collect())
    newest = files.merged(df, ["doc_id"], ["n"]).collect()
    assert {(r["doc_id"], r["n"]) for r in newest} == {(1, None), (2, 5)}


def test_files_have_at_most_so_many_rows(spark, tmp_path):
    files.write_shards(spark.range(100).coalesce(1), str(tmp_path / "x"), 30)
    assert len(list((tmp_path / "x").glob("*.parquet"))) == 4


def test_pages_encodings_and_sidecars(spark, tmp_path):
    page = "<p>" + "x" * 60 + " – “é”</p>"
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.htm").write_bytes(page.encode())
    (tmp_path / "a/two.html").write_bytes(page.encode("cp1252"))
    (tmp_path / "short.htm").write_text("<p>")
    (tmp_path / "other.txt").write_text(page)
    (tmp_path / "a/one.meta.json").write_text(json.dumps({"cik": "7", "year": 2020}))
    (tmp_path / "a/two.meta.json").write_text("{broken")
    rows = {r["name"]: r for r in files.pages_with_sidecars(spark, str(tmp_path), "cik string, year int").collect()}
    assert set(rows) == {"one", "two"}
    assert rows["one"]["html"] == rows["two"]["html"] == page
    assert (rows["one"]["cik"], rows["one"]["year"], rows["two"]["cik"]) == ("7", 2020, None)


def test_json_lines_and_evidence(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"doc_id": "1", "section_number": "2.01", "score": 0.5}\n{oops\n{"doc_id": "2"}\n')
    broken = files.json_lines(spark, str(tmp_path), "doc_id string").cache()
    assert sorted(r["_broken"] or "" for r in broken.collect()) == ["", "", "{oops"]
    assert {(r["doc_id"], r["status"]) for r in files.evidence(spark, str(tmp_path)).collect()} == {("1", "hit"), ("2", "not_found")}


def test_candidate_lists(spark):
    assert files.candidate_ids("b\n\na\nb\n") == ["b", "a"]
    assert files.candidate_ids('["3", 3, {"doc_id": 4}]') == ["3", "4"]
    assert files.candidate_ids('{"doc_ids": [1, 2]}') == ["1", "2"] and files.candidate_ids('{"candidates": [9]}') == ["9"] and files.candidate_ids("") == []
    assert [r["doc_id"] for r in files.only_candidates(spark.range(5).withColumnRenamed("id", "doc_id"), "3\n77").collect()] == [3]


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, note string")
    files.export_labelled(df, str(tmp_path / "j"))
    files.export_labelled(df, str(tmp_path / "c"), "csv")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()), key=str) == [(1, "a,b"), (2, None)]
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).where("note = 'a,b'").count() == 1


def test_recount_difference_and_manifest(spark):
    parents, children = spark.createDataFrame([(1, 9), (2, 9)], "doc_id long, n long"), spark.createDataFrame([(1,), (1,), (3,)], "doc_id long")
    assert {tuple(r) for r in files.recounted(parents, files.with_parents(children, parents, "doc_id"), "doc_id", "n").collect()} == {(1, 2), (2, 0)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, t string"), spark.createDataFrame([(2, "c"), (3, ""), (4, "d")], "k long, t string")
    assert {tuple(r) for r in files.difference(old, new, "k", "t").collect()} == {(1, "removed"), (2, "changed"), (3, "same"), (4, "added")}
    a = files.manifest({"x": old, "y": new})
    assert {(r["table"], r["same"]) for r in files.compared(a, files.manifest({"x": old.orderBy(F.desc("k")), "y": old})).collect()} == {("x", True), ("y", False)}
