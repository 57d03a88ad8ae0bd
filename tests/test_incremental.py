"""Listings without content, and rebuilds that touch only what changed."""

import os
from pathlib import Path

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from folioscope import registry
from folioscope.sources import files, incremental
from folioscope.sources.incremental import BUCKET, SOURCE, STEPS, Step


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def contents(folder):
    """{partition of a table: its data files with their times}."""
    return {str(p.relative_to(folder)): {(f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")} for p in Path(folder).glob("*/bucket=*")}


def texts(spark, folder):
    df = files.html_files(spark, str(folder), 1)
    return df.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("doc_id"), F.col("html").alias("text")).withColumn(BUCKET, incremental.bucket_of("doc_id"))


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "in"
    for k in range(12):
        (folder / f"d{k % 3}").mkdir(parents=True, exist_ok=True)
        (folder / f"d{k % 3}/p{k}.html").write_text(f"line {k}\n\nmore words {'x ' * k}")
    return folder


def test_listing_reads_no_content_and_gives_relative_paths(spark, pages):
    found = incremental.listing(spark, str(pages), "*.html")
    assert {r["path"]: r["size"] for r in found.collect()} == {str(p.relative_to(pages)): p.stat().st_size for p in pages.rglob("*.html")}
    assert "content:" not in found._jdf.queryExecution().executedPlan().toString()


def test_changes_by_time_or_size(spark):
    a = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 1, 5), ("n", None, None)], "path string, modified long, size long")
    b = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 6), ("e", 1, 5), ("n", None, None)], a.schema)
    assert dict(rows(incremental.changes(a, b))) == {"a": "same", "b": "changed", "c": "changed", "d": "deleted", "e": "new", "n": "same"}
    assert rows(incremental.changes(a.limit(0), a.limit(0))) == []


def test_dependents_are_closed_and_in_order():
    assert incremental.dependents(STEPS, ["profiles"]) == ["profiles", "documents"]
    assert incremental.dependents(STEPS, ["documents"]) == ["documents"]
    assert incremental.dependents(STEPS, ["lines"]) == ["lines", "profiles", "documents"]
    assert incremental.dependents([Step("x", (SOURCE,), None), Step("y", (SOURCE,), None)], ["y"]) == ["y"]
    with pytest.raises(ValueError, match="nothing"):
        incremental.dependents(STEPS, ["nothing"])


def test_one_changed_file_rewrites_one_partition_of_each_table(spark, pages, tmp_path):
    out, full = str(tmp_path / "out"), str(tmp_path / "full")
    before = spark.createDataFrame(incremental.listing(spark, str(pages)).collect(), "path string, modified timestamp, size long")
    incremental.build(texts(spark, pages), out, STEPS)
    old = contents(out)
    changed = pages / "d1/p4.html"
    changed.write_text("quite another text")
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    found = incremental.changes(before, incremental.listing(spark, str(pages)))
    assert [tuple(r) for r in found.where("change <> 'same'").collect()] == [("d1/p4.html", "changed")]
    touched = incremental.touched_buckets(found)
    assert len(touched) == 1
    assert incremental.rebuild(texts(spark, pages), out, STEPS, touched) == ["lines", "profiles", "documents"]
    new = contents(out)
    assert {p for p in new if new[p] != old.get(p)} == {f"{s.name}/bucket={touched[0]}" for s in STEPS}
    incremental.build(texts(spark, pages), full, STEPS)
    for s in STEPS:
        assert rows(incremental.stored(spark, out, s.name)) == rows(incremental.stored(spark, full, s.name))
    assert incremental.rebuild(texts(spark, pages), out, STEPS, []) == [] and contents(out) == new


def test_deleted_files_leave_no_row_and_the_schema_stays(spark, pages, tmp_path):
    out = str(tmp_path / "out")
    incremental.build(texts(spark, pages), out, STEPS)
    gone = pages / "d0/p3.html"
    bucket = texts(spark, pages).where("doc_id = 'd0/p3.html'").first()[BUCKET]
    gone.unlink()
    incremental.rebuild(texts(spark, pages), out, STEPS, [bucket])
    assert {r[0] for r in incremental.stored(spark, out, "documents").select("doc_id").collect()} == {str(p.relative_to(pages)) for p in pages.rglob("*.html")}
    none = texts(spark, pages).limit(0)
    incremental.rebuild(none, out, STEPS)
    assert all(incremental.stored(spark, out, s.name).count() == 0 for s in STEPS)
    assert "words" in incremental.stored(spark, out, "lines").columns


def test_only_the_tables_asked_for_and_their_dependents(spark, pages, tmp_path):
    out = str(tmp_path / "out")
    incremental.build(texts(spark, pages), out, STEPS)
    old = contents(out)
    assert incremental.rebuild(texts(spark, pages), out, STEPS, only=["profiles"]) == ["profiles", "documents"]
    new = contents(out)
    assert {p.split("/")[0] for p in new if new[p] != old[p]} == {"profiles", "documents"}


@pytest.mark.parametrize("name", ["listing_changes", "incremental_profiles"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert compare(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name]) is None
