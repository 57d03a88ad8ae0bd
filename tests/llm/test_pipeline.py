"""Each stage of the pipeline against a plain version of it, on its own input."""

from collections import Counter

import brute
import corpus_pipeline
from conftest import frame
from pyspark.sql import functions as F


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            after = [tuple(r) for r in out.select("doc_id", "text", "source").collect()]
        if name == "quality rules":
            base = lambda t: (c := brute.rule_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]
            assert {i for i, _, _ in after} <= {i for i, t, _ in before if not base(t)} and len(after) > len(before) // 3
        elif name == "near duplicates":
            parts = brute.jaccard_components([(i, t) for i, t, _ in before])
            assert {i for i, _, _ in after} == {c for _, c in parts.values()}
        elif name == "substring dedup":
            want = brute.word_dedup([(i, t) for i, t, _ in before])
            assert {i for i, _, _ in after} == {i for i, w in want.items() if w[1] < w[0]}
            text = {i: t for i, t, _ in before}
            assert all(len(brute.words(t)) == want[i][0] - want[i][1] and (want[i][1] or t == text[i]) for i, t, _ in after)
        elif name == "source mixing":
            copies = Counter(i for i, _, _ in after)
            assert set(copies) <= {i for i, _, _ in before} and max(copies.values()) <= 2
            sizes, taken = Counter(), Counter()
            for i, t, s in before:
                sizes[s] += len(brute.words(t))
                taken[s] += len(brute.words(t)) * copies[i]
            far = [s for s, want in brute.targets(sizes).items() if abs(taken[s] - want) > 0.02 * want + 20]
        else:
            seen, rows = Counter(), []
            for i, t, _ in before:
                seen[i] += 1
                rows.append((i, t))
            got = out.collect()
            assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
            assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == seen
            once = {i: t for i, t in rows if seen[i] == 1}
            assert once
        docs = out
    assert not far


def clashing(docs):
    names = ("n_words", "n_removed", "kept_text", "kept", "_h", "_b", "_all", "_rest", "copies", "shards", "size", "component_id", "length", "piece", "row")
    return docs.withColumns({c: F.lit(f"my {c}") for c in names}), names


def test_stages_on_odd_rows_and_clashing_columns(spark, odd, odd_rows, some_rows):
    good = [(1000 + i, t) for i, t in some_rows[:40]]  # the odd texts alone all fail the rules
    docs, names = clashing(odd.unionByName(frame(spark, good)))
    text = dict(odd_rows) | dict(good)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"my {c}" for r in rows for c in names), name
        if name != "substring dedup":
            assert all(r["text"] == text[r["doc_id"]] for r in rows), name
    packed = corpus_pipeline.STAGES[-1][1](docs.sparkSession, odd, "").collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in odd_rows}


def test_stages_on_an_empty_table(empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(empty.sparkSession, empty, "").count() == 0, name


def test_rows_of_no_id(spark):
    docs = frame(spark, [(None, "some words " * 3), (None, None), (1, "other words entirely in this one, which has its own content and more than ten")])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert {r["doc_id"] for r in stage(spark, docs, "").collect()} >= {1}, name


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
