"""op3 and op7 against plain versions, and their edge cases."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import TEXTS, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import packing, queries, session, source_mixing


def check_mix(rows):
    """rows: (size, source, source_size, target, taken)"""
    sizes = Counter()
    for size, source, *_ in rows:
        sizes[source] += size
    want = brute.targets(sizes)
    taken = Counter()
    for size, source, source_size, target, got in rows:
        assert source_size == sizes[source]
        assert target == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        assert got <= 2 * size and (size == 0 or got % size == 0)
        taken[source] += got
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.01 * target + 1, source


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.001"])
def test_mix_query(spark, sf_dir):
    some_rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.queries()["op3_source_mixing"](spark, sf_dir)
    source = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    got = df.collect()
    text = dict(some_rows)
    assert len(got) == len(text) and all(r["size"] == len(brute.words(text[r["doc_id"]])) for r in got)
    check_mix([(r["size"], source[r["doc_id"]], r["source_size"], r["target"], r["taken"]) for r in got])
    again = queries.queries()["op3_source_mixing"](spark, sf_dir).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_odd_texts_and_clashing_columns(odd):
    docs = odd.withColumns({"size": F.lit("mine"), "copies": F.lit(1), "rank": F.lit(2), "weight": F.lit(3), "_b": F.lit(4)})
    got = source_mixing.mixed(docs).select("size", "source", "source_size", "target", "taken").collect()
    assert len(got) == len(TEXTS)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = brute.targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"]


CLASHES = ("_key", "_salt", "_s", "_h", "_b", "upto", "picks", "twice", "base", "shard_of", "_rest", "c0", "a.dot", "Rank")


def test_clashing_names_pass_through_the_mix(odd):
    docs = odd.withColumns({**{c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES}, "Size": F.lit("mine"), "shards": F.lit("mine"), "copy": F.lit("mine")})
    plain = {repr(r) for r in source_mixing.mixed(odd).select("doc_id", "size", "taken", "shards").collect()}
    got = source_mixing.mixed(docs)
    assert [c for c in got.columns if c in CLASHES] == list(CLASHES) and "Size" not in got.columns
    rows = got.collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in CLASHES)
    assert {r["copy"] for r in rows} == {"mine"} and {repr(r) for r in got.select("doc_id", "size", "taken", "shards").collect()} == plain
    copies = source_mixing.mixed_copies(docs)
    rows = copies.collect()
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in CLASHES)
    assert {r["shards"] for r in rows} == {"mine"} and {r["copy"] for r in rows} <= {0, 1}
    keys = [repr(tuple(r)) for r in copies.select("doc_id", "taken", "copy", "shard", "order_key").collect()]
    assert sorted(keys) == sorted(repr(tuple(r)) for r in source_mixing.mixed_copies(odd).select("doc_id", "taken", "copy", "shard", "order_key").collect())


@pytest.mark.parametrize("most", [10, 0])
def test_small_joins_keep_clashing_names(spark, most):
    big = spark.createDataFrame([(1, None, 5, 6, 7), (2, "a", 8, 9, 10)], "id long, k string, _key int, _salt int, _s int")
    small = spark.createDataFrame([("a", 3), (None, 4)], "k string, __key int")
    got = session.join_small(big, small, "k", "id", most=most)
    assert sorted(map(tuple, got.select("id", "_key", "_salt", "_s", "__key").collect())) == [(1, 5, 6, 7, 4), (2, 8, 9, 10, 3)]


def test_mix_of_one_source_and_of_nothing(spark, empty):
    got = source_mixing.mixed(frame(spark, [(k, "a b c d") for k in range(50)]).withColumn("source", F.lit("s"))).collect()
    assert {r["target"] for r in got} == {300.0} and sum(r["taken"] for r in got) == 300
    assert source_mixing.mixed(empty).count() == 0
    assert source_mixing.mixed(frame(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([([900, 0, 37, 1],)], "quotas array<int>")
    leaves = np.array([r["quotas"] for r in source_mixing.split_quotas(quotas, 3, 1).collect()])
    assert leaves.shape == (8, 4) and leaves.sum(axis=0).tolist() == [900, 0, 37, 1]
    assert leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 1
    assert leaves[:, 0].min() > 90


def test_copies_fill_disjoint_shards(odd, tmp_path):
    copies = source_mixing.mixed_copies(odd)
    assert copies.where("shard is null").count() == 0
    assert copies.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    source_mixing.write_shards(copies, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == copies.count()


def tokens(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(got, docs, capacity=2048):
    ids = {i: [*x, 0] for (i, _), x in zip(docs, tokens([t for _, t in docs]))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0, *[n for _, _, n in own[:-1]]]).tolist()
        assert sum(n for _, _, n in own) == len(ids[i])
        assert all(n == capacity for _, _, n in own[1:]) and (len(own) == 1) == (len(ids[i]) <= capacity)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(map(len, ids.values()))
    return len(sequences), total / capacity


def test_packing_query(spark, sf_dir, some_rows):
    n, least = check_packing(queries.queries()["op7_best_fit_packing"](spark, sf_dir).collect(), some_rows)
    assert n <= 1.03 * least + 2


def test_packing_odd_texts(odd, odd_rows, empty):
    check_packing(packing.pack_documents(odd).collect(), odd_rows)
    check_packing(packing.pack_documents(odd, capacity=64).collect(), odd_rows, 64)
    assert packing.pack_documents(empty).count() == 0


def test_added_tokens_in_texts(spark, tmp_path):
    texts = ["<|endoftext|> in text", "a <|endoftext|><|endoftext|>  b 's<|endoftext|>s ", "cut <|endoftext", "plain  text", None]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = queries.queries()["op7_best_fit_packing"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_packing_repeated_rows(spark):
    got = packing.pack_documents(frame(spark, [(5, "a b")] * 4)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_plan_uses_up_the_histogram():
    counts = np.bincount(np.random.default_rng(1).geometric(0.004, 30_000).clip(1, 2048), minlength=2049)
    plan = packing.planned(counts)
    used = np.zeros(2049, int)
    for bag, repeats in plan:
        assert sum(v * m for v, m in bag) <= 2048
        for v, m in bag:
            used[v] += m * repeats
    assert (used == counts).all()
    assert sum(r for _, r in plan) <= 1.01 * np.ceil((counts * np.arange(2049)).sum() / 2048)
