"""op1, op2 and op5 against plain versions, and their edge cases."""

import random

import brute
import numpy as np
import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join, queries, sketches, substring_dedup, suffix_dedup
from folioscope.llm.components import components


def ids_of(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


@pytest.mark.parametrize("name, plain", [("op1_suffix_dedup", brute.byte_dedup), ("op2_substring_dedup", brute.word_dedup), ("op5_jaccard_join", brute.jaccard_components)])
def test_query_equals_plain(spark, sf_dir, some_rows, name, plain):
    df = queries.queries()[name](spark, sf_dir)
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == plain(some_rows)


def test_bytes_on_odd_texts(odd, odd_rows):
    got = ids_of(suffix_dedup.dedup_bytes(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.byte_dedup(odd_rows)


def test_words_on_odd_texts(odd, odd_rows):
    got = ids_of(substring_dedup.dedup_words(odd), "n_words", "n_removed", "kept_sha256")
    assert got == brute.word_dedup(odd_rows)


def test_links_on_odd_texts(odd, odd_rows):
    assert ids_of(jaccard_join.near_duplicates(odd), "n_shingles", "component_id") == brute.jaccard_components(odd_rows)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_links_at_other_thresholds(odd, odd_rows, percent):
    got = ids_of(jaccard_join.near_duplicates(odd, percent=percent), "n_shingles", "component_id")
    assert got == brute.jaccard_components(odd_rows, percent)


@pytest.mark.parametrize("rate", [1 / 16, 1 / 33])
def test_tasks_follow_the_input_beyond_the_sketch(spark, monkeypatch, rate):
    docs = spark.createDataFrame([("a",)], "text string")
    monkeypatch.setattr(sketches.F, "octet_length", lambda column: F.lit(1 << 34))
    bits, tasks = sketches.sketch_bits(docs, rate, 30)
    monkeypatch.setattr(sketches.F, "octet_length", lambda column: F.lit(1 << 36))
    assert bits == 30 and sketches.sketch_bits(docs, rate, 30) == (30, 4 * tasks)


def test_runs_fit_beside_their_place():
    n = (1 << 24) + 5
    at, lengths = substring_dedup._runs(np.full(n + 3, 7), np.r_[np.arange(n), n + 10 + np.arange(3)])
    assert at.tolist() == [0, (1 << 24) - 1, n] and lengths.tolist() == [(1 << 24) - 1, 6, 3]


@pytest.mark.parametrize("find", [suffix_dedup.repeated_runs, substring_dedup.repeated_starts])
def test_one_row_of_spans_for_each_text(odd, find):
    """However many tasks find spans of a text, they are united in one row."""
    assert find(odd).groupBy("doc_id", "row").count().where("count > 1").count() == 0


@given(st.lists(st.tuples(st.integers(-2, 2), st.integers(0, 1), st.integers(0, 30), st.integers(1, 6)), min_size=1, max_size=40), st.integers(1, 3))
def test_packed_spans_are_united(found, parts):
    ids, rows, at, lengths = np.array(found).T
    some = [(x[0], x[1], x[2] << 24 | x[3]) for x in (np.stack([ids, rows, at, lengths])[:, k::2] for k in (0, 1)) if x.size]
    packed = sketches.packed_spans(some, parts)
    assert packed.num_rows <= parts
    got = []
    for blob in packed.column("spans"):
        i, r, pairs = sketches.united(*np.frombuffer(blob.as_py(), "<i8").reshape(3, -1))
        got += list(zip(i.tolist(), r.tolist(), *pairs.T.tolist(), strict=True))
    covered = {(i, r, k) for i, r, a, n in found for k in range(a, a + n)}
    assert sorted((i, r, k) for i, r, a, b in got for k in range(a, b)) == sorted(covered)
    assert all((i, r, b) not in covered for i, r, _, b in got)


def test_links_of_rows_alone_in_salt_zero(spark, monkeypatch):
    """Pairs that share hot keys only, one of the two being the single row of salt 0."""
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    salt = F.pmod(F.xxhash64(F.col("id")), F.lit(jaccard_join.SALTS))
    ids = spark.range(4000).select("id", salt.alias("salt"))
    zero = [r["id"] for r in ids.where("salt = 0").orderBy("id").limit(20).collect()]
    other = [r["id"] for r in ids.where("salt > 0").orderBy("id").limit(20).collect()]
    rows = []
    for k, (a, b) in enumerate(zip(zero, other, strict=True)):
        words = [f"p{k}w{j}" for j in range(60)]
        rows += [(a, " ".join(words)), (b, " ".join([*words, "end"]))]
    got = ids_of(jaccard_join.near_duplicates(frame(spark, rows)), "n_shingles", "component_id")
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize("make", [suffix_dedup.dedup_bytes, substring_dedup.dedup_words, jaccard_join.near_duplicates])
def test_empty_table(empty, make):
    assert make(empty).count() == 0


def test_clashing_columns_and_repeated_and_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text), (2, None)]
    docs = frame(spark, rows).withColumns({"n_removed": F.lit("mine"), "bucket": F.lit(1), "span": F.lit(2)})
    for made, n in ((suffix_dedup.dedup_bytes(docs), len(text)), (substring_dedup.dedup_words(docs), 40)):
        got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in made.collect())
        assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (2, n)]
        assert {"bucket", "span"} <= set(made.columns)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [(0, 36, 0), (1, 36, 1), (1, 36, 1), (2, 0, 2), (2, 36, 1)]


def test_different_texts_under_one_id(spark):
    """What one row of an id loses, another row of it keeps."""
    text, own = (" ".join(f"{w}{k}" for k in range(40)) for w in "tu")
    docs = frame(spark, [(1, text), (2, text), (2, own), (2, own), (3, own + " " + own)]).withColumns({c: F.lit("mine") for c in ("_doc", "_spans", "_row", "row", "key", "_key")})
    for made, n, m in ((suffix_dedup.dedup_bytes(docs), len(text), 2 * len(own) + 1), (substring_dedup.dedup_words(docs), 40, 80)):
        got = sorted((r["doc_id"], r["n_removed"]) for r in made.collect())
        lost = m if n == 40 else 2 * len(own)
        assert got == [(1, 0), (2, 0), (2, 0), (2, n), (3, lost)]
        assert all(r["_doc"] == r["_spans"] == r["_row"] == "mine" for r in made.select("_doc", "_spans", "_row").collect())
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 1)]


def test_a_text_longer_than_a_chunk(spark):
    """A text of over 1 MiB is read whole: its end repeats in a later document."""
    long = " ".join(f"w{k}" for k in range(190_000))
    rows = [(1, long), (2, "own words here " + long[-5000:]), (3, long)]
    assert len(long) > 1 << 20
    assert ids_of(suffix_dedup.dedup_bytes(frame(spark, rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_dedup(rows)
    assert ids_of(substring_dedup.dedup_words(frame(spark, rows)), "n_words", "n_removed", "kept_sha256") == brute.word_dedup(rows)
    assert ids_of(jaccard_join.near_duplicates(frame(spark, rows)), "n_shingles", "component_id") == brute.jaccard_components(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Tiles are dealt into blocks, and rounds of meetings end before all links are found."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    r = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in r.sample(range(120), r.randint(1, 9)):
            words[j] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    assert ids_of(jaccard_join.near_duplicates(frame(spark, rows)), "n_shingles", "component_id") == brute.jaccard_components(rows)


def test_rows_that_no_tile_can_pair_go(spark):
    """Of 100 elements, a shorter partner shares one of its first eleven; key 1 has such a row, key 2 hasn't, key 3 has one component, key 4 a size apart."""
    rows = [(1, 1, 100, 10, 1), (1, 2, 100, 15, 2), (2, 3, 100, 15, 3), (2, 4, 100, 16, 4), (3, 5, 100, 1, 5), (3, 6, 100, 2, 5), (4, 7, 100, 1, 7), (4, 8, 100, 2, 7), (4, 9, 200, 3, 9)]
    got = jaccard_join._several(spark.createDataFrame(rows, "key long, doc_id long, n int, pos int, c long"), 80)
    assert sorted((r["key"], r["doc_id"]) for r in got.collect()) == [(1, 1), (1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=8), st.integers(1, 5))
def test_merged_transforms_find_repeats(texts, shards):
    width = 22
    raw = [t.encode() for t in texts]
    strings = np.frombuffer(b"".join(raw), np.uint8)
    lengths, owners = np.array([len(r) for r in raw]), np.arange(len(raw))
    got = suffix_dedup.repeated_in(strings, lengths, owners, width, shards)
    first = {}
    want = []
    for i, r in enumerate(raw):
        for k in range(len(r)):
            full = k + width <= len(r)
            want.append(full and first.setdefault(r[k : k + width], i) < i)
    assert got.tolist() == want


def test_a_shard_is_sorted_four_times(monkeypatch):
    """Eight bytes first, then doubled to 64; the same order as by all the bytes around."""
    rng, sorts, plain = np.random.default_rng(3), [], np.argsort
    text = rng.integers(97, 100, 60 * 20).astype(np.uint8)
    begin, size = np.repeat(np.arange(20) * 60, 60), np.full(1200, 60)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    order, before = suffix_dedup.shard_transform(text, begin, size, 50)
    around = lambda i, n: bytes(text[begin[i] + (i - begin[i] + np.arange(n)) % 60])
    assert len(sorts) == 4 and [around(i, 64) for i in order] == sorted(around(i, 64) for i in range(1200))
    assert all(int(b).to_bytes(2, "big") == around(i, 60)[-2:] for i, b in zip(order, before, strict=True))


def test_common_prefixes_of_merged_transforms():
    strings = [b"banana", b"bandana", b"cabana"]
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    size = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(size) - size
    begin, whole = np.repeat(starts, size), np.repeat(size, size)
    parts, places = [], []
    for s, n in zip(starts, size):
        order, before = suffix_dedup.shard_transform(text[s : s + n], begin[s : s + n] - s, whole[s : s + n], 6)
        parts.append(before)
        places.append(order + s)
    shard, block, common = suffix_dedup.merged_transforms(parts, 6)
    at = np.empty(len(text), int)
    for k, order in enumerate(places):
        at[shard == k] = order
    around = [bytes(text[b + (i - b + j) % n] for j in range(6)) for i, b, n in zip(at, begin[at], whole[at])]
    assert around == sorted(around)
    for k in range(1, len(around)):
        shared = next((j for j in range(6) if around[k][j] != around[k - 1][j]), 6)
        assert common[k] == shared // 2 * 2
        assert (block[k] == block[k - 1]) == (shared == 6)


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[100 + k] == 100 for k in range(1, 50)) and got[300] == 200
