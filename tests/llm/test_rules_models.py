"""op4, op6, op8, op9 and op10: against SQL, plain versions and held-out rows."""

import hashlib
import json
import struct
import zlib

import brute
import pytest
from conftest import frame
from oracle import compare, connect
from pyspark.sql import functions as F

from folioscope.llm import chat_tools, language_id, media_columns, quality_classifier, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    assert compare(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) is None


def test_rules_on_odd_texts(odd, odd_rows, empty):
    docs = odd.withColumns({"n_words": F.lit("mine"), "_lines": F.lit(0)})
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, text in odd_rows:
        n, *rest = brute.rule_counts(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest), text
        assert r["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["failed_rules"] == [])
    assert quality_rules.judged(empty).count() == 0


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [("a", "user", '{"text":"long enough to be a question","turn":1}', None), ("b", "user", '{"turn":"x","text":"short"}', "a"), ("c", "system", '{"text":"s","extra":2}', "b"), ("d", "system", "{broken", "gone"), ("e", "nobody", "{}", "c"), ("x", "system", '{"text":"s"}', "y"), ("y", "system", '{"text":"s"}', "x"), (None, "user", "{}", None), ("a", "user", '{"text":"zzz"}', None), ("f", None, None, None)]
    results = [("a", "answer"), ("a", "another"), ("b", None), ("nowhere", "lost"), (None, "lost")]
    df = chat_tools.linked(spark.createDataFrame(calls, "call_id string, name string, arguments string, needs string"), spark.createDataFrame(results, "call_id string, content string"))
    got = {r["call_id"]: r for r in df.collect()}
    assert set(got) == set("abcdefxy")
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3, "f": 0, "x": None, "y": None}
    assert got["a"]["valid"] and got["a"]["result"] == "another"
    assert got["b"]["errors"] == ["short:text", "type:turn"] and got["c"]["errors"] == ["unknown:extra"]
    assert got["d"]["errors"] == ["malformed"] and got["e"]["errors"] == ["unknown tool"]
    for r in got.values():
        line = json.loads(r["canonical"])
        assert r["canonical"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat_tools.linked(spark.createDataFrame([], "call_id string, name string, arguments string, needs string"), spark.createDataFrame([], "call_id string, content string")).count() == 0


def test_long_chain_of_calls(spark):
    calls = spark.range(300).select(F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("needs"))
    assert {int(r[0]): r[1] for r in chat_tools.levels(calls).collect()} == {k: k for k in range(300)}


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.queries()["op6_language_id"](spark, sf_dir).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    learned = {r["lang"] for r in got if not r["held_out"]}
    right = total = 0
    for r in got:
        assert r["held_out"] == (brute.fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (not letters or r["lang_pred"] in learned)
        if r["held_out"] and letters and r["lang"]:
            total += 1
            right += r["lang_pred"] == r["lang"]
    assert right >= 0.9 * total


def test_languages_of_odd_texts(odd, odd_rows, empty):
    model = language_id.fit(odd.where("lang is not null"))
    got = {r["doc_id"]: r for r in language_id.predicted(odd, model).collect()}
    for i, text in odd_rows:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predicted(odd, none).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality_held_out(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = queries.queries()["op9_quality_classifier"](spark, at).collect()
    assert all(r["held_out"] == (brute.fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert auc(held) > 0.85


def test_quality_of_odd_texts(spark, odd, empty):
    labels = odd.select("doc_id", F.when(F.length("text") > 100, 1).otherwise(0).alias("quality"))
    model = quality_classifier.fit(odd, labels.union(labels).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")))
    rows = quality_classifier.scored(odd, model).join(odd.select("doc_id", "text"), "doc_id").collect()
    by = {}
    assert all(by.setdefault(r["text"], r["score"]) == r["score"] for r in rows)
    none = quality_classifier.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality_classifier.scored(odd, none).collect()} == {0.5}
    assert quality_classifier.scored(empty, model).count() == 0


def test_media_query(spark, sf_dir, some_rows):
    by = {}
    text = dict(some_rows)
    got = queries.queries()["op8_media_columns"](spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]


def test_media_are_read_back_and_carved(spark, odd, odd_rows):
    cells = media_columns.sniffed(media_columns.store_media(odd), payload=True).collect()
    text = dict(odd_rows)
    for r in cells:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["payload"] == raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["parts"][0]["offset"] == 0 and r["parts"][0]["length"] == len(r["media"])
        assert r["corrected"] == (r["declared"] != r["detected"])
    payload = bytes(range(256))
    inner = [media_columns.stored(payload, k) for k in media_columns.STORED]
    cell = b"junk BM RIFF \xff\xd8\xff" + b"xx".join(inner) + b"\x89PNG\r\n\x1a\n broken"
    rows = [(1, cell, "png", "mine"), (2, None, None, "x"), (3, b"", "wav", "x"), (4, inner[0][:-1], "wav", "x")]
    got = {r["id"]: r for r in media_columns.sniffed(spark.createDataFrame(rows, "id long, media binary, declared string, detected string")).collect()}
    assert [p["format"] for p in got[1]["parts"]] == list(media_columns.STORED)
    assert [cell[p["offset"] : p["offset"] + p["length"]] for p in got[1]["parts"]] == inner
    assert all(got[k]["parts"] == [] and got[k]["detected"] is None for k in (2, 3, 4))
    assert struct.unpack("<I", inner[0][40:44])[0] == 256
