"""op6 and op9 against plain versions of their scoring, one text at a time, with the tables that they learned."""

import math
import re
from bisect import bisect_right

import numpy as np
import pytest

from folioscope.llm import language_id, quality_classifier
from folioscope.llm.quality_rules import STOP_WORDS, SYMBOLS


def plain_language(text, model):
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    folded = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in text.encode()]
    counts = {}
    for k in (1, 2, 3):
        for i in range(len(folded) - k + 1):
            gram = folded[i : i + k]
            if (k == 1 and gram[0] == 32) or any(a == b == 32 for a, b in zip(gram, gram[1:])):
                continue
            code = 0
            for c in gram:
                code = code << 8 | c
            at = ((code + (k << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
            counts[at] = counts.get(at, 0) + 1
    x = {at: math.log1p(n) * float(model["idf"][at]) for at, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in x.values()))
    near = [sum(w * float(c[at]) for at, w in x.items()) / norm if norm else 0.0 for c in model["c"]]
    best = max(range(len(near)), key=lambda i: near[i])
    return model["langs"][model["of"][best]], min(1.0, max(0.0, near[best]))


def test_languages_equal_a_plain_nearest_centroid(spark, sf_dir, odd, odd_rows, some_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.where("lang is not null").select("doc_id", "lang", "text"), per_language=40)
    for df, rows in ((odd, odd_rows), (docs, some_rows)):
        text = dict(rows)
        for r in language_id.predicted(df.select("doc_id", "text"), model).collect():
            lang, score = plain_language(text[r["doc_id"]], model)
            assert r["score"] == pytest.approx(score, abs=2e-5)
            assert r["lang_pred"] == lang or abs(score - r["score"]) < 2e-5 and lang != "und" != r["lang_pred"]


def plain_features(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    low = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
    n, chars = max(1, len(words)), sum(map(len, words))
    count = lambda test: sum(map(test, raw))
    symbols, marks = count(lambda c: c in SYMBOLS.encode()), count(lambda c: c in b"!?")
    upper, digits, lower, wide = count(lambda c: 65 <= c <= 90), count(lambda c: 48 <= c <= 57), count(lambda c: 97 <= c <= 122), count(lambda c: c >= 128)
    grams = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    stops = {w.encode() for w in STOP_WORDS}
    shout = sum(2 * sum(65 <= c <= 90 for c in w) > len(w) for w in words)
    return [math.log1p(len(words)), chars / n, symbols / n, marks / n, upper / max(1, upper + lower), digits / max(1, chars), (chars - symbols - marks - upper - digits - lower - wide) / n, wide / max(1, chars), len(words) / (raw.count(b"\n") + 1), sum(w in stops for w in low) / n, len(set(low)) / n, (len(grams) - len(set(grams))) / n, shout / n, sum(len(w) > 20 for w in words) / n]


def plain_score(x, model):
    f = model["base"]
    for value, edges, table in zip(x, model["edges"], model["tables"]):
        f += table[bisect_right(edges.tolist(), value)]
    for i, j, table in model["pairs"]:
        f += table[bisect_right(model["coarse"][i].tolist(), x[i])][bisect_right(model["coarse"][j].tolist(), x[j])]
    return 1 / (1 + math.exp(-f))


def test_quality_equals_plain_table_lookups(spark, sf_dir, odd, odd_rows, some_rows):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    for df, rows in ((odd, odd_rows), (docs, some_rows)):
        text = dict(rows)
        for r in quality_classifier.scored(df.select("doc_id", "text"), model).collect():
            x = plain_features(text[r["doc_id"]])
            own = quality_classifier.features(np.frombuffer((text[r["doc_id"]] or "").encode(), np.uint8), np.array([0, len((text[r["doc_id"]] or "").encode())]))[0]
            assert own.tolist() == pytest.approx(x, rel=1e-9)
            assert r["score"] == pytest.approx(plain_score(own.tolist(), model), abs=1e-9)
