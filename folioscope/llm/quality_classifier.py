"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned; cyclic boosting visits the features in turn and adds a small
step of a shallow tree, fitted on the bins' gradient sums, to that feature's lookup
table. Then the few pairs of features with the largest remaining gain get
two-dimensional tables in the same way. A score is the logistic function of the sum
of one table entry for each feature and pair: vectorised bin additions.

The model learns from at most ``most`` labelled rows, drawn by a hash of doc_id; its
tables are all that is broadcast, a few thousand numbers.

Edge cases: null, empty and blank texts have all-zero features and a score like any
other; equal texts get equal scores; labels repeated for one document count once (the
largest); with no labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .arrowtext import chunks, rolling, text_buffers, word_hashes, word_spans
from .language_id import fold
from .quality_rules import STOP_WORDS, SYMBOLS

FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "other_ascii", "non_ascii", "line_words", "stop_words", "distinct_words", "repeats", "upper_words", "long_words")
_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, [ord(c) for c in SYMBOLS]] = True
_CLASSES[1, [ord(c) for c in "!?"]] = True
_CLASSES[2, 65:91] = True
_CLASSES[3, 48:58] = True
_CLASSES[4, 97:123] = True
_CLASSES[5, 128:] = True
_CLASSES[6, 10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.unique(word_hashes(data, starts, ends))


_STOPS = _stop_hashes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    totals = []
    for table in _CLASSES:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        totals.append(sums[offsets[1:]] - sums[offsets[:-1]])
    symbols, marks, upper, digits, lower, wide, newlines = totals
    starts, ends, rows = word_spans(data, offsets)
    hashes = word_hashes(_LOWER[data], starts, ends)
    uppers = np.concatenate([[0], np.cumsum(_CLASSES[2][data])])
    each = lambda x: np.bincount(rows, x, n)
    words = np.bincount(rows, minlength=n)
    chars = each(ends - starts)
    shout = each((uppers[ends] - uppers[starts]) * 2 > ends - starts)
    stops = each(np.isin(hashes, _STOPS))
    long = each(ends - starts > 20)
    first = np.searchsorted(rows, np.arange(n + 1), "left").tolist()
    grams = rolling(hashes, 5)
    distinct, repeats = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            distinct[i] = len(np.unique(hashes[a:b]))
        if b - a >= 5:
            repeats[i] = b - a - 4 - len(np.unique(grams[a : b - 4]))
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    letters = np.maximum(upper + lower, 1)
    return np.stack([np.log1p(words), chars / w, symbols / w, marks / w, upper / letters, digits / c, (chars - symbols - marks - upper - digits - lower - wide) / w, wide / c, words / (newlines + 1), stops / w, distinct / w, repeats / w, shout / w, long / w], axis=1)


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, "right") for e, col in zip(edges, x.T, strict=True)], axis=1)


def tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Newton step of each bin, by a tree over ordered bins with at most ``leaves`` leaves."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    score = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = score(a, k) + score(k, b) - score(a, b)
                j = int(np.argmax(gain))
                if gain[j] > best:
                    best, where = gain[j], int(k[j])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + ridge)
    return step


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.1, pairs: int = 4, coarse: int = 6) -> dict:
    if len(y) == 0:
        return {"base": 0.0, "edges": [], "tables": [], "coarse": [], "pairs": []}
    edges, rough = edges_of(x, bins), edges_of(x, coarse)
    b, c = binned(x, edges), binned(x, rough)
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    f = np.full(len(y), base)
    tables = [np.zeros(len(e) + 1) for e in edges]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, table in enumerate(tables):
            g, h = slopes()
            step = rate * tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), 3)
            table += step
            f += step[b[:, k]]
    g, h = slopes()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            ni, nj = len(rough[i]) + 1, len(rough[j]) + 1
            cell = c[:, i] * nj + c[:, j]
            G, H = np.bincount(cell, g, ni * nj), np.bincount(cell, h, ni * nj)
            gains.append((float((G * G / (H + 5)).sum()), i, j))
    chosen = []
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        ni, nj = len(rough[i]) + 1, len(rough[j]) + 1
        chosen.append((i, j, np.zeros((ni, nj))))
    for _ in range(rounds // 3):
        for i, j, table in chosen:
            g, h = slopes()
            cell = c[:, i] * table.shape[1] + c[:, j]
            G, H = np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape)
            # Depth two: one cut of the first feature, then one of the second on each side.
            rows = tree(G.sum(axis=1), H.sum(axis=1), 2)
            step = np.zeros(table.shape)
            for value in np.unique(rows):
                side = rows == value
                step[side] = tree(G[side].sum(axis=0), H[side].sum(axis=0), 2, 5.0)
            table += rate * step
            f += rate * step[c[:, i], c[:, j]]
    return {"base": base, "edges": edges, "tables": tables, "coarse": rough, "pairs": chosen}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    if model["edges"]:
        b, c = binned(x, model["edges"]), binned(x, model["coarse"])
        for k, table in enumerate(model["tables"]):
            f += table[b[:, k]]
        for i, j, table in model["pairs"]:
            f += table[c[:, i], c[:, j]]
    return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> dict:
    """The model, from (doc_id, text) rows and (doc_id, quality) labels; at most ``most`` labelled rows."""
    n = labels.count()
    share = min(1.0, 1.2 * most / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (place < share)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most).withColumnRenamed("doc_id", "_id")
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text"))):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), batch.column("quality").slice(lo, hi - lo).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.select("_id", "quality", "text").mapInArrow(measure, f"id {kind}, quality int, x array<double>").collect())  # at most ``most`` labels
    return train(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["quality"] for r in got], float))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(scores(shared.value, features(data, offsets)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(fold(5) != 0))
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
