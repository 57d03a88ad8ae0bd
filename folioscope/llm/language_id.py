"""Language identification by nearest centroid.

A text becomes counts of hashed byte n-grams (1 to 3 bytes; ASCII lower-cased, other
than letters to one space), damped by log(1 + n), weighted by inverse document
frequency and scaled to length 1. Each language has a few centroids, clustered by
cosine from a bounded, hash-drawn sample of its labelled documents (``per_language``
documents, ``most`` in all); the statistics of that sample are all that is learned.
A text gets the language of its nearest centroid; ``rejected`` marks texts that are
farther from it than nearly all of its sample was.

Edge cases: null text, and text without a letter, gives ``und`` with score 0 and is
rejected; equal texts get equal results; with no labelled document, every text gives
``und``; an empty table gives an empty result. Whole texts are read at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import session
from .arrowtext import chunks, text_buffers

DIMS_LOG = 12
DIMS = 1 << DIMS_LOG
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed n-gram counts."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMS, np.int64)
    folded = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets)) * DIMS
    blank = folded == 0x20
    for k in (1, 2, 3):
        m = len(folded) - k + 1
        if m <= 0:
            continue
        code = folded[:m].copy()
        ok = row[:m] == row[k - 1 :]
        for j in range(1, k):
            code = code << np.uint32(8) | folded[j : m + j]
            ok &= ~(blank[j - 1 : m + j - 1] & blank[j : m + j])
        if k == 1:
            ok &= ~blank
        code = (code + np.uint32(k << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - DIMS_LOG)
        out += np.bincount(row[:m][ok] + code[ok], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each next start is the row farthest from those before."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def sampled(rows: DataFrame, by: str, each: int) -> DataFrame:
    """About ``each`` rows of each value of ``by``, never more, drawn by a hash of doc_id."""
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each label
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, 1.2 * each / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    some = rows.withColumn("_place", place).where(F.col("_place") < share)
    return some.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("_place", "doc_id"))).where(F.col("_k") <= each).drop("_place", "_k")


def fit(labelled: DataFrame, per_language: int = 400, most: int = 20_000, centroids: int = 3) -> dict:
    """The model, from (doc_id, lang, text) rows."""
    languages = max(1, labelled.select("lang").distinct().count())
    chosen = sampled(labelled.select("doc_id", "lang"), "lang", max(1, min(per_language, most // languages)))
    some = labelled.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id").select("_id")), F.col("doc_id") == F.col("_id"), "left_semi")

    def vectors(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text"))):
                counts = gram_counts(data, offsets)
                at = [np.flatnonzero(r) for r in counts]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([a.astype("<u2").tobytes() for a in at]), pa.array([r[a].astype("<i4").tobytes() for r, a in zip(counts, at, strict=True)])], names=["lang", "at", "n"])

    rows = some.select("lang", "text").mapInArrow(vectors, "lang string, at binary, n binary").collect()  # at most ``most`` rows
    if not rows:
        return {"langs": [], "of": np.zeros(0, int), "c": np.zeros((0, DIMS), np.float32), "idf": np.ones(DIMS, np.float32), "floor": np.zeros(0)}
    counts = np.zeros((len(rows), DIMS), np.int32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<i4")
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, own = weighted(counts, idf), np.array([r["lang"] for r in rows])
    langs = sorted(set(own.tolist()))
    c, of, floor = [], [], []
    for k, lang in enumerate(langs):
        mine = x[own == lang]
        cs = clustered(mine, centroids)
        c.append(cs)
        of += [k] * len(cs)
        floor.append(0.8 * float(np.quantile(np.max(mine @ cs.T, axis=1), 0.01)))
    return {"langs": langs, "of": np.array(of), "c": np.concatenate(c).astype(np.float32), "idf": idf, "floor": np.array(floor)}


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "rejected"]
    letters = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letter"))

    def predict(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m["langs"], "und"], object)
        for batch in batches:
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(*text_buffers(batch.column("text")), limit=1 << 19):
                best, score = np.full(hi - lo, len(langs) - 1), np.zeros(hi - lo)
                if m["langs"]:
                    near = weighted(gram_counts(data, offsets), m["idf"]) @ m["c"].T
                    at = np.argmax(near, axis=1)
                    ok = letter[lo:hi]
                    best = np.where(ok, m["of"][at], best)
                    score = np.where(ok, np.clip(near[np.arange(len(at)), at], 0, 1).astype(float), 0.0)
                far = (best == len(langs) - 1) | (score < np.append(m["floor"], 2.0)[best])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(far)], names=names)

    return letters.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fold(of: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir)
    model = fit(docs.where((fold(3) != 1) & F.col("lang").isNotNull()).select("doc_id", "lang", "text"))
    return predicted(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
