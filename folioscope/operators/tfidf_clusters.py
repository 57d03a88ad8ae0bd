"""Density clusters of documents by the cosine of TF-IDF vectors over character n-grams inside words.

A word gets a blank on each side; its n-grams are the runs of ``least`` to ``most``
characters of that, and a word shorter than an n-gram counts once as a whole. Features
are the ``features`` n-grams used most, weighted by ``ln((1 + N) / (1 + df)) + 1``; each
vector has length 1.

Neighbours are at least ``1 - eps`` alike. Features are ordered by rising document
frequency. The prefix of a vector is cut where the rest is shorter than ``1 - eps``: two
vectors that share nothing before both cuts have a product below that, so neighbours
share a feature of their prefixes and no pair is lost. Points of a feature are compared
in tiles; a pair counts in the first prefix feature that it shares. Equal vectors are one
weighted point, and a tile returns counts and a forest, never its pairs.

Limit: a vector is sent once for each prefix feature and tile. Where most documents share
their rarer n-grams too, prefixes prune little and this outgrows memory and disk; on
1,000 documents of sf0.01 with 20,000 features workers ran out of memory. So no query is
registered; for a corpus use ``clustering.template_clusters``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import delete, joined_by_size, written
from .clustering import EPS, MIN_SAMPLES, SPACES, Compared, density, sides

# The default setting of the surveyed clustering.
LEAST, MOST, FEATURES = 5, 7, 20_000
#: What a product may lack to its limit and still count, since sums of doubles differ by their order.
SLACK = 1e-9
#: Features of a tile that are laid out as a matrix at once.
WIDE = 2048


def word_grams(word: str, least: int, most: int) -> Iterator[str]:
    padded = f" {word} "
    for n in range(least, most + 1):
        yield from (padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))
        if n >= len(padded):
            return


def gram_counts(texts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, grams, counts) of texts (doc_id, words), each document's n-grams in order."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found: Counter[str] = Counter()
                for word, n in Counter(batch.column("words")[r].as_py().split(" ")).items():
                    for gram in word_grams(word, least, most) if word else ():
                        found[gram] += n
                grams = sorted(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, 1), pa.array([grams], pa.list_(pa.string())), pa.array([[found[g] for g in grams]], pa.list_(pa.int64()))], names=["doc_id", "grams", "counts"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(count, f"doc_id {kind}, grams array<string>, counts array<long>")


def weights(counts: DataFrame, features: int = FEATURES) -> DataFrame:
    """(gram, df, idf) of the ``features`` n-grams used most, ties by the n-gram's bytes; rare ones first."""
    each = counts.select(F.explode(F.arrays_zip("grams", "counts")).alias("x")).groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.counts").alias("uses"), F.count(F.lit(1)).alias("df"))
    kept = each.orderBy(F.desc("uses"), "gram").limit(features)
    total = counts.agg(F.count(F.lit(1)).alias("all"))
    return kept.join(F.broadcast(total), F.lit(True)).select("gram", "df", (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("df", "gram")


def vectors(counts: DataFrame, weighted: list, eps: float) -> DataFrame:
    """(doc_id, features, values, prefix); ``weighted`` are the rows of ``weights``. A document without a feature has empty arrays."""
    known = counts.sparkSession.sparkContext.broadcast({r["gram"]: (i, r["idf"]) for i, r in enumerate(weighted)})

    def weigh(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pairs = sorted((*known.value[g], n) for g, n in zip(batch.column("grams")[r].as_py(), batch.column("counts")[r].as_py(), strict=True) if g in known.value)
                values = np.array([w * n for _, w, n in pairs])
                values /= math.sqrt(float(values @ values)) or 1.0
                rest = np.sqrt(np.cumsum((values * values)[::-1])[::-1])  # length from each feature on
                prefix = int((rest >= 1 - eps - 10 * SLACK).sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, 1), pa.array([[i for i, _, _ in pairs]], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float64())), pa.array([prefix], pa.int32())], names=["doc_id", "features", "values", "prefix"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(weigh, f"doc_id {kind}, features array<int>, values array<double>, prefix int")


@dataclass(frozen=True)
class Cosine:
    """Neighbours by the product of their vectors."""

    eps: float = EPS
    columns = ("features", "values", "prefix")

    def buckets(self, points: DataFrame) -> DataFrame:
        return points.select("id", F.lit(0).alias("k"), F.explode(F.slice("features", F.lit(1), F.col("prefix")).cast("array<long>")).alias("bucket"))

    def compared(self, group: dict[str, np.ndarray]) -> Compared:
        left, right = sides(group)
        lengths = np.array([len(x) for x in group["features"]])
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.concatenate(group["features"])
        value = np.concatenate(group["values"])
        before = (np.concatenate([np.arange(n) for n in lengths]) < group["prefix"][row]) & (at < group["bucket"][0])
        used, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(0, len(used) + WIDE, WIDE))
        product, shared = (np.zeros((len(left), len(right))) for _ in range(2))
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            some = order[lo:hi]
            for total, cells in ((product, value), (shared, before)):
                wide = np.zeros((len(lengths), WIDE))
                wide[row[some], at[some] - k * WIDE] = cells[some]
                total += wide[left] @ wide[right].T
        near = product >= 1 - self.eps - SLACK
        if right is left:
            np.fill_diagonal(near, False)
        yield left, right, near, near & (shared < 0.5)


def centre_confidence(points: DataFrame) -> DataFrame:
    """(id, confidence): the cosine of each point (id, cluster, weight, features, values) and its cluster's mean vector."""
    cells = points.where("cluster is not null").select("id", "cluster", "weight", F.explode(F.arrays_zip("features", "values")).alias("x"))
    cells = cells.select("id", "weight", F.struct("cluster", F.col("x.features").alias("feature")).alias("at"), F.col("x.values").alias("value"))
    centres = written(cells.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("value")).alias("sum")))
    total = centres.agg(F.sum("n")).first()[0] or 0
    lengths = centres.groupBy(F.col("at.cluster").alias("cluster")).agg(F.sqrt(F.sum(F.col("sum") * F.col("sum"))).alias("length"))
    products = joined_by_size(cells, centres, "at", total).groupBy("id").agg(F.sum(F.col("value") * F.col("sum")).alias("product"))
    df = points.where("cluster is not null").select("id", "cluster").join(lengths, "cluster").join(products, "id")
    return df.select("id", F.round(F.least(F.lit(1.0), F.col("product") / F.col("length")), 6).alias("confidence"))


def tfidf_clusters(texts: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, least: int = LEAST, most: int = MOST, features: int = FEATURES) -> DataFrame:
    """(doc_id, kind, cluster, confidence) of each document (doc_id, text), in lower case.

    ``core``, ``border`` and ``noise`` are as in ``clustering.density``; a cluster is named
    by its least core id, the confidence is the cosine with its mean vector, and noise has
    no cluster and confidence 0. Texts without a feature (null, empty, or with rare n-grams
    only) are noise, rows with a null doc_id are left out, an empty table gives no row. The
    driver holds ``features`` rows of weights.
    """
    clean = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")))
    counts = written(gram_counts(texts.where("doc_id is not null").select("doc_id", clean.alias("words")), least, most))
    weighted = weights(counts, features).collect()  # at most ``features`` rows
    signed = written(vectors(counts, weighted, eps).select("doc_id", F.struct("features", "values").alias("vector"), "prefix"))
    some = F.size("vector.features") > 0
    points = written(signed.where(some).groupBy("vector").agg(F.first("prefix").alias("prefix"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "weight", "vector.*", "prefix"))
    found = density(points, Cosine(eps), min_samples)
    sure = centre_confidence(points.join(found.select("id", "cluster"), "id"))
    each = found.join(sure, "id", "left").join(points, "id").select(F.struct("features", "values").alias("vector"), F.col("weight").alias("n"), "kind", "cluster", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    named = joined_by_size(signed.where(some).select("doc_id", "vector"), each, "vector", signed.count()).select("doc_id", "kind", "cluster", "confidence")
    bare = signed.where(~some).select("doc_id", F.lit("noise").alias("kind"), F.lit(None).cast(signed.schema["doc_id"].dataType).alias("cluster"), F.lit(0.0).alias("confidence"))
    delete(counts)
    return named.unionByName(bare)

