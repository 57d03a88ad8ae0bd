"""Clusters of documents: MinHash signatures, density clusters on them, and their confidence.

A signature is the minima of linear permutations over hashed character shingles, computed
in numpy by batch. Two documents are neighbours if their signatures differ in at most a
share ``eps`` of their places. That many differing places can spoil at most as many bands,
so with one band more every pair of neighbours shares a band: the candidates are complete,
and no pair is lost to hashing in bands. Equal signatures are one weighted point; the
points of a band's bucket are compared in square tiles of bounded size, and a tile returns
counts, a forest of its links and border links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import views as v
from ..plans.stages import components, delete, joined_by_size, written
from ..registry import register

SPACES = "[\\x20\\x09-\\x0D]+"
#: Base and modulus of the shingles' hash; permutations are linear modulo 2**32.
BASE, MODULUS, MASK = 1_000_003, 4294967291, (1 << 32) - 1
# The default setting of the surveyed clustering.
EPS, MIN_SAMPLES, SHINGLE, PERMUTATIONS = 0.34, 8, 7, 128
#: Points of a side of a tile, and rows that are compared with it at once.
TILE, ROWS = 512, 64
#: (rows of one side, rows of the other, neighbours, those that no earlier bucket has met), for strips of a tile.
Compared = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def coefficients(n: int) -> list[tuple[int, int]]:
    """Odd factors under 2**31 and offsets under 2**32, by a linear rule."""
    x, out = 20240229, []
    for _ in range(n):
        x = (6364136223846793005 * x + 1442695040888963407) % (1 << 64)
        out.append(((x >> 33) | 1, x & MASK))
    return out


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``shingle`` characters, or of the whole text if it is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(shingle, len(codes))
    h = np.zeros(max(1, len(codes) - width + 1), np.uint64)
    for j in range(width):
        h = (h * np.uint64(BASE) + codes[j : j + len(h)]) % np.uint64(MODULUS)
    return h


def char_signatures(texts: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, signature): white space is one blank; null and empty texts are one shingle of their own."""
    factors, offsets = (np.array(x, np.uint64) for x in zip(*coefficients(permutations), strict=True))

    def sign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, permutations), np.int64)
            for r, text in enumerate(batch.column("x").to_pylist()):
                least = np.full(permutations, MASK, np.uint64)
                h = shingle_hashes(text, shingle)
                for lo in range(0, len(h), 4096):
                    some = (h[lo : lo + 4096, None] * factors + offsets) & np.uint64(MASK)
                    np.minimum(least, some.min(axis=0), out=least)
                out[r] = least
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * permutations, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "signature"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    return texts.where("doc_id is not null").select("doc_id", clean.alias("x")).mapInArrow(sign, f"doc_id {kind}, signature array<long>")


def cut(permutations: int, eps: float) -> tuple[int, list[int]]:
    """The places in which neighbours may differ, and the bounds of the bands, one more than those."""
    far = min(permutations - 1, int(eps * permutations + 1e-9))
    return far, [k * permutations // (far + 1) for k in range(far + 2)]


@dataclass(frozen=True)
class Places:
    """Neighbours by signatures that differ in at most a share ``eps`` of their places."""

    permutations: int = PERMUTATIONS
    eps: float = EPS
    columns = ("signature",)

    def buckets(self, points: DataFrame) -> DataFrame:
        """(id, k, bucket): the bands of each point."""
        _, bounds = cut(self.permutations, self.eps)
        bands = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.slice("signature", a + 1, b - a)).alias("bucket")) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        return points.select("id", F.explode(F.array(*bands)).alias("x")).select("id", "x.k", "x.bucket")

    def compared(self, group: dict[str, np.ndarray]) -> Compared:
        """Strips of a tile; a pair is first met in the first band that it shares."""
        far, bounds = cut(self.permutations, self.eps)
        left, right = sides(group)
        s, k = np.stack(group["signature"]), int(group["k"][0])
        for a in range(0, len(left), ROWS):
            rows = left[a : a + ROWS]
            equal = s[rows, None, :] == s[None, right, :]
            near = equal.sum(axis=2) >= s.shape[1] - far
            if right is left:
                near[np.arange(len(rows)), a + np.arange(len(rows))] = False
            first = near.copy()
            for lo, hi in zip(bounds[:k], bounds[1 : k + 1], strict=True):
                first &= ~equal[:, :, lo:hi].all(axis=2)
            yield rows, right, near, first


def sides(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both sides of a tile; the same array where a part meets itself."""
    left = np.flatnonzero(group["side"] == 0)
    return left, left if group["lo"][0] == group["hi"][0] else np.flatnonzero(group["side"] == 1)


def tiles(points: DataFrame, measure) -> DataFrame:
    """(bucket, k, lo, hi, side, id): the points of each bucket of two or more, in pairs of parts of about TILE points.

    A bucket of m points gives a point m / TILE times; no bucket is left out.
    """
    banded = measure.buckets(points)
    sizes = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = joined_by_size(banded, sizes, "bucket", total).withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("bucket", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")


def tile_groups(batches) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each (bucket, lo, hi), from batches sorted by them."""
    key, held = ("bucket", "lo", "hi"), None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held is not None:
            cells = {n: np.concatenate([held[n], cells[n]]) for n in cells}
        new = np.zeros(len(cells["bucket"]), bool)
        for n in key:
            new[1:] |= cells[n][1:] != cells[n][:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield {n: c[a:b] for n, c in cells.items()}
        held = {n: c[at[-1] :] for n, c in cells.items()}
    if held is not None:
        yield held


def _compare(rows: DataFrame, step, schema: str) -> DataFrame:
    key = ["bucket", "lo", "hi"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(step, schema)


def neighbour_weights(rows: DataFrame, measure) -> DataFrame:
    """(id, w): the weight of each point's neighbours, each counted in the first bucket that it shares."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for g in tile_groups(batches):
            w = np.zeros(len(g["id"]), np.int64)
            for left, right, _, first in measure.compared(g):
                w[left] += first @ g["weight"][right]
                if g["lo"][0] != g["hi"][0]:
                    w[right] += g["weight"][left] @ first
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(g["id"][some]), pa.array(w[some])], names=["id", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    return _compare(rows, count, f"id {kind}, w long").groupBy("id").agg(F.sum("w").alias("w"))


def dense_links(rows: DataFrame, measure) -> DataFrame:
    """(a, b, border): links that join the neighbouring core points of a tile, as a forest; and all core neighbours of other points.

    A point that isn't core has fewer neighbours than make it one, so these are few too.
    """

    def link(batches) -> Iterator[pa.RecordBatch]:
        for g in tile_groups(batches):
            n, core = len(g["id"]), g["core"].astype(bool)
            least, edge_a, edge_b = np.arange(n), [], []
            strips = []
            for left, right, near, _ in measure.compared(g):
                some = near & core[left][:, None] & core[right][None, :]
                strips.append((left, right, some))
                x, y = np.nonzero(near & ~core[left][:, None] & core[right][None, :])
                edge_a.append(g["id"][left[x]])
                edge_b.append(g["id"][right[y]])
                if g["lo"][0] != g["hi"][0]:
                    x, y = np.nonzero(near & core[left][:, None] & ~core[right][None, :])
                    edge_a.append(g["id"][right[y]])
                    edge_b.append(g["id"][left[x]])
            while True:  # least row that each row reaches in this tile
                after = least.copy()
                for left, right, some in strips:
                    after[left] = np.minimum(after[left], np.where(some, after[right][None, :], n).min(axis=1, initial=n))
                    after[right] = np.minimum(after[right], np.where(some, after[left][:, None], n).min(axis=0, initial=n))
                after = after[after]
                if (after == least).all():
                    break
                least = after
            own = np.flatnonzero(least != np.arange(n))
            border_a, border_b = (np.concatenate(x) if x else g["id"][:0] for x in (edge_a, edge_b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([g["id"][own], border_a])), pa.array(np.concatenate([g["id"][least[own]], border_b])), pa.array(np.arange(len(own) + len(border_a)) >= len(own))],
                names=["a", "b", "border"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return _compare(rows, link, f"a {kind}, b {kind}, border boolean")


def density(points: DataFrame, measure, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, kind, cluster) of points (id, weight and the columns of ``measure``), which are all distinct. A written table.

    ``core``: the weight of its neighbours, its own included, is at least ``min_samples``.
    A cluster is named by its least core id. A point beside core points only is
    ``border`` and joins the cluster with the least name; the rest are ``noise``.
    """
    rows = written(tiles(points, measure))
    weights = neighbour_weights(rows.join(points.select("id", "weight", *measure.columns), "id"), measure)
    cores = written(points.join(weights, "id", "left").select("id", "weight", F.coalesce("w", F.lit(0)).alias("w")).select("id", (F.col("weight") + F.col("w") >= min_samples).alias("core"), (F.col("w") > 0).alias("near")))
    met = rows.join(cores.where("near").select("id", "core"), "id").join(points.select("id", *measure.columns), "id")
    links = written(dense_links(met, measure))
    found = components(links.where("not border"))
    named = cores.where("core").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = links.where("border").select(F.col("a").alias("own"), F.col("b").alias("id")).join(named, "id").groupBy(F.col("own").alias("id")).agg(F.min("cluster").alias("beside"))
    out = cores.join(named, "id", "left").join(border, "id", "left")
    kind = F.when(F.col("core"), "core").when(F.col("beside").isNotNull(), "border").otherwise("noise")
    out = written(out.select("id", kind.alias("kind"), F.coalesce("cluster", "beside").alias("cluster")))
    delete(rows, cores, links, found)
    return out


def cluster_confidence(points: DataFrame) -> DataFrame:
    """(id, confidence): the mean share of equal places with the other documents of the cluster; 1 alone, noise has none.

    ``points`` has (id, cluster, weight, signature). For each place the members with each
    value are counted, so the sum over all others needs no pairs.
    """
    places = points.where("cluster is not null").select("id", "cluster", "weight", F.posexplode("signature").alias("p", "m"))
    places = places.select("id", "weight", F.struct("cluster", "p", "m").alias("at"))
    counts = written(places.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("docs")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    same = joined_by_size(places.select("id", "at"), counts, "at", total).groupBy("id").agg(F.sum(F.col("docs") - 1).alias("same"), F.count(F.lit(1)).alias("places"))
    sizes = points.groupBy("cluster").agg(F.sum("weight").alias("docs"))
    df = points.where("cluster is not null").select("id", "cluster").join(sizes, "cluster").join(same, "id")
    mean = F.col("same") / F.col("places") / (F.col("docs") - 1)
    return df.select("id", F.when(F.col("docs") > 1, F.round(mean, 6)).otherwise(F.lit(1.0)).alias("confidence"))


def template_clusters(texts: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, kind, cluster, confidence) of each document (doc_id, text); noise has no cluster and confidence 0."""
    signed = written(char_signatures(texts, shingle, permutations))
    points = written(signed.groupBy("signature").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("weight")))
    found = density(points, Places(permutations, eps), min_samples)
    sure = cluster_confidence(points.join(found.select("id", "cluster"), "id"))
    each = found.join(sure, "id", "left").join(points, "id").select("signature", F.col("weight").alias("n"), "kind", "cluster", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return joined_by_size(signed, each, "signature", signed.count()).select("doc_id", "kind", "cluster", "confidence")


_QUERY = {"eps": 0.34, "min_samples": 3, "shingle": 7, "permutations": 64}
_FAR = cut(_QUERY["permutations"], _QUERY["eps"])[0]
_PLACES = range(_QUERY["permutations"])
_SIGNATURES = f"""t AS (SELECT doc_id, list_transform(string_split(trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g'), ' '), ''), lambda c: unicode(c)::BIGINT) AS c FROM documents),
i AS (SELECT doc_id, c, unnest(range(1, greatest(len(c) - {_QUERY["shingle"]} + 1, 1) + 1)) AS i FROM t),
h AS (SELECT doc_id, CASE WHEN len(c) = 0 THEN 0 ELSE list_reduce(list_slice(c, i, i + {_QUERY["shingle"]} - 1), lambda x, y: (x * {BASE} + y) % {MODULUS}) END AS h FROM i),
sig AS (SELECT doc_id, {", ".join(f"min(({a}::BIGINT * h + {b}) & {MASK}) AS m{p}" for p, (a, b) in enumerate(coefficients(_QUERY["permutations"])))} FROM h GROUP BY 1)"""
_SAME = " + ".join(f"(x.m{p} = y.m{p})::INT" for p in _PLACES)
register(
    "template_clusters",
    lambda spark, d: template_clusters(v.table(spark, d, "documents"), **_QUERY),
    f"""WITH RECURSIVE {_SIGNATURES},
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, {_SAME} AS same FROM sig x JOIN sig y ON x.doc_id <> y.doc_id),
core AS (SELECT doc_id FROM sig LEFT JOIN pair ON a = doc_id AND same >= {_QUERY["permutations"] - _FAR} GROUP BY 1 HAVING count(b) + 1 >= {_QUERY["min_samples"]}),
near AS (SELECT a, b FROM pair WHERE same >= {_QUERY["permutations"] - _FAR} AND b IN (SELECT doc_id FROM core)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM core UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b AND r.b IN (SELECT doc_id FROM core)),
named AS (SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY 1),
beside AS (SELECT a AS doc_id, min(cluster) AS cluster FROM near JOIN named ON doc_id = b GROUP BY 1),
m AS (SELECT s.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 'core' WHEN b.doc_id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(n.cluster, b.cluster) AS cluster FROM sig s LEFT JOIN named n USING (doc_id) LEFT JOIN beside b USING (doc_id)),
f AS (SELECT x.doc_id, avg(same / {_QUERY["permutations"]}.0::DOUBLE) AS mean FROM m x JOIN m y ON x.cluster = y.cluster AND x.doc_id <> y.doc_id JOIN pair ON a = x.doc_id AND b = y.doc_id GROUP BY 1)
SELECT doc_id, kind, cluster, CASE WHEN cluster IS NULL THEN 0.0::DOUBLE ELSE coalesce(round(mean, 6), 1.0::DOUBLE) END AS confidence FROM m LEFT JOIN f USING (doc_id)""",
)
