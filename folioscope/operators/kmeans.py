"""Clusters of feature vectors: standardised, projected on principal components, k-means for several k, the best by silhouette.

Means, deviations and the covariance are partial sums of one or two passes; only a matrix
of features by features, and at most ``most`` centres for each k, reach the driver. All k
advance together, one pass a round. The first centres are the row of the least hash and
then, again and again, the row furthest from those chosen, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import views as v
from ..plans.stages import delete, written
from ..registry import register
from .vectors import dot

MOST, COMPONENTS, ROUNDS = 8, 3, 50


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """(id, x): each feature less its mean, over its population deviation; constant features are 0, null ones count as 0."""
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    row = df.agg(*(F.avg(x).alias(f"m_{c}") for c, x in values.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in values.items())).first()
    scaled = [((x - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"])) if (row[f"s_{c}"] or 0) > 1e-12 else F.lit(0.0) for c, x in values.items()]
    return df.select("id", F.array(*scaled).alias("x"))


def principal_axes(scaled: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes k x d, shares of the variance) of standardised rows; of each axis the largest weight is positive."""
    sums = scaled.agg(*(F.avg(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1))).first()
    c = np.array([[sums[f"c_{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return axes, values[order] / max(values.sum(), 1e-12)


def distance(x: Column, y: Column) -> Column:
    """The squared distance."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def constant(centres: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))


def first_centres(points: DataFrame, most: int) -> list[list[float]]:
    """At most ``most`` rows, each the furthest from those before, ties by id; fewer if the rows have fewer values."""
    start = points.agg(F.min_by("p", F.struct(F.xxhash64("id"), "id"))).first()[0]
    out = [list(start)] if start is not None else []
    while 0 < len(out) < most:
        gap = F.round(F.array_min(F.transform(constant(out), lambda c: distance(F.col("p"), c))), 9)
        far = points.agg(F.max_by(F.struct(gap.alias("d"), F.col("p")), F.struct(gap, F.negate(F.xxhash64("id"))))).first()[0]
        if far["d"] <= 0:
            break
        out.append(list(far["p"]))
    return out


def assigned(points: DataFrame, centres: dict[int, list[list[float]]]) -> DataFrame:
    """(id, p, k, c): for each row and each k the nearest centre, the first of equally near ones."""
    kept = {k: np.array(cs) for k, cs in centres.items()}

    def near(batches):
        for batch in batches:
            p = np.array(batch.column("p").to_pylist(), np.float64)
            for k, cs in kept.items() if len(p) else ():
                c = np.round(((p[:, None, :] - cs[None, :, :]) ** 2).sum(axis=2), 12).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("p"), pa.array(np.full(len(p), k, np.int32)), pa.array(c.astype(np.int32))], names=["id", "p", "k", "c"])

    return points.select("id", "p").mapInArrow(near, f"id {points.schema['id'].dataType.simpleString()}, p array<double>, k int, c int")


def moved(points: DataFrame, centres: dict[int, list[list[float]]]) -> DataFrame:
    """(k, c, n, x): how many rows each centre has and the sums of their values, a row a task and centre, summed."""
    kept = {k: np.array(cs) for k, cs in centres.items()}
    d = len(next(iter(centres.values()))[0])

    def partial(batches):
        sums = {k: np.zeros((len(cs), d + 1)) for k, cs in kept.items()}
        for batch in batches:
            p = np.array(batch.column("p").to_pylist(), np.float64)
            for k, cs in kept.items() if len(p) else ():
                c = np.round(((p[:, None, :] - cs[None, :, :]) ** 2).sum(axis=2), 12).argmin(axis=1)
                for i in range(d + 1):
                    sums[k][:, i] += np.bincount(c, p[:, i] if i < d else None, len(cs))
        rows = [(k, c, int(x[d]), x[:d].tolist()) for k, all_c in sums.items() for c, x in enumerate(all_c) if x[d]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["k", "c", "n", "x"])

    sums = points.select("p").mapInArrow(partial, "k int, c int, n long, x array<double>")
    return sums.groupBy("k", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("x", F.lit(i))) for i in range(d))).alias("x"))


def clustered(df: DataFrame, features: list[str], most: int = MOST, components: int = COMPONENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, cluster), (k, silhouette), (cluster, size and mean of each feature)) of rows (id, features).

    The silhouette is that of squared distances, from each cluster's mean and mean square,
    so it takes no pairs. Fewer than six rows, or rows of one value, are one cluster.
    """
    df = written(df.select("id", *features))  # what the features are taken from is read once
    n = df.limit(6).count()
    scaled = standardised(df, features)
    if n < 6:
        labels = df.select("id", F.lit(0).alias("cluster"))
        return labels, df.sparkSession.createDataFrame([], "k int, silhouette double"), described(df, labels, features)
    axes, _ = principal_axes(scaled, len(features), min(components, len(features)))
    points = written(scaled.select("id", F.array(*(F.round(sum((F.get("x", F.lit(j)) * F.lit(float(a)) for j, a in enumerate(axis)), F.lit(0.0)), 9) for axis in axes)).alias("p")))
    start = first_centres(points, most)
    centres = {k: start[:k] for k in range(2, len(start) + 1)}
    if not centres:
        labels = written(points.select("id", F.lit(0).alias("cluster")))
        return labels, df.sparkSession.createDataFrame([], "k int, silhouette double"), described(df, labels, features)
    dims = range(len(axes))
    for _ in range(ROUNDS):
        after = {k: list(cs) for k, cs in centres.items()}
        for r in moved(points, centres).collect():  # a row for each centre
            after[r["k"]][r["c"]] = [round(x / r["n"], 9) for x in r["x"]]
        if after == centres:
            break
        centres = after
    placed = written(assigned(points, centres))
    stats = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.get("p", F.lit(i))) for i in dims)).alias("m"), F.avg(dot(F.col("p"), F.col("p"))).alias("s"))
    packed = stats.groupBy("k").agg(F.collect_list(F.struct("c", "n", "m", "s")).alias("all"))  # k centres
    joined = placed.join(F.broadcast(packed), "k")  # a row for each k
    apart = lambda g: F.greatest(F.lit(0.0), dot(F.col("p"), F.col("p")) - 2 * dot(F.col("p"), g["m"]) + g["s"])
    own = F.element_at(F.filter("all", lambda g: g["c"] == F.col("c")), 1)
    a = apart(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("all", lambda g: g["c"] != F.col("c")), apart))
    s = F.when((own["n"] == 1) | (F.greatest(a, b) <= 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    scores = written(joined.groupBy("k").agg(F.round(F.avg(s), 6).alias("silhouette")))
    best = scores.agg(F.max_by("k", F.struct("silhouette", F.negate("k")))).first()[0]
    labels = written(placed.where(F.col("k") == best).select("id", F.col("c").alias("cluster")))
    delete(points, placed)
    return labels, scores, described(df, labels, features)


def described(df: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, size, mean of each feature)."""
    return df.join(labels, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4).alias(c) for c in features))


FEATURES = ["words", "sentences", "capitals", "digits", "lines"]


def document_vectors(spark, d) -> DataFrame:
    """(id, features) of all documents: sizes on a logarithmic scale and shares of characters."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    log = lambda c: F.log1p(c.cast("double"))
    return v.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), log(F.regexp_count(text, F.lit(r"\S+"))).alias("words"), log(F.regexp_count(text, F.lit("[.!?]"))).alias("sentences"),
        (F.regexp_count(text, F.lit("[A-Z]")) / size).alias("capitals"), (F.regexp_count(text, F.lit("[0-9]")) / size).alias("digits"), log(F.regexp_count(text, F.lit("\n"))).alias("lines"),
    )


register("feature_clusters", lambda spark, d: clustered(document_vectors(spark, d), FEATURES)[0])
register("feature_cluster_means", lambda spark, d: clustered(document_vectors(spark, d), FEATURES)[2])
