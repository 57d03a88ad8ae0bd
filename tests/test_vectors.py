"""k-means with its silhouette against a plain version, and nearest rows of centres against all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import kmeans, vectors


def plain_clusters(points, centres, most_rounds=50):
    """Lloyd's rounds from the given centres; (labels, silhouette of squared distances over all pairs)."""
    x = np.array(points)
    c = np.array(centres)
    for _ in range(most_rounds):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        labels = d.round(12).argmin(axis=1)
        after = np.array([x[labels == k].mean(axis=0).round(9) if (labels == k).any() else c[k] for k in range(len(c))])
        if (after == c).all():
            break
        c = after
    gaps = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i, own].sum() / (own.sum() - 1)
        b = min(gaps[i, labels == k].mean() for k in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    return labels.tolist(), float(np.mean(scores))


def test_clusters_equal_a_plain_version(spark):
    r = random.Random(6)
    rows = [(i, *(r.gauss(m, 0.4) for m in [(0, 0, 9), (5, 0, 1), (0, 7, 5), (6, 6, 0)][i % 4]), 3.0, None if i == 7 else float(i % 2)) for i in range(120)]
    names = ["a", "b", "c", "constant", "e"]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, constant double, e double").repartition(5)
    labels, scores, means = kmeans.clustered(df, names, most=6)
    x = np.array([[v or 0.0 for v in row[1:]] for row in rows])
    sd = x.std(axis=0)
    z = np.where(sd > 1e-12, (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0.0)
    axes, shares = kmeans.principal_axes(kmeans.standardised(df, names), 5, 3)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(axes @ vt[:3].T), np.eye(3), atol=1e-6) and abs(shares[0] - np.var(z @ vt[0]) / z.var(axis=0).sum()) < 1e-9
    p = (z @ axes.T).round(9)
    points = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(p)], "id long, p array<double>")
    start = kmeans.first_centres(points, 6)
    got = {row["k"]: row["silhouette"] for row in scores.collect()}
    plain = {k: plain_clusters(p, start[:k]) for k in range(2, 7)}
    assert set(got) == set(plain) and all(abs(got[k] - plain[k][1]) < 2e-6 for k in got)
    best = max(plain, key=lambda k: (round(plain[k][1], 6), -k))
    assert best == 4 and {row["id"]: row["cluster"] for row in labels.collect()} == dict(enumerate(plain[4][0]))
    assert sorted(row["size"] for row in means.collect()) == [30] * 4
    again = kmeans.clustered(df.repartition(2), names, most=6)[0]
    assert again.exceptAll(labels).isEmpty()


def test_few_rows_or_one_value_are_one_cluster(spark):
    few = spark.createDataFrame([(1, 1.0), (2, 9.0)], "id long, a double")
    same = spark.createDataFrame([(i, 2.0) for i in range(9)], "id long, a double")
    none = spark.createDataFrame([], "id long, a double")
    for df, n in ((few, 2), (same, 9), (none, 0)):
        labels, scores, _ = kmeans.clustered(df, ["a"])
        assert [r["cluster"] for r in labels.collect()] == [0] * n and scores.count() == 0


def test_centres_against_all_rows(spark):
    r = random.Random(3)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(12)] + [(2000, [0.0] * 8), (2001, None)]
    centres = [(f"f{k}", vec()) for k in range(30)] + [("ones", [2.0] * 8), ("zero", [0.0] * 8)]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n > 1e-9 else 0.0

    want = {(f, i): s for f, c in centres for s, i in sorted((-cosine(v, c), i) for i, v in rows if v)[:5]}
    df, cs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4), spark.createDataFrame(centres, "family_id string, centroid array<double>")
    for block in (2000, 24):
        got = {(x["family_id"], x["id"]): -x["similarity"] for x in vectors.most_similar(df, cs, 5, block).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    links = spark.createDataFrame([("other", 1, "active", 0.9), ("other", 2, "active", 1.7), ("other", 3, "unlinked", 1.0), ("f1", 4, "active", 1.0)], "family_id string, id long, status string, confidence double")
    got = vectors.similar_or_linked(df, cs, links, 5).where("`by` = 'link'").orderBy(F.desc("similarity")).collect()
    assert [tuple(x) for x in got] == [("other", 2, 1.0, "link"), ("other", 1, 0.9, "link")]
    assert vectors.most_similar(df, cs.limit(0), 5).count() == 0 and vectors.most_similar(df.limit(0), cs, 5).count() == 0


def test_nearest_in_blocks_equals_all_pairs(spark):
    """Every row meets every query, with ties by id, in blocks that hold a few rows each, and Python sees blocks, not pairs."""
    x = np.random.default_rng(5).integers(-2, 3, (60, 4)).astype(float)
    x[7] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    good = np.vstack([x, np.zeros((2, 4))])
    unit = good / np.where(np.linalg.norm(good, axis=1) > 1e-9, np.linalg.norm(good, axis=1), 1.0)[:, None]
    cosines = np.round(unit @ unit.T, 6) + 0.0
    want = {(q, i, cosines[q, i]) for q in range(0, 62, 10) for i in sorted((j for j in range(62) if j != q), key=lambda j: (-cosines[q, j], j))[:5]}
    for most, size in ((4_000, 4_096), (3, 9)):
        found = vectors.nearest(df, df.where("vec_id % 10 = 0"), 5, most, size)
        assert {tuple(r) for r in found.collect()} == want
        assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert vectors.nearest(df, df.limit(0), 5).count() == 0


def test_texts_are_read_once_for_all_rounds(spark):
    """The features' source is computed once, however many passes and rounds follow."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(40).selectExpr("id", "CAST(id % 7 AS double) AS a", "CAST(id % 3 AS double) AS b").mapInArrow(counted, "id long, a double, b double")
    assert sum(r["size"] for r in kmeans.clustered(df, ["a", "b"], 3, 2)[2].collect()) == 40
    assert seen.value == 40
