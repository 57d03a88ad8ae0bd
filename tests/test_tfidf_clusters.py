"""Clusters by TF-IDF cosine against a plain version that looks at all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

from folioscope.operators import clustering, tfidf_clusters
from folioscope.operators.tfidf_clusters import Cosine


def texts():
    r = random.Random(7)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(400)]
    out = [None, "", " \n\t", "a", "A", "Short  words\tHERE", "short words here", "short words here short words here", "Überfluß über ÜBER naïve"]
    for size in (1, 2, 3, 6, 20):
        base = [r.choice(pool) for _ in range(60)]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randint(0, 25)):
                words[r.randrange(60)] = r.choice(pool)
            out.append(" ".join(words))
        out += [" ".join(base)] * (size % 4)
    chain = [r.choice(pool) for _ in range(60)]
    for k in range(20):
        chain[(7 * k) % 60] = f"new{k}word"
        out.append(" ".join(chain))
    return out + [" ".join(r.choice(pool) for _ in range(2000)), *(" ".join(r.choice(pool) for _ in range(30)) for _ in range(15))]


def plain(docs, eps, min_samples, least, most, features):
    """{id: (kind, cluster, confidence)}; n-grams by slicing each padded word."""
    counts = {}
    for i, text in docs:
        c = Counter()
        for word in (text or "").lower().split():
            w = f" {word} "
            for n in range(least, most + 1):
                if n >= len(w):
                    c[w] += 1
                    break
                for k in range(len(w) - n + 1):
                    c[w[k : k + n]] += 1
        counts[i] = c
    uses, df = Counter(), Counter()
    for c in counts.values():
        uses.update(c)
        df.update(c.keys())
    kept = sorted(uses, key=lambda g: (-uses[g], g.encode()))[:features]
    at = {g: k for k, g in enumerate(kept)}
    x = np.zeros((len(docs), len(kept)))
    for r, (i, _) in enumerate(docs):
        for g, n in counts[i].items():
            if g in at:
                x[r, at[g]] = n * (math.log((1 + len(docs)) / (1 + df[g])) + 1)
    length = np.sqrt((x * x).sum(axis=1))
    some = length > 0
    x[some] /= length[some, None]
    near = (x @ x.T >= 1 - eps - 1e-9) & ~np.eye(len(docs), dtype=bool)
    core = some & (near.sum(axis=1) + 1 >= min_samples)
    label = {}
    for s in range(len(docs)):
        todo = [s] if core[s] and s not in label else []
        for y in todo:
            label.setdefault(y, s)
            todo += [z for z in np.flatnonzero(near[y] & core).tolist() if z not in label and not label.update({z: s})]
    for s in range(len(docs)):
        beside = [label[z] for z in np.flatnonzero(near[s] & core).tolist()]
        if not core[s] and beside:
            label[s] = min(beside)
    out = {}
    for r, (i, _) in enumerate(docs):
        if r not in label:
            out[i] = ("noise", None, 0.0)
            continue
        mean = sum(x[z] for z, c in label.items() if c == label[r])
        out[i] = ("core" if core[r] else "border", docs[label[r]][0], float(x[r] @ mean / np.sqrt(mean @ mean)))
    return out


@pytest.mark.parametrize(("eps", "features", "tile"), [(0.34, 20_000, 512), (0.5, 300, 512), (0.34, 20_000, 4)])
def test_equals_plain_version(spark, monkeypatch, eps, features, tile):
    monkeypatch.setattr(clustering, "TILE", tile)
    docs = list(enumerate(texts(), 100))
    want = plain(docs, eps, 3, 3, 5, features)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["kind"], r["cluster"], r["confidence"]) for r in tfidf_clusters.tfidf_clusters(df, eps, 3, 3, 5, features).collect()}
    assert got.keys() == want.keys() and {k: x[:2] for k, x in got.items()} == {k: x[:2] for k, x in want.items()}
    assert all(got[k][2] == pytest.approx(want[k][2], abs=2e-6) for k in want)
    assert len({x[0] for x in got.values()}) == 3 and len({x[1] for x in got.values()}) >= 3  # two clusters at least, and none


def test_prefixes_lose_no_pair():
    r = np.random.default_rng(3)
    x = r.random((60, 40)) ** 4 * (r.random((60, 40)) < 0.5)
    x[30:] = x[:30] + r.random((30, 40)) * 0.2 * (x[:30] > 0)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    for eps in (0.05, 0.3, 0.6):
        prefix = [set(np.flatnonzero((np.sqrt(np.cumsum((v * v)[::-1])[::-1]) >= 1 - eps) & (v > 0)).tolist()) for v in x]
        for a in range(60):
            for b in range(a):
                assert x[a] @ x[b] < 1 - eps or prefix[a] & prefix[b]


def test_wide_tiles_are_laid_out_in_blocks(monkeypatch):
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 50, 20)) for _ in range(12)]
    group = {"side": np.zeros(12, int), "lo": np.zeros(12, int), "hi": np.zeros(12, int), "bucket": np.full(12, 7), "prefix": np.full(12, 5)}
    for n, of in (("features", lambda f: f), ("values", lambda f: np.full(len(f), len(f) ** -0.5))):
        group[n] = np.empty(12, object)
        group[n][:] = [of(f) for f in rows]
    whole = [x.copy() for x in next(iter(Cosine(0.7).compared(group)))]
    monkeypatch.setattr(tfidf_clusters, "WIDE", 8)
    for x, y in zip(whole, next(iter(Cosine(0.7).compared(group))), strict=True):
        assert (x == y).all()


def test_empty_tables_and_null_ids(spark):
    kind = "doc_id long, text string, kind string"
    assert tfidf_clusters.tfidf_clusters(spark.createDataFrame([], kind)).count() == 0
    got = tfidf_clusters.tfidf_clusters(spark.createDataFrame([(None, "a", "x"), (1, None, "y"), (2, "b", None), (3, "b", None)], kind), min_samples=2).collect()
    assert {tuple(r) for r in got} == {(1, "noise", None, 0.0), (2, "core", 2, 1.0), (3, "core", 2, 1.0)}


_QUERY = {"eps": 0.34, "min_samples": 3, "least": 5, "most": 7, "features": 20_000}
_NEAR = 1 - _QUERY["eps"] - tfidf_clusters.SLACK
_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, unnest(list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '{clustering.SPACES}', ' ', 'g'), ' ')), ' '), lambda w: w <> '')) AS w FROM documents),
w AS (SELECT doc_id, ' ' || w || ' ' AS w, count(*) AS n FROM t GROUP BY 1, 2),
s AS (SELECT doc_id, w, n, unnest(range({_QUERY["least"]}, {_QUERY["most"]} + 1)) AS size FROM w),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, greatest(length(w) - size + 1, 1) + 1), lambda i: substring(w, i, size))) AS gram FROM s WHERE size = {_QUERY["least"]} OR size <= length(w)),
tf AS (SELECT doc_id, gram, sum(n) AS tf FROM g GROUP BY 1, 2),
f AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, gram LIMIT {_QUERY["features"]}),
x AS (SELECT doc_id, gram, tf * idf AS x FROM tf JOIN f USING (gram)),
u AS MATERIALIZED (SELECT doc_id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM x),
half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= {_NEAR}),
pair AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
core AS MATERIALIZED (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM u) LEFT JOIN pair ON a = doc_id GROUP BY 1 HAVING count(b) + 1 >= {_QUERY["min_samples"]}),
near AS MATERIALIZED (SELECT a, b FROM pair WHERE b IN (SELECT doc_id FROM core)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM core UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b AND r.b IN (SELECT doc_id FROM core)),
named AS (SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY 1),
beside AS (SELECT a AS doc_id, min(cluster) AS cluster FROM near JOIN named ON doc_id = b GROUP BY 1),
m AS (SELECT d.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 'core' WHEN b.doc_id IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(n.cluster, b.cluster) AS cluster FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN beside b USING (doc_id)),
c AS (SELECT cluster, gram, sum(x) AS c FROM m JOIN u USING (doc_id) WHERE cluster IS NOT NULL GROUP BY 1, 2),
l AS (SELECT cluster, sqrt(sum(c * c)) AS l FROM c GROUP BY 1),
p AS (SELECT doc_id, sum(x * c) AS p FROM m JOIN u USING (doc_id) JOIN c USING (cluster, gram) GROUP BY 1)
SELECT doc_id, kind, cluster, CASE WHEN cluster IS NULL THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, p / l), 6) END AS confidence FROM m LEFT JOIN l USING (cluster) LEFT JOIN p USING (doc_id)"""


def test_equals_sql_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert compare(tfidf_clusters.tfidf_clusters(docs, **_QUERY), connect(sf_dir), _SQL) is None
