"""Density clusters against a plain DBSCAN, their confidence, and the recall of signatures."""

import random
from collections import defaultdict

import numpy as np
import pytest

from folioscope.operators import clustering
from folioscope.plans import stages

EPS, PERMUTATIONS = 0.3, 64


def texts():
    r = random.Random(4)
    pool = [f"word{k}" for k in range(300)]
    line = lambda n: [r.choice(pool) for _ in range(n)]
    out = [None, "", "  \n", "short", "short", "tiny one"]
    for size in (1, 2, 3, 5, 12, 25):
        base = line(120)
        for _ in range(size):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(pool)
            out.append(" ".join(words))
        out += [" ".join(base)] * (size % 4)
    base = line(120)  # a dense group, and texts that are near few of its members
    for k in range(8):
        words = list(base)
        words[10 * k : 10 * k + 4 + k] = line(4 + k)
        out.append(" ".join(words))
    chain = line(120)  # each step is near the one before only
    for k in range(30):
        chain[(7 * k) % 120] = f"new{k}"
        chain[(7 * k + 3) % 120] = f"other{k}"
        out.append(" ".join(chain))
    return out + [" ".join(line(80)) for _ in range(15)]


def plain(docs, eps, least):
    """{id: (kind, cluster, confidence)} by looking at all pairs, clusters grown from the least core on."""
    factors = clustering.coefficients(PERMUTATIONS)
    sig = {}
    for i, text in docs:
        h = [int(x) for x in clustering.shingle_hashes(" ".join((text or "").split()), 5)]
        sig[i] = np.array([min((a * x + b) % 2**32 for x in h) for a, b in factors])
    same = lambda a, b: int((sig[a] == sig[b]).sum())
    far = clustering.cut(PERMUTATIONS, eps)[0]
    near = {a: [b for b in sig if b != a and same(a, b) >= PERMUTATIONS - far] for a in sig}
    core = {a for a in sig if len(near[a]) + 1 >= least}
    cluster = {}
    for seed in sorted(core):
        if seed in cluster:
            continue
        cluster[seed], todo = seed, [seed]
        while todo:
            a = todo.pop()
            for b in near[a] if a in core else []:
                if b not in cluster:
                    cluster[b] = seed
                    todo.append(b)
    out = {}
    members = defaultdict(list)
    for i, c in cluster.items():
        members[c].append(i)
    for i in sig:
        c = cluster.get(i)
        others = [same(i, j) / PERMUTATIONS for j in members[c] if j != i] if c is not None else []
        sure = 0.0 if c is None else (sum(others) / len(others) if others else 1.0)
        out[i] = ("core" if i in core else "border" if c is not None else "noise", c, round(sure, 6))
    return out


@pytest.fixture(scope="module")
def rows():
    found = texts()
    order = list(range(len(found)))
    random.Random(1).shuffle(order)
    return [(10 * k + 3, found[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize(("tile", "least"), [(512, 13), (5, 13), (5, 2)])
def test_equals_plain_dbscan(spark, rows, monkeypatch, tile, least):
    monkeypatch.setattr(clustering, "TILE", tile)
    monkeypatch.setattr(clustering, "ROWS", 3 if tile == 5 else 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["kind"], r["cluster"], r["confidence"]) for r in clustering.template_clusters(docs, EPS, least, 5, PERMUTATIONS).collect()}
    want = plain(rows, EPS, least)
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 2e-6 for i in want)
    assert {x[0] for x in want.values()} >= ({"core", "border", "noise"} if least == 13 else {"core"})


def test_no_document_and_no_id(spark):
    assert clustering.template_clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = clustering.template_clusters(spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "noise", None, 0.0)]


def test_recall_of_similar_texts(spark, rows):
    """Of the pairs with a Jaccard similarity of 0.8 or more, at least 0.9 are neighbours at eps 0.34."""
    docs = [(i, " ".join((t or "").split())) for i, t in rows if t and len(t) > 50]
    sets = {i: {t[k : k + 7] for k in range(len(t) - 6)} for i, t in docs}
    signed = clustering.char_signatures(spark.createDataFrame(docs, "doc_id long, text string"))
    sig = {r["doc_id"]: np.array(r["signature"]) for r in signed.collect()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = clustering.cut(clustering.PERMUTATIONS, 0.34)[0]
    met = sum((sig[a] == sig[b]).sum() >= clustering.PERMUTATIONS - far for a, b in alike)
    assert len(alike) > 100 and met >= 0.9 * len(alike)


def test_every_pair_of_neighbours_shares_a_band():
    r = np.random.default_rng(3)
    for eps in (0.1, 0.2, 0.34, 0.5):
        far, bounds = clustering.cut(PERMUTATIONS, eps)
        for _ in range(200):
            differs = np.zeros(PERMUTATIONS, bool)
            differs[r.choice(PERMUTATIONS, far, replace=False)] = True
            assert any(not differs[a:b].any() for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def test_components(spark):
    r = random.Random(9)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    best = {x: x for pair in links for x in pair}
    while True:
        before = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
        if before == best:
            break
    got = {x["id"]: x["component"] for x in stages.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in best.items() if any(x in p and p[0] != p[1] for p in links)}
    assert stages.components(spark.createDataFrame([], "a long, b long")).count() == 0
