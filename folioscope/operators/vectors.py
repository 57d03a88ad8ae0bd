"""Vectors and signatures: cosine, centroids, nearest rows of a query set, MinHash candidates."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..registry import register

DIMENSIONS = 64
PERMUTATIONS, ROWS_IN_BAND, SHINGLE = 32, 4, 3
PRIME = 4294967291


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-9, dot(a, b) / norm).otherwise(0.0)


def centroids(df: DataFrame, group: str, vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(group, n, centroid): the mean vector of each group, scaled to length 1; one pass with partial sums."""
    mean = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dimensions))).alias("m"))
    length = F.sqrt(dot(F.col("m"), F.col("m")))
    return mean.select(group, "n", F.when(length > 1e-9, F.transform("m", lambda x: x / length)).otherwise(F.col("m")).alias("centroid"))


def nearest(df: DataFrame, queries: DataFrame, k: int, most: int = 4_000, rows: int = 4_096) -> DataFrame:
    """(query_id, vec_id, similarity): the k rows most like each query, ties by id; a stated query set against all rows.

    Each row meets each query, in products of a block of about ``rows`` rows with one of
    about ``most`` queries. Ids are integers. A pair of blocks leaves k rows a query, which
    a ranking merges; a row is sent once for each block of queries. Similarity is 0 where a
    vector is null, of another length than the longest query, or has almost no length.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    d, parts, slices = max(size["d"] or 0, 0), max(1, -(-size["n"] // most)), max(1, -(-df.count() // rows))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", block("vec_id", slices).alias("s"), every(parts).alias("b"))
    right = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding", every(slices).alias("s"), block("vec_id", parts).alias("b"))

    def matrix(column) -> np.ndarray:
        """Vectors as rows scaled to length 1, in double precision; zeros for a vector that is null, of another length, of almost no length, or holds what is no number."""
        out = np.zeros((len(column), d))
        for i, x in enumerate(column.to_pylist()):
            if x is not None and len(x) == d and None not in x:
                out[i] = x
        length = np.linalg.norm(out, axis=1)
        fit = np.isfinite(length) & (length > 1e-9)
        out[~fit] = 0.0
        return out / np.where(fit, length, 1.0)[:, None]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that of equal similarities the smaller ids stay
        ids, x, q = ids[order], matrix(a.column("embedding"))[order], matrix(b.column("embedding"))
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for at in range(0, len(asked) if len(ids) else 0, 256):
            near = np.round(q[at : at + 256] @ x.T, 6)
            for i, row in enumerate(near):
                own = asked[at + i]
                row[ids == own] = -np.inf
                floor = np.partition(row, len(ids) - k)[len(ids) - k] if len(ids) > k else -2.0
                some = np.flatnonzero((row >= floor) & (row > -2.0))
                some = some[np.argsort(-row[some], kind="stable")[:k]]
                for into, values in zip(found, (np.full(len(some), own), ids[some], row[some] + 0.0), strict=True):
                    into.append(values)
        return pa.table([np.concatenate(x) for x in found], names=["query_id", "vec_id", "similarity"])

    pairs = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(best, "query_id long, vec_id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    out = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")
    return out.select(F.col("query_id").cast(queries.schema["vec_id"].dataType), F.col("vec_id").cast(df.schema["vec_id"].dataType), "similarity")


def most_similar(rows: DataFrame, centres: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """(family_id, id, similarity): the k rows most like each centre, out of all rows (id, embedding); ties by id.

    Centres (family_id, centroid) go to the tasks in blocks of at most ``block`` by a hash,
    counted first, so a broadcast is bounded whatever their number. A task multiplies its
    batches with a block and keeps a heap of k rows for each centre; the heaps are merged
    by a ranking that needs k rows a task and centre. Nothing is left out: a centre meets
    every row.
    """
    parts = -(-centres.count() // (block // 2)) or 1
    numbered = centres.select("family_id", "centroid").withColumn("_b", F.pmod(F.xxhash64("family_id"), F.lit(parts)))
    kind, owner = rows.schema["id"].dataType, centres.schema["family_id"].dataType
    out = None
    for b in range(parts):
        some = [(r["family_id"], r["centroid"]) for r in numbered.where(F.col("_b") == b).limit(block + 1).collect()]  # a block of centres
        if len(some) > block:
            raise ValueError("centres fall unevenly into blocks: raise block")
        if not some:
            continue
        shared = rows.sparkSession.sparkContext.broadcast(some)

        def best(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            families, matrix = [f for f, _ in shared.value], np.array([c for _, c in shared.value], np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            unit = matrix / np.where(norms > 1e-9, norms, 1.0)[:, None] * (norms > 1e-9)[:, None]
            heaps: list[list] = [[] for _ in families]
            for batch in batches:
                ids = batch.column("id").to_pylist()
                x = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
                if not len(ids):
                    continue
                length = np.linalg.norm(x, axis=1)
                cosines = np.round((x / np.where(length > 1e-9, length, 1.0)[:, None] * (length > 1e-9)[:, None]) @ unit.T, 6)
                for c, heap in enumerate(heaps):
                    column = cosines[:, c]
                    floor = np.partition(column, len(ids) - k)[len(ids) - k] if len(ids) > k else -2.0
                    heaps[c] = heapq.nsmallest(k, [*heap, *((-float(column[i]), ids[i]) for i in np.flatnonzero(column >= floor))])
            found = [(families[c], i, -s) for c, heap in enumerate(heaps) for s, i in heap]
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.float64())], names=["family_id", "id", "similarity"])

        part = rows.where("embedding is not null").select("id", "embedding").mapInArrow(best, f"family_id {owner.simpleString()}, id {kind.simpleString()}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return centres.join(rows.select("id", F.lit(0.0).alias("similarity")), F.lit(False)).select("family_id", "id", "similarity")
    order = W.partitionBy("family_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def similar_or_linked(rows: DataFrame, centres: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(family_id, id, similarity, by): ``most_similar``, and for families without a centre their k active links of most confidence."""
    near = most_similar(rows, centres, k).withColumns({"similarity": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")), 4), "by": F.lit("centroid")})
    other = links.where("status = 'active'").join(centres.select("family_id").distinct(), "family_id", "left_anti")
    order = W.partitionBy("family_id").orderBy(F.desc("confidence"), "id")
    ranked = other.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return near.unionByName(ranked.select("family_id", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")), 4).alias("similarity"), F.lit("link").alias("by")))


def signatures(texts: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, m0, m1, ...): MinHash over word shingles; texts with fewer words have none."""
    words = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = texts.select("doc_id", words.alias("w")).where(F.size("w") >= shingle)
    rows = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (shingle - 1)), lambda i: F.array_join(F.slice("w", i, shingle), " "))).alias("s"))
    rows = rows.select("doc_id", F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long").alias("h"))
    return rows.groupBy("doc_id").agg(*(F.min((F.lit(a) * F.col("h") + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(_coefficients(permutations))))


def _coefficients(n: int) -> list[tuple[int, int]]:
    """Pairs for (a h + b) mod PRIME, by a linear rule; a is under 2**31, so that products stay in 63 bits."""
    return [((48271 * (i + 1) ** 2 + 12345) % 2147483629 + 1, (69621 * (i + 7) ** 3 + 1) % PRIME) for i in range(n)]


def minhash_candidates(texts: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS_IN_BAND) -> DataFrame:
    """(doc_id, first, similarity): each document beside the first of a band's group, with the share of equal minima.

    A group gives as many rows as documents, not pairs: its members reach one another over the first.
    """
    s = signatures(texts, permutations)
    band = lambda k: F.concat_ws(",", F.lit(k), *(f"m{k * rows + j}" for j in range(rows)))
    banded = s.select("doc_id", F.explode(F.array(*(band(k) for k in range(permutations // rows)))).alias("band"))
    firsts = banded.groupBy("band").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    pairs = banded.join(firsts, "band").where("doc_id <> first").select("doc_id", "first").distinct()
    other = s.select(F.col("doc_id").alias("first"), *(F.col(f"m{i}").alias(f"o{i}") for i in range(permutations)))
    same = sum(((F.col(f"m{i}") == F.col(f"o{i}")).cast("int") for i in range(permutations)), F.lit(0))
    return pairs.join(s, "doc_id").join(other, "first").select("doc_id", "first", F.round(same / permutations, 6).alias("similarity"))


def _embeddings(spark, d) -> DataFrame:
    return v.table(spark, d, "embeddings")


_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_CENTROIDS = """c AS (SELECT label, list(m ORDER BY i) AS embedding, max(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
register(
    "family_centroids",
    lambda spark, d: centroids(_embeddings(spark, d), "label").select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("x0"), F.round(F.get("centroid", F.lit(63)), 6).alias("x63")),
    f"WITH {_CENTROIDS} SELECT label, n, round(embedding[1] / sqrt(list_inner_product(embedding, embedding)), 6) AS x0, round(embedding[64] / sqrt(list_inner_product(embedding, embedding)), 6) AS x63 FROM c",
)
register(
    "similar_to_centroid",
    # One centroid for each label, ten here; a family has one, so their number is that of families.
    lambda spark, d: _embeddings(spark, d).join(F.broadcast(centroids(_embeddings(spark, d), "label").select("label", "centroid")), "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity")),
    f"WITH {_CENTROIDS} SELECT a.vec_id, a.label, round({_COS}, 6) AS similarity FROM embeddings a JOIN c b ON a.label = b.label",
)
register(
    "nearest_vectors",
    lambda spark, d: nearest(_embeddings(spark, d), _embeddings(spark, d).where("vec_id % 100 = 0"), 5),
    f"SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM (SELECT b.vec_id AS query_id, a.vec_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE k <= 5",
)
register(
    "vector_families_compare",
    lambda spark, d: centroids(_embeddings(spark, d), "label").alias("x").join(F.broadcast(centroids(_embeddings(spark, d), "label")).alias("y"), F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(cosine(F.col("x.centroid"), F.col("y.centroid")), 6).alias("similarity")),
    f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, round({_COS}, 6) AS similarity FROM c a JOIN c b ON a.label < b.label",
)


def _similar(spark, d) -> DataFrame:
    """Centres of all labels but one, which has links instead."""
    rows = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding", "label")
    centres = centroids(rows.where("label <> 3").withColumn("family_id", F.concat(F.lit("family "), "label")), "family_id").select("family_id", "centroid")
    links = rows.select(F.concat(F.lit("family "), "label").alias("family_id"), "id", F.when(F.col("id") % 2 == 0, "active").otherwise("unlinked").alias("status"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 999.0).alias("confidence"))
    return similar_or_linked(rows, centres, links, 10)


register(
    "similar_sections",
    _similar,
    f"""WITH {_CENTROIDS}, f AS (SELECT label, embedding FROM c WHERE label <> 3), p AS (SELECT 'family ' || b.label AS family_id, a.vec_id AS id, round({_COS}, 6) AS s FROM embeddings a, f b),
r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY s DESC, id) AS k FROM p), l AS (SELECT 'family 3' AS family_id, vec_id AS id, (vec_id * 7919 % 1000) / 999.0::DOUBLE AS confidence FROM embeddings WHERE label = 3 AND vec_id % 2 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY confidence DESC, id) AS k FROM l)
SELECT family_id, id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)), 4) AS similarity, 'centroid' AS "by" FROM r WHERE k <= 10 UNION ALL SELECT family_id, id, round(confidence, 4), 'link' FROM q WHERE k <= 10""",
)
_W = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"
_SIG = f"""WITH w AS (SELECT doc_id, unnest({_W}) AS w, unnest(range(1, len({_W}) + 1)) AS i FROM documents),
g AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM g WHERE s IS NOT NULL),
sig AS (SELECT doc_id, {", ".join(f"min(({a}::BIGINT * h + {b}) % {PRIME}) AS m{i}" for i, (a, b) in enumerate(_coefficients(PERMUTATIONS)))} FROM h GROUP BY 1)
"""
_BANDS = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, m{4 * k}::VARCHAR || ',' || m{4 * k + 1} || ',' || m{4 * k + 2} || ',' || m{4 * k + 3} AS band FROM sig" for k in range(PERMUTATIONS // ROWS_IN_BAND))
register("minhash_signatures", lambda spark, d: signatures(v.table(spark, d, "documents")).select("doc_id", "m0", "m7", "m31"), _SIG + "SELECT doc_id, m0, m7, m31 FROM sig")
register(
    "minhash_candidates",
    lambda spark, d: minhash_candidates(v.table(spark, d, "documents")),
    _SIG + f""", b AS ({_BANDS}), f AS (SELECT k, band, min(doc_id) AS first FROM b GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT DISTINCT doc_id, first FROM b JOIN f USING (k, band) WHERE doc_id <> first)
SELECT p.doc_id, p.first, round(({" + ".join(f"(x.m{i} = y.m{i})::INT" for i in range(PERMUTATIONS))}) / {PERMUTATIONS}.0::DOUBLE, 6) AS similarity FROM p JOIN sig x ON x.doc_id = p.doc_id JOIN sig y ON y.doc_id = p.first""",
)
