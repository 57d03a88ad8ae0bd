"""Window functions, ordering, sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..plans.ranks import value_ranks
from ..registry import register


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


register(
    "dedup_latest",
    lambda spark, d: latest(v.links(spark, d), ["doc_id", "family_id"], [F.desc("created_at"), F.desc("link_id")]).select("doc_id", "family_id", "link_id"),
    v.with_views("links") + "SELECT doc_id, family_id, link_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, family_id ORDER BY created_at DESC, link_id DESC) AS k FROM links) WHERE k = 1",
)


def stratified(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, each group by its share and at least one, drawn by hash of the key."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_g"))
    df = df.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_k") <= max(1, n))  # a literal bound, which ranks within tasks first
    df = df.join(sizes, group).join(F.broadcast(total), F.lit(True))  # one row
    return df.where(F.col("_k") <= F.greatest(F.lit(1), F.rint(F.col("_g") * F.lit(float(n)) / F.col("_t")).cast("int"))).drop("_k", "_g", "_t")


register(
    "stratified_sample",
    lambda spark, d: stratified(v.documents(spark, d).select("doc_id", "template_family"), "template_family", "doc_id", 100),
    v.with_views("docs") + "SELECT doc_id, template_family FROM (SELECT *, row_number() OVER (PARTITION BY template_family ORDER BY md5(doc_id || '|42')) AS k, count(*) OVER (PARTITION BY template_family) AS g, count(*) OVER () AS t FROM docs) WHERE k <= greatest(1, CAST(g * 100.0::DOUBLE / t AS INTEGER))",
)
register(
    "hash_sample",
    lambda spark, d: v.documents(spark, d).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7"))).alias("key")).orderBy("key").limit(50),
    "SELECT doc_id, md5(doc_id || '|7') AS key FROM documents ORDER BY key LIMIT 50",
)
register(
    "numbering_gap",
    lambda spark, d: v.links(spark, d).withColumn("prev", F.lag("link_id").over(W.partitionBy("doc_id").orderBy("link_id"))).where(F.col("link_id") - F.col("prev") > 5000).select("doc_id", "link_id", "prev"),
    v.with_views("links") + "SELECT * FROM (SELECT doc_id, link_id, lag(link_id) OVER (PARTITION BY doc_id ORDER BY link_id) AS prev FROM links) WHERE link_id - prev > 5000",
)
register(
    "depth_reset",
    lambda spark, d: v.clauses(spark, d).withColumn("prev", F.lag("depth").over(W.partitionBy("doc_id").orderBy("clause_number"))).where("prev >= 4 and depth = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("resets")),
    v.with_views("clauses") + "SELECT doc_id, count(*) AS resets FROM (SELECT doc_id, depth, lag(depth) OVER (PARTITION BY doc_id ORDER BY clause_number) AS prev FROM clauses) WHERE prev >= 4 AND depth = 1 GROUP BY doc_id",
)


def candidate_merge(spark, d):
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "pending_review", 1).otherwise(2)
    return latest(v.links(spark, d), ["doc_id", "section_number"], [rank, F.desc("confidence"), F.col("link_id")]).select("doc_id", "section_number", "link_id", "status")


register(
    "candidate_merge",
    candidate_merge,
    v.with_views("links") + "SELECT doc_id, section_number, link_id, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_number ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'pending_review' THEN 1 ELSE 2 END, confidence DESC, link_id) AS k FROM links) WHERE k = 1",
)
register(
    "retention_topn",
    lambda spark, d: v.table(spark, d, "events").withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")).where("k <= 30").select("event_id", "event_type", "k"),
    "SELECT event_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 30",
)


def empirical_rank(df: DataFrame, value: str, key: str) -> DataFrame:
    """Share of rows at or below each row's value."""
    cdf = value_ranks(df, value).select(F.col("value").alias(value), ((F.col("below") + F.col("n")) / F.col("total")).alias("cdf"))
    return df.select(key, value).join(cdf, value)


register(
    "percentile_rank",
    lambda spark, d: empirical_rank(v.documents(spark, d), "text_length", "doc_id").select("doc_id", "text_length", F.round("cdf", 6).alias("cdf")),
    v.with_views("docs") + "SELECT doc_id, text_length, round(cume_dist() OVER (ORDER BY text_length), 6) AS cdf FROM docs",
)


def spearman(spark, d):
    """Correlation of mean ranks within each family; ranks come from counts of distinct values."""
    df = v.documents(spark, d).select("template_family", "text_length", "word_count")
    for column, name in (("text_length", "a"), ("word_count", "b")):
        ranks = value_ranks(df.select("template_family", column), column, "template_family")
        ranks = ranks.select(F.col("template_family").alias("_f"), F.col("value").alias("_v"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))
        df = df.join(ranks, F.col("template_family").eqNullSafe(F.col("_f")) & (F.col(column) == F.col("_v"))).drop("_f", "_v")
    return df.groupBy("template_family").agg(F.round(F.corr("a", "b"), 4).alias("spearman"), F.count(F.lit(1)).alias("n")).where("n >= 3")


register(
    "spearman",
    spearman,
    v.with_views("docs")
    + """, r AS (SELECT template_family, rank() OVER (PARTITION BY template_family ORDER BY text_length) + (count(*) OVER (PARTITION BY template_family, text_length) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY template_family ORDER BY word_count) + (count(*) OVER (PARTITION BY template_family, word_count) - 1) / 2.0 AS b FROM docs)
SELECT template_family, round(corr(a, b), 4) AS spearman, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 3""",
)
register(
    "pearson",
    lambda spark, d: v.documents(spark, d).groupBy("market_segment").agg(F.round(F.coalesce(F.corr("text_length", "word_count"), F.lit(0.0)), 4).alias("pearson")),
    v.with_views("docs") + "SELECT market_segment, round(coalesce(corr(text_length, word_count), 0), 4) AS pearson FROM docs GROUP BY 1",
)


def robust_z(df: DataFrame, group: str, value: str) -> DataFrame:
    """0.6745 (x - median) / MAD by group; 0 where the MAD vanishes."""
    mid = df.groupBy(group).agg(F.median(value).alias("_med"))
    df = df.join(mid, group).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = df.groupBy(group).agg(F.median("_dev").alias("_mad"))
    return df.join(mad, group).withColumn("z", F.when(F.col("_mad") > 1e-9, F.round(0.6745 * (F.col(value) - F.col("_med")) / F.col("_mad"), 4)).otherwise(0.0)).drop("_med", "_dev", "_mad")


register(
    "robust_z",
    lambda spark, d: robust_z(v.documents(spark, d).select("doc_id", "template_family", "word_count"), "template_family", "word_count").where("abs(z) > 3.5").select("doc_id", "template_family", "z"),
    v.with_views("docs")
    + """, m AS (SELECT template_family, median(word_count) AS med FROM docs GROUP BY 1), v AS (SELECT doc_id, template_family, word_count, med, abs(word_count - med) AS dev FROM docs JOIN m USING (template_family)), a AS (SELECT template_family, median(dev) AS mad FROM v GROUP BY 1),
z AS (SELECT doc_id, template_family, CASE WHEN mad > 1e-9 THEN round(0.6745::DOUBLE * (word_count - med) / mad, 4) ELSE 0 END AS z FROM v JOIN a USING (template_family)) SELECT * FROM z WHERE abs(z) > 3.5""",
)


def zscores(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Root mean square of population z-scores over the columns."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    df = df.join(F.broadcast(stats), F.lit(True))  # one row
    return df.select(key, F.sqrt(reduce(lambda a, b: a + b, (z(c) * z(c) for c in columns)) / len(columns)).alias("rms"))


register(
    "anomaly_scores",
    lambda spark, d: zscores(v.documents(spark, d), ["text_length", "word_count"], "doc_id").where("rms >= 2.5").select("doc_id", F.round("rms", 4).alias("rms")),
    v.with_views("docs") + ", s AS (SELECT avg(text_length) AS a, stddev_pop(text_length) AS sa, avg(word_count) AS b, stddev_pop(word_count) AS sb FROM docs) SELECT doc_id, round(rms, 4) AS rms FROM (SELECT doc_id, sqrt((((text_length - a) / sa) ** 2 + ((word_count - b) / sb) ** 2) / 2) AS rms FROM docs, s) WHERE rms >= 2.5",
)


def adjacency(spark, d, reach: int = 2, least: int = 3):
    """First words of headings at distance 1..reach, with how often and in how many documents."""
    s = v.sections(spark, d).select("doc_id", "section_number", F.lower(F.regexp_extract("heading", "^([A-Za-z]+)", 1)).alias("word"))
    order = W.partitionBy("doc_id").orderBy("section_number")
    s = s.select("doc_id", "word", F.array(*(F.struct(F.lit(k).cast("long").alias("distance"), F.lead("word", k).over(order).alias("next")) for k in range(1, reach + 1))).alias("x"))
    s = s.select("doc_id", "word", F.explode("x").alias("x"))
    s = s.select("doc_id", "word", "x.*").where("next is not null and word <> '' and next <> ''")
    return s.groupBy("word", "next", "distance").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).where(F.col("n") >= least)


register(
    "adjacency",
    adjacency,
    v.with_views("sections")
    + """, s AS (SELECT doc_id, section_number, lower(regexp_extract(heading, '^([A-Za-z]+)', 1)) AS word FROM sections)
SELECT a.word, b.word AS next, b.section_number - a.section_number AS distance, count(*) AS n, count(DISTINCT a.doc_id) AS docs FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.section_number - a.section_number BETWEEN 1 AND 2 WHERE a.word <> '' AND b.word <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
register(
    "support_ratios",
    lambda spark, d: v.links(spark, d).groupBy("family_id", "section_number").agg(F.count(F.lit(1)).alias("n")).withColumn("support", F.round(F.col("n") / F.sum("n").over(W.partitionBy("family_id")), 6)),
    v.with_views("links") + "SELECT family_id, section_number, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY family_id)::DOUBLE, 6) AS support FROM links GROUP BY 1, 2",
)
register(
    "truncation",
    lambda spark, d: v.documents(spark, d).orderBy(F.desc("word_count"), "doc_id").limit(101).agg(F.least(F.count(F.lit(1)), F.lit(100)).cast("long").alias("shown"), (F.count(F.lit(1)) > 100).alias("more")),
    "SELECT least(count(*), 100) AS shown, count(*) > 100 AS more FROM (SELECT 1 FROM documents LIMIT 101)",
)
register(
    "priority_queue",
    lambda spark, d: v.links(spark, d).where("status = 'pending_review'").select("link_id", "doc_id", F.round(1 - F.abs(F.col("confidence") - 0.5) * 2, 6).alias("priority")).orderBy(F.desc("priority"), "doc_id", "link_id").limit(100),
    v.with_views("links") + "SELECT link_id, doc_id, round(1 - abs(confidence - 0.5::DOUBLE) * 2, 6) AS priority FROM links WHERE status = 'pending_review' ORDER BY priority DESC, doc_id, link_id LIMIT 100",
)


def anomalies_union(spark, d):
    docs, s, c = v.documents(spark, d), v.sections(spark, d), v.clauses(spark, d)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "doc_id")
    few = docs.where("word_count < 10")
    blank = s.where(F.trim("heading") == "").select("doc_id").distinct()
    deep = c.groupBy("doc_id").agg(F.max("depth").alias("m"), F.count(F.lit(1)).alias("n")).where("m >= 4 and n <= 3")
    unlinked = docs.join(v.links(spark, d).select("doc_id"), "doc_id", "left_anti").where("cohort")
    return reduce(DataFrame.unionByName, (kind(few, "few words"), kind(blank, "blank heading"), kind(deep, "deep and short"), kind(unlinked, "no link")))


register(
    "anomalies_union",
    anomalies_union,
    v.with_views("docs", "sections", "clauses", "links")
    + """SELECT 'few words' AS kind, doc_id FROM docs WHERE word_count < 10 UNION ALL SELECT DISTINCT 'blank heading', doc_id FROM sections WHERE trim(heading) = ''
UNION ALL SELECT 'deep and short', doc_id FROM clauses GROUP BY doc_id HAVING max(depth) >= 4 AND count(*) <= 3 UNION ALL SELECT 'no link', doc_id FROM docs WHERE cohort AND doc_id NOT IN (SELECT doc_id FROM links)""",
)
register(
    "distinct_scopes",
    lambda spark, d: v.links(spark, d).select(F.col("family_id").alias("scope")).union(v.table(spark, d, "customer").select("c_mktsegment")).distinct(),
    "SELECT o_orderpriority AS scope FROM orders UNION SELECT c_mktsegment FROM customer",
)
register(
    "set_difference",
    lambda spark, d: v.documents(spark, d).where("cohort").select("doc_id").exceptAll(v.links(spark, d).where("confidence > 0.4").select("doc_id").distinct()),
    v.with_views("docs", "links") + "SELECT doc_id FROM docs WHERE cohort EXCEPT SELECT doc_id FROM links WHERE confidence > 0.4",
)
register(
    "set_intersection",
    lambda spark, d: v.documents(spark, d).where("cohort").select("doc_id").intersect(v.links(spark, d).where("confidence > 0.4").select("doc_id")),
    v.with_views("docs", "links") + "SELECT doc_id FROM docs WHERE cohort INTERSECT SELECT doc_id FROM links WHERE confidence > 0.4",
)
