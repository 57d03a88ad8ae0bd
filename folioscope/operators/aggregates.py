"""Distributions, statistics and grouped summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..plans.ranks import value_ranks
from ..registry import register


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def kpis(spark, d):
    return v.documents(spark, d).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("cohort").alias("n_cohort"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.round(F.median("word_count"), 6).alias("median_words"),
        rate(F.count_if(F.col("quality").isNotNull()), F.count(F.lit(1))).alias("labelled_rate"),
        F.sum("text_length").alias("total_chars"),
    )


register(
    "kpis",
    kpis,
    v.with_views("docs")
    + "SELECT count(*) AS n_docs, count(*) FILTER (cohort) AS n_cohort, round(avg(word_count), 6) AS avg_words, round(median(word_count), 6) AS median_words, round(count(quality) / count(*)::DOUBLE, 6) AS labelled_rate, CAST(sum(text_length) AS BIGINT) AS total_chars FROM docs",
)
register(
    "categorical_distribution",
    lambda spark, d: v.documents(spark, d).groupBy(F.coalesce(F.nullif(F.col("market_segment"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")),
    v.with_views("docs") + "SELECT coalesce(nullif(market_segment, ''), 'unknown') AS value, count(*) AS n FROM docs GROUP BY 1",
)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal width, empty bins included; one bin where all values are equal."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    width = (F.col("b") - F.col("a")) / F.lit(float(bins))
    grid = ends.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).when(F.col("a").isNotNull(), F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
    grid = grid.select(F.col("bin").cast("long").alias("bin"), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + width * F.col("bin")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b")).otherwise(F.col("a") + width * (F.col("bin") + 1)).alias("hi"))
    values = df.where(F.col(column).isNotNull()).join(F.broadcast(ends), F.lit(True))  # one row
    at = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.least(F.floor((F.col(column) - F.col("a")) / width), F.lit(bins - 1)))
    counts = values.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "bin", "left").select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


register(
    "histogram",
    lambda spark, d: histogram(v.documents(spark, d), "word_count", 25),
    v.with_views("docs")
    + """, e AS (SELECT min(word_count)::DOUBLE AS a, max(word_count)::DOUBLE AS b FROM docs), g AS (SELECT unnest(range(0, 25)) AS bin),
c AS (SELECT CAST(least(floor((word_count - a) / ((b - a) / 25)), 24) AS BIGINT) AS bin, count(*) AS n FROM docs, e GROUP BY 1)
SELECT g.bin, round(a + (b - a) / 25 * g.bin, 6) AS lo, round(a + (b - a) / 25 * (g.bin + 1), 6) AS hi, coalesce(n, 0) AS n FROM g CROSS JOIN e LEFT JOIN c USING (bin)""",
)


def statistics(column: str) -> list[Column]:
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 6)
    return [F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), p(0.5).alias("median"), F.round(F.coalesce(F.stddev_samp(column), F.lit(0.0)), 4).alias("stdev"), F.min(column).alias("least"), F.max(column).alias("most"), p(0.05).alias("p5"), p(0.95).alias("p95")]


_STATS = "count({0}) AS n, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS median, round(coalesce(stddev_samp({0}), 0), 4) AS stdev, min({0}) AS least, max({0}) AS most, round(quantile_cont({0}, 0.05), 6) AS p5, round(quantile_cont({0}, 0.95), 6) AS p95"
register("numeric_distribution", lambda spark, d: v.documents(spark, d).agg(*statistics("text_length")), v.with_views("docs") + f"SELECT {_STATS.format('text_length')} FROM docs")
register(
    "metric_stats",
    lambda spark, d: v.documents(spark, d).groupBy("template_family").agg(*statistics("word_count")).orderBy(F.desc("n"), "template_family").limit(50),
    v.with_views("docs") + f"SELECT template_family, {_STATS.format('word_count')} FROM docs GROUP BY template_family ORDER BY n DESC, template_family LIMIT 50",
)


def iqr_outliers(df: DataFrame, group: str, column: str, least: int = 4) -> DataFrame:
    fences = df.groupBy(group).agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"), F.count(column).alias("n"))
    fences = fences.where((F.col("n") >= least) & (F.col("q3") > F.col("q1"))).select(group, (2.5 * F.col("q1") - 1.5 * F.col("q3")).alias("low_fence"), (2.5 * F.col("q3") - 1.5 * F.col("q1")).alias("high_fence"))
    return df.join(fences, group).where((F.col(column) < F.col("low_fence")) | (F.col(column) > F.col("high_fence")))


register(
    "iqr_outliers",
    lambda spark, d: iqr_outliers(v.documents(spark, d), "template_family", "word_count").select("doc_id", "template_family", "word_count", F.round("low_fence", 4).alias("low_fence"), F.round("high_fence", 4).alias("high_fence")),
    v.with_views("docs")
    + """, f AS (SELECT template_family, quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.75) AS q3 FROM docs GROUP BY 1 HAVING count(word_count) >= 4 AND quantile_cont(word_count, 0.75) > quantile_cont(word_count, 0.25))
SELECT doc_id, template_family, word_count, round(2.5 * q1 - 1.5 * q3, 4) AS low_fence, round(2.5 * q3 - 1.5 * q1, 4) AS high_fence FROM docs JOIN f USING (template_family) WHERE word_count < 2.5 * q1 - 1.5 * q3 OR word_count > 2.5 * q3 - 1.5 * q1""",
)
register(
    "distinct_counts",
    lambda spark, d: v.definitions(spark, d).agg(F.countDistinct("term").alias("terms"), F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n")),
    v.with_views("definitions") + "SELECT count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs, count(*) AS n FROM definitions",
)
register(
    "tuple_distinct",
    lambda spark, d: v.clauses(spark, d).groupBy("label").agg(F.countDistinct(F.struct("section_number", "parent_id")).alias("pairs")),
    v.with_views("clauses") + "SELECT label, count(DISTINCT (section_number, parent_id)) AS pairs FROM clauses GROUP BY label",
)


def first_ids(df: DataFrame, key: str, count: int = 5) -> DataFrame:
    """(key, examples): each key's first document ids; a rank cuts them before they are collected."""
    once = df.select(key, "doc_id").distinct().withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("doc_id"))).where(F.col("_k") <= count)
    return once.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("examples"))


def ordered_lists(df: DataFrame) -> DataFrame:
    engines = df.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("pattern_engine")), ",").alias("engines"))  # a few engines
    return engines.join(first_ids(df, "term"), "term")


register(
    "ordered_lists_all",
    lambda spark, d: ordered_lists(v.definitions(spark, d)),
    v.with_views("definitions") + "SELECT term, array_to_string(list_sort(list(DISTINCT pattern_engine)), ',') AS engines, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 5), ',') AS examples FROM definitions GROUP BY term",
)
register(
    "ordered_lists",
    lambda spark, d: ordered_lists(v.definitions(spark, d)),
    v.with_views("definitions") + "SELECT term, array_to_string(list_sort(list(DISTINCT pattern_engine)), ',') AS engines, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 5), ',') AS examples FROM definitions GROUP BY term",
)


def mode_of(df: DataFrame, group: str, value: str) -> DataFrame:
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias("mode"), (-F.col("m.k")).alias("n"), "total")


register(
    "mode_heading",
    lambda spark, d: mode_of(v.sections(spark, d).withColumn("word", F.regexp_extract("heading", "^([A-Za-z]+)", 1)), "section_number", "word"),
    v.with_views("sections")
    + """, c AS (SELECT section_number, regexp_extract(heading, '^([A-Za-z]+)', 1) AS word, count(*) AS n FROM sections GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_number ORDER BY n DESC, word) AS k, CAST(sum(n) OVER (PARTITION BY section_number) AS BIGINT) AS total FROM c)
SELECT section_number, word AS mode, n, total FROM r WHERE k = 1""",
)
register(
    "mode_heading_all",
    lambda spark, d: mode_of(v.sections(spark, d).withColumn("word", F.regexp_extract("heading", "^([A-Za-z]+)", 1)), "section_number", "word"),
    v.with_views("sections")
    + """, c AS (SELECT section_number, regexp_extract(heading, '^([A-Za-z]+)', 1) AS word, count(*) AS n FROM sections GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section_number ORDER BY n DESC, word) AS k, CAST(sum(n) OVER (PARTITION BY section_number) AS BIGINT) AS total FROM c)
SELECT section_number, word AS mode, n, total FROM r WHERE k = 1""",
)
register(
    "definition_frequency",
    lambda spark, d: v.definitions(spark, d).groupBy("term").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.countDistinct("pattern_engine").alias("engines")).where("docs >= 3"),
    v.with_views("definitions") + "SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n, round(avg(confidence), 6) AS confidence, count(DISTINCT pattern_engine) AS engines FROM definitions GROUP BY term HAVING count(DISTINCT doc_id) >= 3",
)
register(
    "quality_by_type",
    lambda spark, d: v.documents(spark, d).groupBy("market_segment").agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("word_count") >= 50), F.count(F.lit(1))).alias("long_rate"), rate(F.count_if(F.col("quality") == 1), F.count("quality")).alias("quality_rate"), rate(F.count_if(F.col("toxic") == 1), F.count("toxic")).alias("toxic_rate")),
    v.with_views("docs")
    + "SELECT market_segment, count(*) AS n, round(count(*) FILTER (word_count >= 50) / count(*)::DOUBLE, 6) AS long_rate, round(coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE, 0), 6) AS quality_rate, round(coalesce(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0)::DOUBLE, 0), 6) AS toxic_rate FROM docs GROUP BY 1",
)


def cohort_funnel(spark, d):
    """All steps in one scan: a rollup would repeat the counts, so each step is a conditional count."""
    x = v.documents(spark, d).agg(F.count(F.lit(1)).alias("all"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNotNull() & (F.col("market_segment") == "en")).alias("english"), F.count_if(F.col("cohort") & (F.col("market_segment") == "en")).alias("cohort"))
    return x.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("name"), F.col(n).alias("n")) for i, n in enumerate(("all", "labelled", "english", "cohort"))))).alias("s")).select("s.*")


register(
    "cohort_funnel",
    cohort_funnel,
    v.with_views("docs")
    + "SELECT 0::BIGINT AS step, 'all' AS name, count(*) AS n FROM docs UNION ALL SELECT 1, 'labelled', count(quality) FROM docs UNION ALL SELECT 2, 'english', count(*) FROM docs WHERE quality IS NOT NULL AND market_segment = 'en' UNION ALL SELECT 3, 'cohort', count(*) FROM docs WHERE cohort AND market_segment = 'en'",
)
register(
    "family_summary",
    lambda spark, d: v.links(spark, d).groupBy("family_id").agg(F.count_if(F.expr("status = 'active'")).alias("active"), F.count_if(F.expr("status = 'pending_review'")).alias("pending"), F.count_if(F.expr("status = 'unlinked'")).alias("unlinked"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg("confidence"), 6).alias("confidence")),
    v.with_views("links")
    + "SELECT family_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'pending_review') AS pending, count(*) FILTER (status = 'unlinked') AS unlinked, count(DISTINCT doc_id) AS docs, round(avg(confidence), 6) AS confidence FROM links GROUP BY family_id",
)


def links_analytics(spark, d):
    """Links by family, status and tier, with their documents, and how many lie in sections that several families claim."""
    tier = F.when(F.col("confidence") >= 0.5, "high").when(F.col("confidence") >= 0.2, "medium").otherwise("low")
    links = v.links(spark, d)
    several = links.groupBy("doc_id", "section_number").agg((F.min("family_id") != F.max("family_id")).alias("conflict"))
    df = links.join(several, ["doc_id", "section_number"]).select("family_id", "status", tier.alias("tier"), "doc_id", "conflict")
    # Once by document, so that distinct documents are a count in each grouping.
    df = df.groupBy("family_id", "status", "tier", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("conflict").alias("c"))
    return df.groupingSets([["family_id"], ["status"], ["tier"], []], "family_id", "status", "tier").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("c").alias("conflicts"))


register(
    "links_analytics",
    links_analytics,
    v.with_views("links")
    + "SELECT family_id, status, tier, count(*) AS n, count(DISTINCT doc_id) AS docs, count(*) FILTER (conflict) AS conflicts FROM (SELECT family_id, status, doc_id, CASE WHEN confidence >= 0.5 THEN 'high' WHEN confidence >= 0.2 THEN 'medium' ELSE 'low' END AS tier, (min(family_id) OVER w) <> (max(family_id) OVER w) AS conflict FROM links WINDOW w AS (PARTITION BY doc_id, section_number)) GROUP BY GROUPING SETS ((family_id), (status), (tier), ())",
)
register(
    "reason_analytics",
    lambda spark, d: v.table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(W.partitionBy()), 6).alias("share")),
    "SELECT event_type AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM events GROUP BY event_type",
)
register(
    "conflicting_sections",
    lambda spark, d: v.links(spark, d).groupBy("doc_id", "section_number").agg(F.countDistinct("family_id").alias("families"), F.array_join(F.array_sort(F.collect_set("family_id")), "|").alias("ids")).where("families > 1"),
    v.with_views("links") + "SELECT doc_id, section_number, count(DISTINCT family_id) AS families, array_to_string(list_sort(list(DISTINCT family_id)), '|') AS ids FROM links GROUP BY 1, 2 HAVING count(DISTINCT family_id) > 1",
)


def coverage_gaps(spark, d):
    """Families that a document lacks, for documents with any link: families are few, so the pairs are docs times that."""
    l = v.links(spark, d)
    families = l.agg(F.array_sort(F.collect_set("family_id")).alias("all"))
    have = l.groupBy("doc_id").agg(F.collect_set("family_id").alias("own"))
    return have.join(F.broadcast(families), F.lit(True)).select("doc_id", F.explode(F.array_except("all", "own")).alias("family_id"))


register(
    "coverage_gaps",
    coverage_gaps,
    v.with_views("links") + "SELECT a.doc_id, b.family_id FROM (SELECT DISTINCT doc_id FROM links) a CROSS JOIN (SELECT DISTINCT family_id FROM links) b WHERE (a.doc_id, b.family_id) NOT IN (SELECT (doc_id, family_id) FROM links)",
)


def rule_compare(spark, d):
    side = lambda name, cond: v.links(spark, d).where(cond).select("doc_id", "section_number").distinct().withColumn(name, F.lit(1))
    both = side("a", "family_id = '1-URGENT'").join(side("b", "family_id = '2-HIGH'"), ["doc_id", "section_number"], "full")
    x = both.agg(F.count("a").alias("only_or_both_a"), F.count("b").alias("only_or_both_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
    return x.withColumn("jaccard", rate(F.col("shared"), F.col("either")))


register(
    "rule_compare",
    rule_compare,
    v.with_views("links")
    + """, a AS (SELECT DISTINCT doc_id, section_number FROM links WHERE family_id = '1-URGENT'), b AS (SELECT DISTINCT doc_id, section_number FROM links WHERE family_id = '2-HIGH'),
c AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS s)
SELECT na AS only_or_both_a, nb AS only_or_both_b, s AS shared, na + nb - s AS either, round(coalesce(s / nullif(na + nb - s, 0)::DOUBLE, 0), 6) AS jaccard FROM c""",
)
register(
    "document_features",
    lambda spark, d: v.clauses(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.median("depth").alias("median_depth"), F.max("depth").alias("max_depth"), rate(F.count_if("is_structural"), F.count(F.lit(1))).alias("structural_rate"), F.round(F.avg("parse_confidence"), 6).alias("confidence"), F.countDistinct("section_number").alias("n_sections")),
    v.with_views("clauses")
    + "SELECT doc_id, count(*) AS n_clauses, median(depth) AS median_depth, max(depth) AS max_depth, round(count(*) FILTER (is_structural) / count(*)::DOUBLE, 6) AS structural_rate, round(avg(parse_confidence), 6) AS confidence, count(DISTINCT section_number) AS n_sections FROM clauses GROUP BY doc_id",
)


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of each group, from ranks of distinct values: no task holds a group's values."""
    ranks = value_ranks(df, value, group)
    at = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("n"))
    place = {k: (F.col("total") - 1) * F.lit(p) for k, p in shares.items()}
    ends = [F.max(F.when(at(f(x)), F.col("value"))).alias(f"_{k}_{n}") for k, x in place.items() for n, f in (("lo", F.floor), ("hi", F.ceil))]
    x = ranks.groupBy(group).agg(F.max("total").alias("total"), *ends)
    return x.select(group, *((F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * (place[k] - F.floor(place[k]))).alias(k) for k in shares))


def metric_profile(spark, d):
    df = v.documents(spark, d).select(F.explode(F.create_map(F.lit("chars"), F.col("text_length").cast("double"), F.lit("words"), F.col("word_count").cast("double"), F.lit("density"), F.try_divide(F.col("text_length"), F.col("word_count")))).alias("metric", "value"))
    ends = df.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    inner = percentiles(df, "metric", "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return ends.join(inner, "metric").select("metric", "n", "least", *(F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")), "most")


register(
    "metric_profile",
    metric_profile,
    v.with_views("docs")
    + """, m AS (SELECT 'chars' AS metric, text_length::DOUBLE AS value FROM docs UNION ALL SELECT 'words', word_count::DOUBLE FROM docs UNION ALL SELECT 'density', text_length / word_count::DOUBLE FROM docs)
SELECT metric, count(value) AS n, round(min(value), 6) AS least, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS most FROM m GROUP BY metric""",
)


def concentration(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Normalised Herfindahl index of each group's shares, and what it suggests."""
    x = counts.groupBy(group).agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n).cast("double") * F.col(n)).alias("sq"))
    hhi = F.col("sq") / (F.col("total").cast("double") * F.col("total"))
    x = x.withColumn("hhi", F.round(F.when(F.col("k") > 1, (hhi - 1 / F.col("k")) / (1 - 1 / F.col("k"))).otherwise(1.0), 6))
    return x.select(group, "total", "k", "hhi", F.when(F.col("hhi") >= 0.5, "concentrated").when(F.col("hhi") >= 0.15, "mixed").otherwise("spread").alias("shape"))


register(
    "concentration",
    lambda spark, d: concentration(v.links(spark, d).groupBy("family_id", "section_number").agg(F.count(F.lit(1)).alias("n")), "family_id", "n"),
    v.with_views("links")
    + """, c AS (SELECT family_id, section_number, count(*) AS n FROM links GROUP BY 1, 2), t AS (SELECT family_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS k, sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)) AS h FROM c GROUP BY 1),
r AS (SELECT family_id, total, k, round(CASE WHEN k > 1 THEN (h - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k) ELSE 1 END, 6) AS hhi FROM t)
SELECT *, CASE WHEN hhi >= 0.5 THEN 'concentrated' WHEN hhi >= 0.15 THEN 'mixed' ELSE 'spread' END AS shape FROM r""",
)


def heading_discovery(spark, d):
    """Headings' first words counted once for each document, with article numbers and examples."""
    s = v.sections(spark, d).withColumn("word", F.lower(F.regexp_extract("heading", "^([A-Za-z]{3,})", 1))).where("word <> ''")
    once = s.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("article_num").alias("a"))
    counts = once.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.countDistinct("a").alias("articles")).where("docs >= 2")
    return counts.join(first_ids(once, "word"), "word")


register(
    "heading_discovery",
    heading_discovery,
    v.with_views("sections")
    + """, s AS (SELECT doc_id, article_num, lower(regexp_extract(heading, '^([A-Za-z]{3,})', 1)) AS word FROM sections), o AS (SELECT word, doc_id, count(*) AS n, min(article_num) AS a FROM s WHERE word <> '' GROUP BY 1, 2)
SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs, count(DISTINCT a) AS articles, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS examples FROM o GROUP BY word HAVING count(*) >= 2""",
)
register(
    "section_prevalence",
    lambda spark, d: v.sections(spark, d).groupBy("section_number", F.col("article_num")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("template_family").alias("templates")),
    v.with_views("sections") + "SELECT section_number, article_num, count(*) AS n, count(DISTINCT template_family) AS templates FROM sections GROUP BY 1, 2",
)
register(
    "section_prevalence_all",
    lambda spark, d: v.sections(spark, d).where("heading <> ''").groupBy(F.lower(F.regexp_replace("heading", "^\\s+|\\s+$", "")).alias("title"), "section_number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("template_family").alias("templates")),
    v.with_views("sections") + "SELECT lower(regexp_replace(heading, '^\\s+|\\s+$', '', 'g')) AS title, section_number, count(*) AS n, count(DISTINCT template_family) AS templates FROM sections WHERE heading <> '' GROUP BY 1, 2",
)
register(
    "batch_spans",
    lambda spark, d: v.table(spark, d, "events").groupBy(F.col("user_id").alias("batch")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")),
    "SELECT user_id AS batch, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM events GROUP BY user_id",
)


def numbering_census(spark, d):
    c = v.clauses(spark, d)
    order = W.partitionBy("doc_id").orderBy("clause_number")
    c = c.withColumn("gap", F.col("clause_number") - F.lag("clause_number").over(order) > 1)
    return c.groupBy("doc_id").agg(F.min("clause_number").alias("first"), F.max("clause_number").alias("last"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("has_gap"), F.max("depth").alias("depth"))


register(
    "numbering_census",
    numbering_census,
    v.with_views("clauses") + "SELECT doc_id, min(clause_number) AS first, max(clause_number) AS last, count(*) AS n, coalesce(bool_or(gap), false) AS has_gap, max(depth) AS depth FROM (SELECT *, clause_number - lag(clause_number) OVER (PARTITION BY doc_id ORDER BY clause_number) > 1 AS gap FROM clauses) GROUP BY doc_id",
)

HEADING_CATEGORIES = (("[|]", "table"), ("[#$%&]{3}", "symbols"), ("^[^a-z]*[A-Z][^a-z]*$", "capitals"), ("^[A-Z]", "sentence"))


def heading_category(heading: str) -> Column:
    """The first pattern that matches names the category."""
    out = reduce(lambda w, x: w.when(F.col(heading).rlike(x[0]), x[1]), HEADING_CATEGORIES[1:], F.when(F.col(heading).rlike(HEADING_CATEGORIES[0][0]), HEADING_CATEGORIES[0][1]))
    return out.otherwise("other")


register(
    "heading_categories",
    lambda spark, d: v.sections(spark, d).groupBy(heading_category("heading").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")),
    v.with_views("sections")
    + "SELECT CASE WHEN regexp_matches(heading, '[|]') THEN 'table' WHEN regexp_matches(heading, '[#$%&]{3}') THEN 'symbols' WHEN regexp_matches(heading, '^[^a-z]*[A-Z][^a-z]*$') THEN 'capitals' WHEN regexp_matches(heading, '^[A-Z]') THEN 'sentence' ELSE 'other' END AS category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM sections GROUP BY 1",
)


def groups_of_groups(spark, d):
    c = v.clauses(spark, d).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("label").agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.expr("n >= 5")).alias("bursts"))


register("groups_of_groups", groups_of_groups, v.with_views("clauses") + "SELECT label, max(n) AS most, round(avg(n), 6) AS mean, count(*) FILTER (n >= 5) AS bursts FROM (SELECT doc_id, label, count(*) AS n FROM clauses GROUP BY 1, 2) GROUP BY label")
register(
    "ratio_aggregates",
    lambda spark, d: v.clauses(spark, d).groupBy("section_number").agg(rate(F.count_if("is_structural"), F.count(F.lit(1))).alias("structural"), rate(F.count(F.lit(1)) - F.countDistinct("clause_id"), F.count(F.lit(1))).alias("repeated"), F.round(F.avg("parse_confidence"), 6).alias("confidence")),
    v.with_views("clauses") + "SELECT section_number, round(count(*) FILTER (is_structural) / count(*)::DOUBLE, 6) AS structural, round((count(*) - count(DISTINCT clause_id)) / count(*)::DOUBLE, 6) AS repeated, round(avg(parse_confidence), 6) AS confidence FROM clauses GROUP BY section_number",
)
