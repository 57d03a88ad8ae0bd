"""What sets one group of sections apart: n-gram rates, log-odds, keyword tiers, profiles and canonical clusters.

Each is a grouped count over (document, section, gram) rows, on the whole of both
groups; no group is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..plans.ranks import value_ranks
from ..plans.stages import written
from ..registry import register

WORD = "[a-z]+(?:'[a-z]+)?"
#: A word of keywords has two characters or more; hyphens and underscores belong to it.
KEYWORD = "[a-z][a-z'_-]+"
# Weights of the fused scores, and words that are no keywords.
LAB_TFIDF, LAB_ODDS, ODDS_SCALE = 0.5, 0.5, 5.0
TFIDF_SHARE, ALPHA = 0.7, 0.01
STOP_WORDS = (
    "the", "and", "of", "to", "in", "a", "or", "for", "be", "is", "with", "that", "by", "as", "an", "at", "from", "on", "not", "shall", "any", "such",
    "this", "which", "will", "each", "may", "other", "its", "all", "no", "but", "if", "has", "been", "were", "have", "had", "are", "than", "their",
    "who", "would", "could", "should", "more", "after", "before", "upon", "pursuant", "provided", "hereto", "herein", "thereof", "thereunder",
    "hereunder", "thereto", "hereof", "therein",
)


def gram_lists(sections: DataFrame, least: int, most: int, *columns: str, word: str = WORD) -> DataFrame:
    """The columns and ``grams``: each section's word n-grams of three characters or more, repeats included."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))
    df = sections.select(*columns, words.alias("w"))
    slices = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = [F.when(F.size("w") >= n, slices(n)).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)]
    return df.select(*columns, F.filter(F.concat(*runs), lambda g: F.length(g) >= 3).alias("grams"))


def grams(sections: DataFrame, least: int = 1, most: int = 2) -> DataFrame:
    """(doc_id, section_number, gram, n): the word n-grams of each section of three characters or more, with their counts."""
    df = gram_lists(sections, least, most, "doc_id", "section_number").select("doc_id", "section_number", F.explode("grams").alias("gram"))
    return df.groupBy("doc_id", "section_number", "gram").agg(F.count(F.lit(1)).alias("n"))


def split_groups(sections: DataFrame, pattern: str) -> DataFrame:
    """``sections`` with ``target``: headings that match; other sections only of documents without any."""
    hit = F.coalesce(F.col("heading").rlike(f"(?i){pattern}"), F.lit(False))
    has = sections.where(hit).select("doc_id").distinct()
    return sections.where(hit).withColumn("target", F.lit(True)).unionByName(sections.join(has, "doc_id", "left_anti").withColumn("target", F.lit(False)))


def counted(split: DataFrame, least: int = 1, most: int = 2, word: str = WORD) -> tuple[DataFrame, DataFrame]:
    """((gram, target and background sections, uses and documents), one row of totals)."""
    # A section's grams stand in its row: each use counts one, each distinct gram one section, so that only documents' counts are shuffled.
    use = lambda names, s, u: F.transform(names, lambda g: F.struct(g.alias("gram"), F.lit(s).cast("long").alias("s"), F.lit(u).cast("long").alias("u")))
    g = gram_lists(split, least, most, "doc_id", "target", word=word).select("doc_id", "target", F.explode(F.concat(use(F.col("grams"), 0, 1), use(F.array_distinct("grams"), 1, 0))).alias("x"))
    per_doc = g.select("doc_id", "target", "x.*").groupBy("gram", "doc_id", "target").agg(F.sum("s").alias("s"), F.sum("u").alias("u"))
    t = F.col("target")
    by = per_doc.groupBy("gram").agg(F.coalesce(F.sum(F.when(t, F.col("s"))), F.lit(0)).alias("ts"), F.coalesce(F.sum(F.when(~t, F.col("s"))), F.lit(0)).alias("bs"), F.coalesce(F.sum(F.when(t, F.col("u"))), F.lit(0)).alias("tu"), F.coalesce(F.sum(F.when(~t, F.col("u"))), F.lit(0)).alias("bu"), F.count_if(t).alias("docs"))
    by = written(by)  # one row a gram, read for the totals and the places too
    uses = by.agg(F.sum("tu").alias("all_tu"), F.sum("bu").alias("all_bu"))
    totals = split.agg(F.count_if(t).alias("nt"), F.count_if(~t).alias("nb")).join(F.broadcast(uses), F.lit(True))  # one row
    return by, totals


def dna_lab(split: DataFrame, least_rate: float = 0.05, most_background: float = 0.3, top: int = 50) -> DataFrame:
    """Grams common in the target and rare in the background, by half TF-IDF and half smoothed log-odds; a top-k report."""
    by, totals = counted(split)
    df = by.where("ts > 0").join(F.broadcast(totals), F.lit(True))  # one row
    rate, back = F.col("ts") / F.col("nt"), F.coalesce(F.try_divide("bs", "nb"), F.lit(0.0))
    odds = F.log(((F.col("ts") + 1) / (F.col("nt") + 2)) / ((F.col("bs") + 1) / (F.col("nb") + 2)))
    tfidf = rate * F.log(1 + F.col("nb") / (F.col("bs") + 1))
    df = df.withColumns({"rate": rate, "back": back, "odds": odds, "tfidf": tfidf}).where((F.col("rate") >= least_rate) & (F.col("back") <= most_background))
    score = LAB_TFIDF * F.least(F.lit(1.0), "tfidf") + LAB_ODDS * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("odds") / ODDS_SCALE))
    df = df.select("gram", F.round(score, 4).alias("score"), F.round("tfidf", 4).alias("tfidf"), F.round("odds", 4).alias("log_odds"), F.round("rate", 4).alias("section_rate"), F.round("back", 4).alias("background_rate"), "docs")
    return df.orderBy(F.desc("score"), "gram").limit(top)


def dna_library(split: DataFrame, least_rate: float = 0.02, most_background: float = 0.5, top: int = 50) -> DataFrame:
    """Grams by 0.7 of their TF-IDF percentile and 0.3 of their log-odds percentile; equal values share the mean place."""
    by, totals = counted(split)
    df = by.where("tu > 0").join(F.broadcast(totals), F.lit(True))  # one row
    docs = F.col("nt") + F.greatest(F.col("nb"), F.lit(1))
    tfidf = F.col("tu") / F.col("all_tu") * F.log(docs / (1 + F.col("ts") + F.col("bs")))
    odds = F.log((F.col("tu") + ALPHA) / (F.col("all_tu") + ALPHA * docs)) - F.log((F.col("bu") + ALPHA) / (F.coalesce("all_bu", F.lit(0)) + ALPHA * docs))
    df = df.select("gram", F.round(tfidf, 9).alias("tfidf"), F.round(odds, 6).alias("odds"), (F.col("ts") / F.col("nt")).alias("rate"), F.coalesce(F.try_divide("bs", "nb"), F.lit(0.0)).alias("back"))
    place = lambda r: (F.col("below") + (F.col("n") - 1) / 2.0) / F.greatest(F.lit(1), F.col("total") - 1)
    for column in ("tfidf", "odds"):
        df = df.join(value_ranks(df, column).select(F.col("value").alias(column), place(column).alias(f"{column}_place")), column)
    df = df.where((F.col("rate") >= least_rate) & (F.col("back") <= most_background))
    score = F.round(TFIDF_SHARE * F.col("tfidf_place") + (1 - TFIDF_SHARE) * F.col("odds_place"), 6)
    return df.select("gram", score.alias("score"), F.round("odds", 4).alias("log_odds")).orderBy(F.desc("score"), "gram").limit(top)


def keyword_tiers(split: DataFrame, least_rate: float = 0.10, least_ratio: float = 3.0, specific_rate: float = 0.30) -> DataFrame:
    """(word, rate, ratio, tier): words and bigrams three times as common in the target, by ratio.

    The first ten are anchors, the next ten are for sections only, and the first five of
    those above ``specific_rate`` are specific to the concept, whatever else they are.
    Words count once a section, bigrams each time; sections without text don't count.
    """
    by, totals = counted(split.where("text <> ''"), word=KEYWORD)
    df = by.join(F.broadcast(totals), F.lit(True)).where(~F.col("gram").isin(*STOP_WORDS))  # one row
    count = lambda k: F.when(F.col("gram").contains(" "), F.col(f"{k}u")).otherwise(F.col(f"{k}s"))
    rate = count("t") / F.col("nt")
    ratio = rate / F.greatest(F.coalesce(F.try_divide(count("b"), F.col("nb")), F.lit(0.0)), F.lit(0.001))
    df = written(df.select("gram", rate.alias("rate"), ratio.alias("ratio")).where((F.col("rate") >= least_rate) & (F.col("ratio") >= least_ratio)))
    order = (F.desc("ratio"), "gram")
    first = df.orderBy(*order).limit(20).withColumn("tier", F.when(F.row_number().over(W.orderBy(*order)) <= 10, "anchor").otherwise("section"))  # a top-k report
    specific = df.where(F.col("rate") > specific_rate).orderBy(*order).limit(5).withColumn("tier", F.lit("specific"))
    return first.unionByName(specific).select("gram", F.round("rate", 6).alias("rate"), F.round("ratio", 4).alias("ratio"), "tier")


def family_profile(split: DataFrame) -> DataFrame:
    """(target, sections, words, vocabulary, diversity): of each group."""
    # A row without a gram stands for its section, so that the sections are read once and only counts are shuffled.
    g = gram_lists(split, 1, 1, "target").select("target", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("grams", F.array().cast("array<string>")))).alias("gram"))
    by = g.groupBy("target", "gram").agg(F.count(F.lit(1)).alias("n"))
    n, own = F.col("n"), F.col("gram").isNotNull()
    sums = by.groupBy("target").agg(F.sum(F.when(~own, n)).alias("sections"), F.sum(F.when(own, n)).alias("words"), F.count("gram").alias("vocabulary")).where("vocabulary > 0")
    return sums.withColumn("diversity", F.round(F.col("vocabulary") / F.col("words"), 6))


def template_profiles(sections: DataFrame) -> DataFrame:
    """(template_family, article_num, sections, mean length, top heading and its share) of sections by template and place."""
    key = ["template_family", "article_num"]
    heads = sections.groupBy(*key, F.lower(F.trim("heading")).alias("h")).agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("c"))
    out = heads.groupBy(*key).agg(F.sum("m").alias("sections"), F.sum("c").alias("c"), F.max(F.struct("m", "h")).alias("x"))
    return out.select(*key, "sections", F.round(F.col("c") / F.col("sections"), 4).alias("mean_chars"), F.col("x.h").alias("heading"), F.round(F.col("x.m") / F.col("sections"), 4).alias("share"))


def canonical_clusters(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cluster, canonical, size) by size and least member, one row of quality figures): members have (doc_id, cluster), null for noise."""
    sizes = members.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"))
    named = sizes.withColumn("canonical", F.row_number().over(W.orderBy(F.desc("size"), "least")) - 1).select("cluster", "canonical", "size")  # clusters are few
    n = members.agg(F.count(F.lit(1)).alias("docs"), F.count("cluster").alias("clustered"))
    figures = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.sum(F.col("size") * F.col("size")).alias("sq")).join(F.broadcast(n), F.lit(True))  # one row
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    quality = figures.select("docs", "clusters", ratio(F.col("clustered"), F.col("docs")).alias("coverage"), ratio(F.col("docs") - F.col("clustered"), F.col("docs")).alias("noise"), ratio(F.col("largest"), F.col("clustered")).alias("largest_share"), ratio(F.col("sq"), F.col("clustered") * F.col("clustered")).alias("hhi"))
    return named, quality


PATTERN = "^(the|of|in)"
_WORD = WORD.replace("'", "''")


def _split(spark, d) -> DataFrame:
    return split_groups(v.sections(spark, d), PATTERN)


_SPLIT = (
    v.with_views("sections")
    + f""", s AS (SELECT *, coalesce(regexp_matches(heading, '(?i){PATTERN}'), false) AS hit FROM sections), sp AS (SELECT *, hit AS target FROM s WHERE hit OR doc_id NOT IN (SELECT doc_id FROM s WHERE hit)),
w AS (SELECT doc_id, section_number, target, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w, unnest(range(1, len(regexp_extract_all(lower(text), '{_WORD}')) + 1)) AS i FROM sp),
g AS (SELECT * FROM (SELECT doc_id, section_number, target, w AS gram FROM w UNION ALL SELECT doc_id, section_number, target, w || ' ' || lead(w) OVER (PARTITION BY doc_id, section_number ORDER BY i) FROM w) WHERE length(gram) >= 3),
b AS (SELECT gram, coalesce(sum(x) FILTER (target), 0) AS tu, coalesce(sum(x) FILTER (NOT target), 0) AS bu, count(*) FILTER (target) AS ts, count(*) FILTER (NOT target) AS bs, count(DISTINCT doc_id) FILTER (target) AS docs FROM (SELECT doc_id, section_number, target, gram, count(*) AS x FROM g GROUP BY ALL) GROUP BY 1),
n AS (SELECT count(*) FILTER (target) AS nt, count(*) FILTER (NOT target) AS nb FROM sp), u AS (SELECT sum(tu) AS all_tu, sum(bu) AS all_bu FROM b)
"""
)
register(
    "dna_lab",
    lambda spark, d: dna_lab(_split(spark, d)),
    _SPLIT
    + """, x AS (SELECT gram, docs, ts / nt::DOUBLE AS rate, coalesce(bs / nullif(nb, 0)::DOUBLE, 0) AS back, ln(((ts + 1) / (nt + 2)::DOUBLE) / ((bs + 1) / (nb + 2)::DOUBLE)) AS odds, ts / nt::DOUBLE * ln(1 + nb / (bs + 1)::DOUBLE) AS tfidf FROM b, n WHERE ts > 0)
SELECT gram, round(0.5::DOUBLE * least(1.0, tfidf) + 0.5::DOUBLE * greatest(0.0, least(1.0, odds / 5.0::DOUBLE)), 4) AS score, round(tfidf, 4) AS tfidf, round(odds, 4) AS log_odds, round(rate, 4) AS section_rate, round(back, 4) AS background_rate, docs FROM x WHERE rate >= 0.05 AND back <= 0.3 ORDER BY score DESC, gram LIMIT 50""",
)
_PLACE = lambda c: f"(rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / greatest(1, count(*) OVER () - 1)"
register(
    "dna_library",
    lambda spark, d: dna_library(_split(spark, d)),
    _SPLIT
    + f""", x AS (SELECT gram, round((tu / all_tu::DOUBLE) * ln((nt + greatest(nb, 1)) / (1 + ts + bs)::DOUBLE), 9) AS tfidf, round(ln((tu + 0.01::DOUBLE) / (all_tu + 0.01::DOUBLE * (nt + greatest(nb, 1)))) - ln((bu + 0.01::DOUBLE) / (coalesce(all_bu, 0) + 0.01::DOUBLE * (nt + greatest(nb, 1)))), 6) AS odds, ts / nt::DOUBLE AS rate, coalesce(bs / nullif(nb, 0)::DOUBLE, 0) AS back FROM b, n, u WHERE tu > 0),
r AS (SELECT *, {_PLACE("tfidf")} AS a, {_PLACE("odds")} AS c FROM x) SELECT gram, round(0.7::DOUBLE * a + (1 - 0.7::DOUBLE) * c, 6) AS score, round(odds, 4) AS log_odds FROM r WHERE rate >= 0.02 AND back <= 0.5 ORDER BY score DESC, gram LIMIT 50""",
)
register(
    "anti_dna",
    lambda spark, d: dna_lab(_split(spark, d).withColumn("target", ~F.col("target")), 0.02, 0.2).select("gram", "score"),
    _SPLIT
    + """, x AS (SELECT gram, bs / nb::DOUBLE AS rate, coalesce(ts / nullif(nt, 0)::DOUBLE, 0) AS back, ln(((bs + 1) / (nb + 2)::DOUBLE) / ((ts + 1) / (nt + 2)::DOUBLE)) AS odds, bs / nb::DOUBLE * ln(1 + nt / (ts + 1)::DOUBLE) AS tfidf FROM b, n WHERE bs > 0)
SELECT gram, round(0.5::DOUBLE * least(1.0, tfidf) + 0.5::DOUBLE * greatest(0.0, least(1.0, odds / 5.0::DOUBLE)), 4) AS score FROM x WHERE rate >= 0.02 AND back <= 0.2 ORDER BY score DESC, gram LIMIT 50""",
)
register(
    "keyword_tiers",
    # A fifth of the usual rates, since these sections are single lines.
    lambda spark, d: keyword_tiers(_split(spark, d), 0.02, 1.2, 0.06),
    _SPLIT.replace(_WORD, KEYWORD.replace("'", "''")).replace("WHERE hit OR", "WHERE text <> '' AND (hit OR").replace("FROM s WHERE hit)),", "FROM s WHERE hit))),")
    + f""", x AS (SELECT gram, CASE WHEN contains(gram, ' ') THEN tu ELSE ts END / nt::DOUBLE AS rate, (CASE WHEN contains(gram, ' ') THEN tu ELSE ts END / nt::DOUBLE) / greatest(coalesce(CASE WHEN contains(gram, ' ') THEN bu ELSE bs END / nullif(nb, 0)::DOUBLE, 0), 0.001::DOUBLE) AS ratio FROM b, n WHERE gram NOT IN {tuple(STOP_WORDS)}),
y AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, gram) AS k, row_number() OVER (PARTITION BY rate > 0.06 ORDER BY ratio DESC, gram) AS k_specific FROM x WHERE rate >= 0.02 AND ratio >= 1.2)
SELECT gram, round(rate, 6) AS rate, round(ratio, 4) AS ratio, CASE WHEN k <= 10 THEN 'anchor' ELSE 'section' END AS tier FROM y WHERE k <= 20 UNION ALL SELECT gram, round(rate, 6), round(ratio, 4), 'specific' FROM y WHERE rate > 0.06 AND k_specific <= 5""",
)
register(
    "family_profile",
    lambda spark, d: family_profile(_split(spark, d)),
    _SPLIT + "SELECT sp.target, count(*) AS sections, any_value(words) AS words, any_value(vocabulary) AS vocabulary, round(any_value(vocabulary) / any_value(words)::DOUBLE, 6) AS diversity FROM sp JOIN (SELECT target, CAST(count(*) AS BIGINT) AS words, count(DISTINCT gram) AS vocabulary FROM g WHERE NOT contains(gram, ' ') GROUP BY 1) y ON y.target = sp.target GROUP BY 1",
)
register(
    "template_profiles",
    lambda spark, d: template_profiles(v.sections(spark, d)),
    v.with_views("sections") + ", h AS (SELECT template_family, article_num, lower(trim(heading)) AS h, count(*) AS m, sum(chars) AS c FROM sections GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY template_family, article_num ORDER BY m DESC, encode(h) DESC) AS k FROM h) SELECT template_family, article_num, CAST(sum(m) AS BIGINT) AS sections, round(sum(c) / sum(m)::DOUBLE, 4) AS mean_chars, max(h) FILTER (k = 1) AS heading, round(max(m) FILTER (k = 1) / sum(m)::DOUBLE, 4) AS share FROM r GROUP BY 1, 2",
)
_MEMBERS = "SELECT vec_id AS doc_id, CASE WHEN label > 1 THEN label END AS cluster FROM embeddings"


def _members(spark, d) -> DataFrame:
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") > 1, F.col("label")).alias("cluster"))


register(
    "canonical_clusters",
    lambda spark, d: canonical_clusters(_members(spark, d))[0],
    f"SELECT cluster, row_number() OVER (ORDER BY size DESC, least) - 1 AS canonical, size FROM (SELECT cluster, count(*) AS size, min(doc_id) AS least FROM ({_MEMBERS}) WHERE cluster IS NOT NULL GROUP BY 1)",
)
register(
    "cluster_quality",
    lambda spark, d: canonical_clusters(_members(spark, d))[1],
    f"WITH m AS ({_MEMBERS}), s AS (SELECT cluster, count(*) AS size FROM m WHERE cluster IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM m) AS docs, count(*) AS clusters, round(sum(size) / (SELECT count(*) FROM m)::DOUBLE, 6) AS coverage, round(1 - sum(size) / (SELECT count(*) FROM m)::DOUBLE, 6) AS noise, round(max(size) / sum(size)::DOUBLE, 6) AS largest_share, round(sum(size * size) / (sum(size) * sum(size))::DOUBLE, 6) AS hhi FROM s",
)
