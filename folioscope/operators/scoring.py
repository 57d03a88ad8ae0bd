"""Section scores, hits and misses, outlier risk, link and runtime confidence, calibration, conflicts and drift.

A strategy is plain data; its few phrases become Columns. Each evaluation is one plan
over all sections: score, best section of each document, gates, then counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..plans.ranks import value_ranks
from ..registry import register

# Score ranges and weights.
HEADING, KEYWORD_LOW, KEYWORD_HIGH, DNA_LOW, DNA_HIGH, HIT = 0.80, 0.40, 0.70, 0.25, 0.55, 0.3
LINK_WEIGHTS = {"article": 0.22, "heading": 0.28, "clause": 0.13, "template": 0.10, "terms": 0.09, "structure": 0.08, "semantic": 0.10}
RUNTIME_WEIGHTS = {"score": 0.5, "margin": 0.2, "channels": 0.3}
RISK_WEIGHTS = {"score": 0.20, "margin": 0.18, "heading": 0.16, "article": 0.10, "template": 0.10, "length": 0.10, "single": 0.16}
EDGE_POLICY = {
    "EXCLUDES_FROM": "exclusive", "PREVENTS": "exclusive", "BLOCKED_BY": "exclusive",
    "CONSTRAINS": "warn", "RECLASSIFIES_TO": "warn", "TRIGGERS": "warn", "MODIFIES": "warn", "CONDITIONAL_ON": "warn",
    "SHARED_CAP": "shared_ok", "STACKS_WITH": "shared_ok", "COMPLEMENTS": "shared_ok", "CROSS_REFERENCES": "shared_ok", "EXTENDS": "shared_ok",
    "MIRRORS": "expected_overlap", "FEEDS_INTO": "independent", "DEPENDS_ON": "independent", "ENABLES": "independent", "IMPLEMENTS": "independent",
}
POLICY_RANK = {"exclusive": 5, "warn": 4, "compound_covenant": 3, "shared_ok": 2, "expected_overlap": 1, "independent": 0}


@dataclass(frozen=True)
class Strategy:
    headings: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    #: Gates, each skipped where it is not configured.
    least_keywords: int = 0
    least_channels: int = 0
    least_margin: float = 0.0
    articles: tuple[int, ...] = ()
    most_words: int | None = None
    labels: tuple[str, ...] = field(default=())


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def heading_hit(heading: Column, patterns: tuple[str, ...]) -> Column:
    """A pattern in the heading, or in it with all spaces taken out of both."""
    low = F.lower(heading)
    bare = F.replace(low, F.lit(" "), F.lit(""))
    return _any(low.contains(p.lower()) | bare.contains(p.lower().replace(" ", "")) for p in patterns)


def found(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the lower-cased text has, each counted once."""
    return _sum(text.contains(p.lower()).cast("int") for p in phrases)


def scored(sections: DataFrame, s: Strategy) -> DataFrame:
    """``sections`` (heading, text) with score, method, channels, keyword hits and negative hits."""
    df = sections.withColumn("_low", F.lower("text"))
    df = df.withColumns({"heading_hit": heading_hit(F.col("heading"), s.headings), "keyword_hits": found(F.col("_low"), s.keywords), "_t": 2 * found(F.col("_low"), s.strong) + found(F.col("_low"), s.weak), "negative_hits": found(F.col("_low"), s.negative)}).drop("_low")
    kw = F.col("keyword_hits") / F.lit(float(max(len(s.keywords), 1)))
    dna = F.least(F.lit(1.0), F.col("_t") / 6.0)
    df = df.withColumns({"_kw": KEYWORD_LOW + round(KEYWORD_HIGH - KEYWORD_LOW, 6) * kw, "_dna": DNA_LOW + round(DNA_HIGH - DNA_LOW, 6) * dna, "keyword_hit": F.col("keyword_hits") > 0, "dna_hit": F.col("_t") > 0})
    single = F.greatest(F.when(F.col("heading_hit"), F.lit(HEADING)).otherwise(0.0), F.when(F.col("keyword_hit"), F.col("_kw")).otherwise(0.0), F.when(F.col("dna_hit"), F.col("_dna")).otherwise(0.0))
    both = F.col("heading_hit") & (F.col("keyword_hit") | F.col("dna_hit"))
    df = df.withColumns({"score": F.when(both, HEADING + 0.3 * F.col("_kw") + 0.2 * F.col("_dna")).otherwise(single), "channels": F.col("heading_hit").cast("int") + F.col("keyword_hit").cast("int") + F.col("dna_hit").cast("int")})
    # A later channel counts only where it is strictly better.
    method = F.when(both, "composite").when(F.col("heading_hit"), "heading").when(F.col("keyword_hit") & (~F.col("dna_hit") | (F.col("_kw") >= F.col("_dna"))), "keyword").when(F.col("dna_hit"), "dna").otherwise("none")
    return df.withColumn("method", method).drop("_t", "_kw", "_dna")


def best_sections(df: DataFrame) -> DataFrame:
    """Each document's best section, with the margin over its runner-up."""
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "section_number")
    df = df.withColumns({"_k": F.row_number().over(order), "_next": F.lead("score").over(order)}).where("_k <= 1")
    return df.withColumn("margin", F.col("score") - F.coalesce("_next", F.lit(0.0))).drop("_k", "_next")


def accepted(s: Strategy) -> Column:
    """The conjunction of the configured gates."""
    gates = [F.col("score") > HIT]
    if s.least_keywords:
        gates.append((F.col("method") != "keyword") | (F.col("keyword_hits") >= s.least_keywords))
    if s.least_channels:
        gates.append(F.col("channels") >= s.least_channels)
    if s.least_margin:
        gates.append(F.col("margin") >= s.least_margin)
    if s.articles:
        gates.append(F.col("article_num").isin(*s.articles))
    if s.most_words is not None:
        gates.append(F.size(F.split(F.trim("text"), "\\s+")) <= s.most_words)
    if s.labels:
        gates.append(F.lower(F.trim("heading")).isin(*(x.lower() for x in s.labels)))
    if s.negative:
        gates.append(F.col("negative_hits") == 0)
    return reduce(lambda a, b: a & b, gates)


def evaluated(sections: DataFrame, s: Strategy) -> DataFrame:
    """The best section of each document, and whether it is a hit."""
    return best_sections(scored(sections, s)).withColumn("hit", accepted(s))


def discriminators(best: DataFrame, top: int = 10) -> DataFrame:
    """Headings commoner among misses than among hits, seen in two misses at least."""
    totals = best.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    by = best.groupBy(F.lower(F.trim("heading")).alias("phrase")).agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m")).join(F.broadcast(totals), F.lit(True))  # one row
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    by = by.withColumns({"miss_rate": rate("m", "misses"), "hit_rate": rate("h", "hits")}).where("m >= 2 and miss_rate > hit_rate")
    return by.orderBy(F.desc(F.col("miss_rate") - F.col("hit_rate")), "phrase").limit(top).select("phrase", F.round("miss_rate", 4).alias("miss_rate"), F.round("hit_rate", 4).alias("hit_rate"))


def percent_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, share of values at or below) for each distinct value."""
    return value_ranks(df, column).select("value", ((F.col("below") + F.col("n")) / F.col("total")).alias("rank"))


def outlier_risk(hits: DataFrame) -> DataFrame:
    """Risk 0..1 of each hit against its peers, and its flags; scores and margins are rounded to six digits, so they take few values."""
    hits = hits.withColumns({"_s": F.round("score", 6), "_m": F.round("margin", 6), "_h": F.lower(F.trim("heading"))})
    out = hits
    for column, name in (("_s", "score_pct"), ("_m", "margin_pct")):
        out = out.join(percent_ranks(hits, column).select(F.col("value").alias(column), F.col("rank").alias(name)), column)
    n = hits.agg(F.count(F.lit(1)).alias("n_hits"), F.median("chars").alias("_med"))
    out = out.join(F.broadcast(n), F.lit(True))  # one row
    mad = hits.join(F.broadcast(n), F.lit(True)).agg(F.median(F.abs(F.col("chars") - F.col("_med"))).alias("_mad"))
    out = out.join(F.broadcast(mad), F.lit(True))
    for column, name in (("_h", "heading_support"), ("article_num", "article_support"), ("template_family", "template_support")):
        out = out.join(hits.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias(name)), F.col(column).eqNullSafe(F.col("_v"))).drop("_v").withColumn(name, F.col(name) / F.col("n_hits"))
    z = F.abs(F.when(F.col("_mad") > 1e-9, 0.6745 * (F.col("chars") - F.col("_med")) / F.col("_mad")).otherwise(0.0))
    single = F.col("channels") <= 1
    parts = {"score": 1 - F.col("score_pct"), "margin": 1 - F.col("margin_pct"), "heading": 1 - F.col("heading_support"), "article": 1 - F.col("article_support"), "template": 1 - F.col("template_support"), "length": F.least(F.lit(1.0), z / 4.0), "single": single.cast("double")}
    one = 1 / F.col("n_hits")
    flags = [
        ("score_low_tail", F.col("score_pct") <= 0.10), ("margin_low_tail", F.col("margin_pct") <= 0.10), ("heading_rare", F.col("heading_support") <= F.greatest(one, F.lit(0.01))),
        ("article_rare", F.col("article_support") <= F.greatest(one, F.lit(0.03))), ("template_rare", F.col("template_support") <= F.greatest(one, F.lit(0.03))), ("section_length_extreme", z >= 3.0), ("single_channel_match", single),
    ]
    risk = _sum(F.lit(w) * parts[k] for k, w in RISK_WEIGHTS.items())
    return out.select("doc_id", "section_number", F.round(risk, 4).alias("risk"), F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags))), ",").alias("flags"))


def runtime_confidence(best: DataFrame) -> DataFrame:
    """Score, margin (full at 0.40) and channels (full at three), weighted; four digits, rounded from the double's own value."""
    bound = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    parts = {"score": bound(F.col("score")), "margin": bound(F.col("margin") / 0.40), "channels": bound(F.col("channels") / 3.0)}
    return best.withColumn("confidence", F.round(_sum(F.lit(w) * parts[k] for k, w in RUNTIME_WEIGHTS.items()) * 10_000, 0) / 10_000)


def heading_exactness(heading: Column, values: tuple[str, ...]) -> Column:
    """1 for an equal heading, 0.7 where it contains a value, 0.5 where a value contains it, 0.3 where a word is shared."""
    h = F.lower(F.trim(heading))
    words = F.split(h, "\\s+")
    steps = [(h == x, 1.0) for x in values], [(h.contains(x), 0.7) for x in values], [((h != "") & F.lit(x).contains(h), 0.5) for x in values], [(F.arrays_overlap(words, F.array(*map(F.lit, x.split()))), 0.3) for x in values]
    out = None
    for test, value in (pair for step in steps for pair in step):
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(0.0)


def link_confidence(df: DataFrame) -> DataFrame:
    """Weighted sum of seven factors (columns named as in LINK_WEIGHTS; null is neutral) and its tier."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _sum(F.lit(w) * F.coalesce(F.col(k), F.lit(0.5)) for k, w in LINK_WEIGHTS.items())))
    df = df.withColumn("confidence", F.round(score, 6))
    return df.withColumn("tier", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))


def calibrated(labelled: DataFrame, target: float = 0.9) -> DataFrame:
    """One row: the highest of the thresholds 0.95, 0.90 ... 0.05 whose precision reaches the target, else 0.8.

    ``labelled`` has confidence and positive. One pass counts by the highest threshold
    that each row reaches; the rest is on nineteen rows.
    """
    step = F.least(F.lit(95), (F.floor(F.col("confidence") * 20 + 1e-9) * 5).cast("int"))
    counts = labelled.groupBy(step.alias("pct")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    grid = labelled.sparkSession.range(1, 20).select((F.col("id") * 5).cast("int").alias("pct"))
    above = W.orderBy(F.desc("pct"))
    swept = grid.join(counts, "pct", "left").withColumns({"tp": F.sum(F.coalesce("p", F.lit(0))).over(above), "fp": F.sum(F.coalesce("n", F.lit(0))).over(above)})
    swept = swept.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)))
    total = counts.agg(F.sum("p").alias("positives"), F.sum(F.col("p") + F.col("n")).alias("sample_size"))
    ok = F.col("precision") >= target
    pick = swept.agg(F.coalesce(F.max(F.when(ok, F.struct("pct", "precision", "tp"))), F.max(F.when(F.col("pct") == 80, F.struct("pct", "precision", "tp")))).alias("x"))
    high = F.col("x.pct") / 100
    picked = pick.join(F.broadcast(total), F.lit(True)).select(F.round(high, 2).alias("high_threshold"), F.round(high / 2, 2).alias("medium_threshold"), F.round("x.precision", 4).alias("precision"), F.coalesce(F.round(F.try_divide("x.tp", "positives"), 4), F.lit(0.0)).alias("recall"), "sample_size", high.alias("_h"))  # one row
    load = labelled.join(F.broadcast(picked.select("_h")), (F.col("confidence") >= F.col("_h") / 2) & (F.col("confidence") < F.col("_h"))).agg(F.count(F.lit(1)).alias("review_load"))
    return picked.drop("_h").join(F.broadcast(load), F.lit(True))


def conflict_matrix(edges: DataFrame) -> DataFrame:
    """(a, b, policy, edge_types): the strongest policy of each pair of families; independent pairs are left out."""
    policy = F.create_map(*(F.lit(x) for k in EDGE_POLICY.items() for x in k))[F.col("edge_type")]
    rank = F.create_map(*(F.lit(x) for k in POLICY_RANK.items() for x in k))[policy]
    df = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "edge_type", policy.alias("policy"), rank.alias("rank")).where("policy is not null")
    df = df.groupBy("a", "b").agg(F.max(F.struct("rank", "policy")).alias("x"), F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_types"))  # at most eighteen types
    return df.where("x.rank > 0").select("a", "b", F.col("x.policy").alias("policy"), "edge_types")


def conflicts(links: DataFrame, matrix: DataFrame) -> DataFrame:
    """(doc_id, section_number, a, b, policy) where linked families of one section conflict.

    Families of a section are few and distinct, so their pairs are bounded by the square of the number of families, not of links.
    """
    own = links.select("doc_id", "section_number", "family_id").distinct()
    pairs = own.withColumnRenamed("family_id", "a").join(own.withColumnRenamed("family_id", "b"), ["doc_id", "section_number"]).where("a < b")
    return pairs.join(matrix.select("a", "b", "policy"), ["a", "b"])


def drift(now: DataFrame, expected: DataFrame, key: str, limit: float = 0.1) -> DataFrame:
    """Keys whose count departs from the expected one by more than ``limit`` of it."""
    n = now.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    df = expected.join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    share = F.abs(F.col("actual") - F.col("expected")) / F.col("expected")
    return df.where(F.col("expected") > 0).select(key, "expected", "actual", F.round(share, 4).alias("change"), (share > limit).alias("drifted"))


STRATEGY = Strategy(headings=("the of", "in the"), keywords=("the", "and", "with", "for"), strong=("of the",), weak=("to the", "and the"), negative=("zzz",), least_keywords=2, least_channels=1, most_words=5000)


def _best(spark, d) -> DataFrame:
    return evaluated(v.sections(spark, d), STRATEGY)


_has = lambda column, phrases: " + ".join(f"contains({column}, '{p}')::INT" for p in phrases) or "0"
_SCORED = (
    v.with_views("sections")
    + f""", s0 AS (SELECT *, lower(text) AS low, lower(heading) AS lh FROM sections),
s1 AS (SELECT *, ({" OR ".join(f"contains(lh, '{p}') OR contains(replace(lh, ' ', ''), '{p.replace(' ', '')}')" for p in STRATEGY.headings)}) AS hh, {_has("low", STRATEGY.keywords)} AS keyword_hits, 2 * ({_has("low", STRATEGY.strong)}) + {_has("low", STRATEGY.weak)} AS t, {_has("low", STRATEGY.negative)} AS negative_hits FROM s0),
s2 AS (SELECT *, 0.4::DOUBLE + 0.3::DOUBLE * (keyword_hits / 4.0::DOUBLE) AS kw, 0.25::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, t / 6.0::DOUBLE) AS dna FROM s1),
scored AS (SELECT *, CASE WHEN hh AND (keyword_hits > 0 OR t > 0) THEN 0.8::DOUBLE + 0.3::DOUBLE * kw + 0.2::DOUBLE * dna ELSE greatest(CASE WHEN hh THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN keyword_hits > 0 THEN kw ELSE 0 END, CASE WHEN t > 0 THEN dna ELSE 0 END) END AS score,
  hh::INT + (keyword_hits > 0)::INT + (t > 0)::INT AS channels,
  CASE WHEN hh AND (keyword_hits > 0 OR t > 0) THEN 'composite' WHEN hh THEN 'heading' WHEN keyword_hits > 0 AND (t = 0 OR kw >= dna) THEN 'keyword' WHEN t > 0 THEN 'dna' ELSE 'none' END AS method FROM s2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section_number) AS k, score - coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, section_number), 0) AS margin FROM scored),
best AS (SELECT *, score > 0.3 AND (method <> 'keyword' OR keyword_hits >= 2) AND channels >= 1 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 5000 AND negative_hits = 0 AS hit FROM ranked WHERE k = 1)
"""
)

register(
    "heading_match",
    lambda spark, d: v.sections(spark, d).where(heading_hit(F.col("heading"), STRATEGY.headings)).select("doc_id", "section_number"),
    _SCORED + "SELECT doc_id, section_number FROM s1 WHERE hh",
)
register(
    "keyword_density",
    lambda spark, d: v.sections(spark, d).select("doc_id", "section_number", (found(F.lower("text"), STRATEGY.keywords) / 4.0).alias("density")).where("density > 0"),
    _SCORED + "SELECT doc_id, section_number, keyword_hits / 4.0::DOUBLE AS density FROM s1 WHERE keyword_hits > 0",
)
register(
    "dna_density",
    lambda spark, d: v.sections(spark, d).select("doc_id", "section_number", F.round(F.least(F.lit(1.0), (2 * found(F.lower("text"), STRATEGY.strong) + found(F.lower("text"), STRATEGY.weak)) / 6.0), 6).alias("density")).where("density > 0"),
    _SCORED + "SELECT doc_id, section_number, round(least(1.0::DOUBLE, t / 6.0::DOUBLE), 6) AS density FROM s1 WHERE t > 0",
)
register(
    "section_score",
    lambda spark, d: scored(v.sections(spark, d), STRATEGY).where("score > 0").select("doc_id", "section_number", F.round("score", 6).alias("score"), "method", "channels"),
    _SCORED + "SELECT doc_id, section_number, round(score, 6) AS score, method, channels FROM scored WHERE score > 0",
)
register(
    "best_section_margin",
    lambda spark, d: best_sections(scored(v.sections(spark, d), STRATEGY)).select("doc_id", "section_number", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin")),
    _SCORED + "SELECT doc_id, section_number, round(score, 6) AS score, round(margin, 6) AS margin FROM ranked WHERE k = 1",
)
register(
    "acceptance_gates",
    lambda spark, d: _best(spark, d).select("doc_id", "section_number", "hit"),
    _SCORED + "SELECT doc_id, section_number, hit FROM best",
)
register(
    "strategy_evaluation",
    lambda spark, d: _best(spark, d).groupBy("method").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if(~F.col("hit") & (F.col("score") > 0.2)).alias("near_misses")),
    _SCORED + "SELECT method, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit AND score > 0.2) AS near_misses FROM best GROUP BY 1",
)
register(
    "miss_discriminators",
    lambda spark, d: discriminators(_best(spark, d).withColumn("heading", F.substring("heading", 1, 2))),
    _SCORED
    + """, c AS (SELECT lower(trim(left(heading, 2))) AS phrase, count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m FROM best GROUP BY 1), t AS (SELECT count(*) FILTER (hit) AS th, count(*) FILTER (NOT hit) AS tm FROM best),
r AS (SELECT phrase, m, coalesce(m / nullif(tm, 0)::DOUBLE, 0) AS mr, coalesce(h / nullif(th, 0)::DOUBLE, 0) AS hr FROM c, t)
SELECT phrase, round(mr, 4) AS miss_rate, round(hr, 4) AS hit_rate FROM r WHERE m >= 2 AND mr > hr ORDER BY mr - hr DESC, phrase LIMIT 10""",
)
register(
    "outlier_risk",
    lambda spark, d: outlier_risk(_best(spark, d).where("hit")),
    _SCORED
    + """, h AS (SELECT *, round(score, 6) AS rs, round(margin, 6) AS rm, lower(trim(heading)) AS hk FROM best WHERE hit),
st AS (SELECT count(*) AS n, median(chars) AS med FROM h), md AS (SELECT median(abs(chars - med)) AS mad FROM h, st),
p AS (SELECT h.*, n, (SELECT count(*) FROM h x WHERE x.rs <= h.rs) / n::DOUBLE AS sp, (SELECT count(*) FROM h x WHERE x.rm <= h.rm) / n::DOUBLE AS mp, count(*) OVER (PARTITION BY hk) / n::DOUBLE AS hs, count(*) OVER (PARTITION BY article_num) / n::DOUBLE AS ars, count(*) OVER (PARTITION BY template_family) / n::DOUBLE AS ts,
  abs(CASE WHEN mad > 1e-9 THEN 0.6745::DOUBLE * (chars - med) / mad ELSE 0 END) AS z FROM h, st, md)
SELECT doc_id, section_number, round(0.20::DOUBLE * (1 - sp) + 0.18::DOUBLE * (1 - mp) + 0.16::DOUBLE * (1 - hs) + 0.10::DOUBLE * (1 - ars) + 0.10::DOUBLE * (1 - ts) + 0.10::DOUBLE * least(1.0::DOUBLE, z / 4) + 0.16::DOUBLE * (channels <= 1)::INT, 4) AS risk,
  concat_ws(',', CASE WHEN sp <= 0.10 THEN 'score_low_tail' END, CASE WHEN mp <= 0.10 THEN 'margin_low_tail' END, CASE WHEN hs <= greatest(1 / n::DOUBLE, 0.01) THEN 'heading_rare' END, CASE WHEN ars <= greatest(1 / n::DOUBLE, 0.03) THEN 'article_rare' END,
  CASE WHEN ts <= greatest(1 / n::DOUBLE, 0.03) THEN 'template_rare' END, CASE WHEN z >= 3 THEN 'section_length_extreme' END, CASE WHEN channels <= 1 THEN 'single_channel_match' END) AS flags FROM p""",
)
register(
    "coverage_by_group",
    lambda spark, d: _best(spark, d).groupBy("template_family").agg(F.count(F.lit(1)).alias("docs"), F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("hit_rate")),
    _SCORED + "SELECT template_family, count(*) AS docs, round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS hit_rate FROM best GROUP BY 1",
)
register(
    "runtime_confidence",
    lambda spark, d: runtime_confidence(_best(spark, d)).select("doc_id", "confidence"),
    _SCORED + "SELECT doc_id, round(0.5::DOUBLE * least(1, score) + 0.2::DOUBLE * least(1, greatest(0, margin / 0.40::DOUBLE)) + 0.3::DOUBLE * (channels / 3.0::DOUBLE), 4) AS confidence FROM best",
)


def pattern_lab(spark, d) -> DataFrame:
    """Heading and keyword expressions over headings: the best section of each document, and hit rates by its article."""
    s = v.sections(spark, d)
    kw = (F.col("heading").rlike("(?i)the").cast("int") + F.col("heading").rlike("(?i)of").cast("int")) / 2.0
    head = F.col("heading").rlike("(?i)^(in|an)")
    s = s.withColumn("score", F.when(head, F.least(F.lit(1.0), 0.8 + 0.2 * kw)).otherwise(0.6 * kw))
    best = best_sections(s)
    return best.groupBy("article_num").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("score") >= 0.3) / F.count(F.lit(1)), 1).alias("hit_rate"))


register(
    "pattern_lab",
    pattern_lab,
    v.with_views("sections")
    + """, s AS (SELECT *, (regexp_matches(heading, '(?i)the')::INT + regexp_matches(heading, '(?i)of')::INT) / 2.0::DOUBLE AS kw, regexp_matches(heading, '(?i)^(in|an)') AS hh FROM sections),
b AS (SELECT article_num, CASE WHEN hh THEN least(1.0::DOUBLE, 0.8::DOUBLE + 0.2::DOUBLE * kw) ELSE 0.6::DOUBLE * kw END AS score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN hh THEN least(1.0::DOUBLE, 0.8::DOUBLE + 0.2::DOUBLE * kw) ELSE 0.6::DOUBLE * kw END DESC, section_number) AS k FROM s)
SELECT article_num, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (score >= 0.3) / count(*), 1) AS hit_rate FROM b WHERE k = 1 GROUP BY 1""",
)

FAMILIES = {"1-URGENT": ("in the", "the of"), "2-HIGH": ("und die", "of"), "3-MEDIUM": ("de la",), "4-NOT SPECIFIED": ("and",), "5-LOW": ("is",)}


def link_scores(spark, d) -> DataFrame:
    """Links of documents with sections: the seven factors from heading, article, clauses and history."""
    s = v.sections(spark, d).select("doc_id", "section_number", "article_num", "heading", "template_family")
    links = v.links(spark, d)
    history = links.groupBy("family_id").agg((F.count_if(F.col("status") == "active") / F.count(F.lit(1))).alias("template"))
    df = links.join(s, ["doc_id", "section_number"]).join(F.broadcast(history), "family_id")  # one row a family of rules
    exact = reduce(lambda a, b: a.when(F.col("family_id") == b[0], heading_exactness(F.col("heading"), b[1])), list(FAMILIES.items())[1:], F.when(F.col("family_id") == list(FAMILIES)[0], heading_exactness(F.col("heading"), FAMILIES[list(FAMILIES)[0]])))
    df = df.withColumns({"article": F.when(F.col("article_num") == 1, 1.0).when(F.col("article_num") > 2, 0.0), "heading": exact, "clause": F.col("confidence"), "terms": F.lit(None).cast("double"), "structure": F.when(F.col("section_number") < 3, 0.6).otherwise(0.3), "semantic": F.lit(None).cast("double")})
    return link_confidence(df).select("link_id", "confidence", "tier")


def _exact_sql() -> str:
    h = "lower(trim(heading))"
    out = []
    for family, values in FAMILIES.items():
        tests = [(f"{h} = '{x}'", 1.0) for x in values] + [(f"contains({h}, '{x}')", 0.7) for x in values] + [(f"({h} <> '' AND contains('{x}', {h}))", 0.5) for x in values] + [(f"list_has_any(regexp_split_to_array({h}, '\\s+'), {list(x.split())})", 0.3) for x in values]
        out.append(f"WHEN family_id = '{family}' THEN CASE " + " ".join(f"WHEN {t} THEN {x}::DOUBLE" for t, x in tests) + " ELSE 0 END")
    return "CASE " + " ".join(out) + " END"


register(
    "link_confidence",
    link_scores,
    v.with_views("sections", "links")
    + f""", h AS (SELECT family_id, count(*) FILTER (status = 'active') / count(*)::DOUBLE AS template FROM links GROUP BY 1),
x AS (SELECT link_id, round(0.22::DOUBLE * coalesce(CASE WHEN article_num = 1 THEN 1.0 WHEN article_num > 2 THEN 0.0 END, 0.5)::DOUBLE + 0.28::DOUBLE * coalesce({_exact_sql()}, 0.5) + 0.13::DOUBLE * confidence + 0.10::DOUBLE * template + 0.09::DOUBLE * 0.5 + 0.08::DOUBLE * (CASE WHEN section_number < 3 THEN 0.6 ELSE 0.3 END)::DOUBLE + 0.10::DOUBLE * 0.5, 6) AS confidence
  FROM links JOIN sections USING (doc_id, section_number) JOIN h USING (family_id))
SELECT link_id, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM x""",
)
register(
    "threshold_calibration",
    lambda spark, d: calibrated(v.links(spark, d).where("status <> 'unlinked'").select("confidence", (F.col("status") == "active").alias("positive")), 0.45),
    v.with_views("links")
    + """, l AS (SELECT confidence, status = 'active' AS pos FROM links WHERE status <> 'unlinked'), g AS (SELECT unnest(range(1, 20)) * 5 AS pct),
s AS (SELECT pct, count(*) FILTER (pos) AS tp, count(*) AS n FROM g JOIN l ON confidence + 5e-11 >= pct / 100.0::DOUBLE GROUP BY 1), o AS (SELECT pct, tp, tp / n::DOUBLE AS precision FROM s WHERE tp / n::DOUBLE >= 0.45 ORDER BY pct DESC LIMIT 1),
p AS (SELECT * FROM o UNION ALL SELECT pct, tp, tp / n::DOUBLE FROM s WHERE pct = 80 AND NOT EXISTS (SELECT 1 FROM o))
SELECT round(pct / 100.0::DOUBLE, 2) AS high_threshold, round(pct / 200.0::DOUBLE, 2) AS medium_threshold, round(precision, 4) AS precision, round(tp / (SELECT count(*) FROM l WHERE pos)::DOUBLE, 4) AS recall, (SELECT count(*) FROM l) AS sample_size,
  (SELECT count(*) FROM l WHERE confidence >= pct / 200.0::DOUBLE AND confidence < pct / 100.0::DOUBLE) AS review_load FROM p""",
)
_KINDS = list(EDGE_POLICY)


def edges(spark, d) -> DataFrame:
    """Typed edges between families, from the orders of customers of two priorities."""
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    place = F.ascii("o_orderpriority") + 3 * (F.col("o_orderkey") % 5) + F.when(F.col("o_orderstatus") == "P", 4).otherwise(0)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (place % 18 + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderpriority").alias("source"), target.alias("target"), kind.alias("edge_type"))


_EDGES = f""", e AS (SELECT o_orderpriority AS source, {list(FAMILIES)}[o_orderkey % 5 + 1] AS target, {_KINDS}[(ascii(o_orderpriority) + 3 * (o_orderkey % 5) + CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 0 END) % 18 + 1] AS edge_type FROM orders),
p AS (SELECT least(source, target) AS a, greatest(source, target) AS b, edge_type, CASE {" ".join(f"WHEN edge_type = '{k}' THEN '{x}'" for k, x in EDGE_POLICY.items())} END AS policy FROM e WHERE source <> target),
m AS (SELECT a, b, arg_max(policy, r) AS policy, max(r) AS r, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM (SELECT *, CASE {" ".join(f"WHEN policy = '{k}' THEN {x}" for k, x in POLICY_RANK.items())} END AS r FROM p) GROUP BY 1, 2)
"""
register("conflict_matrix", lambda spark, d: conflict_matrix(edges(spark, d)), v.with_views("links") + _EDGES + "SELECT a, b, policy, edge_types FROM m WHERE r > 0")
register(
    "section_conflicts",
    lambda spark, d: conflicts(v.links(spark, d), conflict_matrix(edges(spark, d))),
    v.with_views("links") + _EDGES + "SELECT DISTINCT x.doc_id, x.section_number, m.a, m.b, policy FROM links x JOIN links y ON x.doc_id = y.doc_id AND x.section_number = y.section_number AND x.family_id < y.family_id JOIN m ON m.a = x.family_id AND m.b = y.family_id WHERE r > 0",
)
register(
    "drift_check",
    lambda spark, d: drift(v.links(spark, d).where("created_at >= '1998-01-01'"), v.links(spark, d).where("created_at < '1998-01-01'").groupBy("family_id").agg(F.count(F.lit(1)).alias("expected")), "family_id"),
    v.with_views("links") + ", e AS (SELECT family_id, count(*) AS expected FROM links WHERE created_at < '1998-01-01' GROUP BY 1), a AS (SELECT family_id, count(*) AS actual FROM links WHERE created_at >= '1998-01-01' GROUP BY 1) SELECT family_id, expected, coalesce(actual, 0) AS actual, round(abs(coalesce(actual, 0) - expected) / expected::DOUBLE, 4) AS change, abs(coalesce(actual, 0) - expected) / expected::DOUBLE > 0.1 AS drifted FROM e LEFT JOIN a USING (family_id)",
)
register(
    "priority_score",
    lambda spark, d: v.links(spark, d).select("link_id", (0.5 * (1 - F.abs(F.col("confidence") - 0.5) * 2) + 0.3 * F.least(F.lit(1.0), F.col("confidence") * 600000.0 / 400000.0) + 0.2 * F.when(F.col("section_number") > 4, 0.25).otherwise(0.0)).alias("p")).select("link_id", (F.round(F.col("p") * 1_000_000, 0) / 1_000_000).alias("priority")),
    v.with_views("links") + "SELECT link_id, round(0.5::DOUBLE * (1 - abs(confidence - 0.5::DOUBLE) * 2) + 0.3::DOUBLE * least(1.0::DOUBLE, confidence * 600000.0::DOUBLE / 400000.0::DOUBLE) + 0.2::DOUBLE * (CASE WHEN section_number > 4 THEN 0.25 ELSE 0 END)::DOUBLE, 6) AS priority FROM links",
)
