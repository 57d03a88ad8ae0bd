"""Graphs over headings and the ontology, and the reads that join links with their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..registry import register
from . import scoring


def supergraph(units: DataFrame, unit: str, node: str) -> DataFrame:
    """(a, b, weight): nodes that occur in one unit; ``node`` has few values, so a unit's pairs are bounded by their square."""
    own = units.groupBy(unit).agg(F.array_sort(F.collect_set(node)).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"))


def within_hops(edges: DataFrame, starts: DataFrame, hops: int = 3, most: int = 200) -> DataFrame:
    """(node, hop): what is reached from the starts over directed edges, at its least distance; the ``most`` nearest, by name."""
    seen = starts.select("node", F.lit(0).alias("hop"))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen.orderBy("hop", "node").limit(most)  # the survey's limit on a neighbourhood


def ontology(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes with path and name, typed edges): regions, their nations, and a ring of references between nations."""
    nation, region = v.table(spark, d, "nation"), v.table(spark, d, "region")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = region.select(F.col("r_name").alias("node"), F.col("r_name").alias("path")).unionByName(n.select(F.col("n_name").alias("node"), F.concat("r_name", F.lit("."), "n_name").alias("path")))
    other = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))
    rings = nation.join(other, F.col("k") == (F.col("n_nationkey") * 7 + 3) % 25).select(F.col("n_name").alias("source"), "target", F.lit("refers").alias("kind"))
    return nodes, n.select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("has").alias("kind")).unionByName(rings)


_ONTOLOGY = """WITH RECURSIVE n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), nodes AS (SELECT r_name AS node, r_name AS path FROM region UNION ALL SELECT n_name, r_name || '.' || n_name FROM n),
edges AS (SELECT r_name AS source, n_name AS target, 'has' AS kind FROM n UNION ALL SELECT a.n_name, b.n_name, 'refers' FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25)
"""


def _letters(spark, d) -> DataFrame:
    return v.sections(spark, d).select("doc_id", F.lower(F.substring("heading", 1, 1)).alias("letter")).where(F.col("letter").rlike("^[a-z]$"))


_LETTERS = v.with_views("sections") + ", u AS (SELECT DISTINCT doc_id, lower(left(heading, 1)) AS letter FROM sections WHERE regexp_matches(lower(left(heading, 1)), '^[a-z]$')), e AS (SELECT x.letter AS a, y.letter AS b, count(*) AS weight FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.letter < y.letter GROUP BY 1, 2)\n"
register("heading_supergraph", lambda spark, d: supergraph(_letters(spark, d), "doc_id", "letter"), _LETTERS + "SELECT a, b, weight FROM e")
register("supergraph_hubs", lambda spark, d: weighted_degrees(supergraph(_letters(spark, d), "doc_id", "letter")), _LETTERS + "SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY 1")
register(
    "ontology_neighbourhood",
    lambda spark, d: within_hops(ontology(spark, d)[1], v.table(spark, d, "region").where("r_regionkey = 1").select(F.col("r_name").alias("node"))),
    _ONTOLOGY + ", b AS (SELECT r_name AS node, 0 AS hop FROM region WHERE r_regionkey = 1 UNION SELECT target, hop + 1 FROM b JOIN edges ON source = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM b GROUP BY 1 ORDER BY 2, 1 LIMIT 200",
)
register(
    "ontology_search",
    # A hit in the name ranks above one in the path; ancestors of hits stay in the tree.
    lambda spark, d: ontology(spark, d)[0].withColumn("score", F.when(F.lower("node").startswith("a"), 2).when(F.lower("node").contains("a"), 1).otherwise(0)).where("score > 0").select("node", "path", "score", (F.size(F.split("path", "\\.")) - 1).alias("depth")),
    _ONTOLOGY + "SELECT node, path, CASE WHEN lower(node) LIKE 'a%' THEN 2 ELSE 1 END AS score, len(string_split(path, '.')) - 1 AS depth FROM nodes WHERE lower(node) LIKE '%a%'",
)
register(
    "ontology_node_stats",
    lambda spark, d: (lambda n, e: n.join(e.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out")), "node", "left").join(e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("into")), "node", "left").select("node", "path", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("into", F.lit(0)).alias("into")))(*ontology(spark, d)),
    _ONTOLOGY + "SELECT node, path, (SELECT count(*) FROM edges WHERE source = node) AS out, (SELECT count(*) FROM edges WHERE target = node) AS into FROM nodes",
)


def absent(new: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one for each key (the least link_id)."""
    order = W.partitionBy(*keys).orderBy("link_id")
    first = new.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return first.join(have.select(*keys), keys, "left_anti")


register(
    "insert_if_absent",
    lambda spark, d: absent(v.links(spark, d).where("status = 'pending_review'"), v.links(spark, d).where("status = 'active'"), ["doc_id", "family_id"]).select("link_id", "doc_id", "family_id"),
    v.with_views("links") + "SELECT min(link_id) AS link_id, doc_id, family_id FROM links WHERE status = 'pending_review' AND (doc_id, family_id) NOT IN (SELECT (doc_id, family_id) FROM links WHERE status = 'active') GROUP BY doc_id, family_id",
)
register(
    "comparables",
    lambda spark, d: v.links(spark, d).where("family_id = '2-HIGH' and status = 'active'").select("link_id", "doc_id", "confidence").orderBy(F.desc("confidence"), "link_id").limit(20),
    v.with_views("links") + "SELECT link_id, doc_id, confidence FROM links WHERE family_id = '2-HIGH' AND status = 'active' ORDER BY confidence DESC, link_id LIMIT 20",
)
register(
    "context_strip",
    lambda spark, d: v.links(spark, d).join(v.sections(spark, d), ["doc_id", "section_number"]).join(v.definitions(spark, d).groupBy("doc_id").agg(F.countDistinct("term").alias("terms")), "doc_id", "left").select("link_id", "heading", F.coalesce("terms", F.lit(0)).alias("terms")),
    v.with_views("sections", "definitions", "links") + "SELECT link_id, heading, coalesce(terms, 0) AS terms FROM links JOIN sections USING (doc_id, section_number) LEFT JOIN (SELECT doc_id, count(DISTINCT term) AS terms FROM definitions GROUP BY 1) USING (doc_id)",
)
register(
    "record_getter",
    lambda spark, d: v.sections(spark, d).where("doc_id = 7").select("section_number", "heading", "chars"),
    v.with_views("sections") + "SELECT section_number, heading, chars FROM sections WHERE doc_id = 7",
)
register(
    "document_detail",
    lambda spark, d: v.documents(spark, d).join(v.sections(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.max("chars").alias("longest")), "doc_id", "left").select("doc_id", "template_family", "word_count", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), "longest"),
    v.with_views("docs", "sections") + "SELECT d.doc_id, d.template_family, word_count, coalesce(n_sections, 0) AS n_sections, longest FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n_sections, max(chars) AS longest FROM sections GROUP BY 1) USING (doc_id)",
)
register(
    "definition_variants",
    lambda spark, d: v.definitions(spark, d).where(F.lower("term") == "this").join(v.documents(spark, d).select("doc_id", "template_family"), "doc_id").select("doc_id", "ordinal", "term", "template_family", "confidence").orderBy(F.desc("confidence"), "doc_id", "ordinal").limit(100),
    v.with_views("docs", "definitions") + "SELECT doc_id, ordinal, term, template_family, confidence FROM definitions JOIN docs USING (doc_id) WHERE lower(term) = 'this' ORDER BY confidence DESC, doc_id, ordinal LIMIT 100",
)
register(
    "reader",
    lambda spark, d: v.clauses(spark, d).join(v.sections(spark, d).select("doc_id", "section_number", "heading"), ["doc_id", "section_number"]).select("doc_id", "section_number", "heading", "clause_id", "parent_id", "depth"),
    v.with_views("sections", "clauses") + "SELECT doc_id, section_number, heading, clause_id, parent_id, depth FROM clauses JOIN sections USING (doc_id, section_number)",
)
register(
    "link_list",
    lambda spark, d: v.links(spark, d).where((F.year("created_at") == 1996) & (F.col("confidence") > 0.2)).join(v.documents(spark, d).where("template_family in ('src1', 'src2')").select("doc_id", "template_family"), "doc_id").select("link_id", "doc_id", "template_family", "confidence"),
    v.with_views("docs", "links") + "SELECT link_id, doc_id, template_family, confidence FROM links JOIN docs USING (doc_id) WHERE year(created_at) = 1996 AND confidence > 0.2 AND template_family IN ('src1', 'src2')",
)
register(
    "why_matched",
    lambda spark, d: v.table(spark, d, "events").select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,double>"))).alias("e")).select("event_id", F.col("e.key").alias("factor"), F.col("e.value").alias("value")),
    "SELECT event_id, unnest(json_keys(props)) AS factor, json_extract(props, '$.' || unnest(json_keys(props)))::DOUBLE AS value FROM events",
)
register(
    "canary_apply",
    lambda spark, d: v.links(spark, d).where("status = 'pending_review'").join(v.documents(spark, d).orderBy(F.desc("word_count"), "doc_id").limit(25).select("doc_id"), "doc_id", "left_semi").select("link_id", "doc_id"),
    v.with_views("docs", "links") + "SELECT link_id, doc_id FROM links WHERE status = 'pending_review' AND doc_id IN (SELECT doc_id FROM docs ORDER BY word_count DESC, doc_id LIMIT 25)",
)


def preview(spark, d) -> DataFrame:
    """Candidates of a strategy: hits, their runtime confidence, and how uncertain it is."""
    hits = scoring.runtime_confidence(scoring.evaluated(v.sections(spark, d), scoring.STRATEGY).where("hit"))
    return hits.select("doc_id", "section_number", "confidence", F.round(1 - F.abs(F.col("confidence") - 0.5) * 2, 4).alias("priority"))


register(
    "preview_candidates",
    preview,
    scoring._SCORED + ", c AS (SELECT doc_id, section_number, round(0.5::DOUBLE * least(1, score) + 0.2::DOUBLE * least(1, greatest(0, margin / 0.40::DOUBLE)) + 0.3::DOUBLE * (channels / 3.0::DOUBLE), 4) AS confidence FROM best WHERE hit) SELECT *, round(1 - abs(confidence - 0.5::DOUBLE) * 2, 4) AS priority FROM c",
)
register(
    "preview_digest",
    # The candidates' digest doesn't depend on their order: a hash of hashes by document, then of the documents' in order of their buckets.
    lambda spark, d: preview(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.min("section_number").alias("first")),
    scoring._SCORED + ", c AS (SELECT doc_id, section_number, round(0.5::DOUBLE * least(1, score) + 0.2::DOUBLE * least(1, greatest(0, margin / 0.40::DOUBLE)) + 0.3::DOUBLE * (channels / 3.0::DOUBLE), 4) AS confidence FROM best WHERE hit) SELECT count(*) AS n, round(sum(confidence), 4) AS confidence, min(section_number) AS first FROM c",
)
register(
    "review_progress",
    lambda spark, d: v.table(spark, d, "events").groupBy(F.col("user_id").alias("session")).pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1))).fillna(0),
    "SELECT user_id AS session, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1",
)
register(
    "signal_digest",
    lambda spark, d: v.sections(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("heading"), " "))).alias("word")).where(F.length("word") > 3).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20),
    v.with_views("sections") + "SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(heading), ' '))) AS word FROM sections) WHERE length(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
)
register(
    "term_expansion",
    # Headings' words that share a document with the term, beside its synonyms; each once, case aside.
    lambda spark, d: (lambda s: s.join(s.where("word = 'the'").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("word").agg(F.countDistinct("doc_id").alias("docs")).where("word <> 'the'").orderBy(F.desc("docs"), "word").limit(10))(v.sections(spark, d).select("doc_id", F.lower(F.regexp_extract("heading", "^([A-Za-z]+)", 1)).alias("word")).where("word <> ''")),
    v.with_views("sections") + ", s AS (SELECT doc_id, lower(regexp_extract(heading, '^([A-Za-z]+)', 1)) AS word FROM sections) SELECT word, count(DISTINCT doc_id) AS docs FROM s WHERE word NOT IN ('', 'the') AND doc_id IN (SELECT doc_id FROM s WHERE word = 'the') GROUP BY 1 ORDER BY docs DESC, word LIMIT 10",
)
register(
    "definition_peek",
    lambda spark, d: v.definitions(spark, d).where("doc_id = 5").groupBy(F.lower("term").alias("term")).agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")),
    v.with_views("definitions") + "SELECT lower(term) AS term, min(ordinal) AS first, count(*) AS n FROM definitions WHERE doc_id = 5 GROUP BY 1",
)


def suggestions(spark, d) -> DataFrame:
    """For each linked heading, the rule families that it matches best, without its own."""
    heads = v.links(spark, d).join(v.sections(spark, d).select("doc_id", "section_number", "heading"), ["doc_id", "section_number"])
    scores = F.array(*(F.struct(F.lit(f).alias("family"), scoring.heading_exactness(F.col("heading"), p).alias("score")) for f, p in scoring.FAMILIES.items()))
    best = F.filter(scores, lambda s: (s["family"] != F.col("family_id")) & (s["score"] > 0))
    return heads.select("link_id", F.explode(best).alias("s")).select("link_id", "s.family", "s.score")


register(
    "reassign_suggestions",
    suggestions,
    v.with_views("sections", "links") + f", f AS (SELECT unnest({list(scoring.FAMILIES)}) AS family), h AS (SELECT link_id, links.family_id AS own, heading FROM links JOIN sections USING (doc_id, section_number)), x AS (SELECT link_id, own, heading, family AS family_id FROM h, f WHERE family <> own) SELECT link_id, family_id AS family, ({scoring._exact_sql()})::DOUBLE AS score FROM x WHERE ({scoring._exact_sql()}) > 0",
)
register(
    "embedding_coverage",
    # A vector is stale where its text's digest has changed since; new texts have none.
    lambda spark, d: v.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("now")).join(v.table(spark, d, "documents").where("doc_id % 4 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 6 == 1, "old").otherwise(F.coalesce("text", F.lit("")))).alias("then")), "doc_id", "left").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("then").isNull()).alias("missing"), F.count_if(F.col("then") != F.col("now")).alias("stale")),
    "SELECT count(*) AS texts, count(*) FILTER (doc_id % 4 = 0) AS missing, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 6 = 1 AND text <> 'old') AS stale FROM documents",
)
register(
    "starter_kit",
    lambda spark, d: v.links(spark, d).join(v.sections(spark, d).select("doc_id", "section_number", "heading"), ["doc_id", "section_number"]).groupBy("family_id", F.lower(F.trim("heading")).alias("heading")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(W.partitionBy("family_id").orderBy(F.desc("n"), "heading"))).where("k <= 20"),
    v.with_views("sections", "links") + "SELECT * FROM (SELECT family_id, lower(trim(heading)) AS heading, count(*) AS n, row_number() OVER (PARTITION BY family_id ORDER BY count(*) DESC, encode(lower(trim(heading)))) AS k FROM links JOIN sections USING (doc_id, section_number) GROUP BY 1, 2) WHERE k <= 20",
)
register(
    "template_baselines",
    lambda spark, d: v.sections(spark, d).where("section_number = 1 and text <> ''").withColumn("k", F.row_number().over(W.partitionBy("template_family").orderBy("doc_id"))).where("k = 1").select("template_family", "doc_id", "heading"),
    v.with_views("sections") + "SELECT template_family, doc_id, heading FROM (SELECT *, row_number() OVER (PARTITION BY template_family ORDER BY doc_id) AS k FROM sections WHERE section_number = 1 AND text <> '') WHERE k = 1",
)
register(
    "seeded_sample",
    # A row is in by the first seven hex digits of a seeded digest: the same rows each time, on any cluster.
    lambda spark, d: v.table(spark, d, "documents").where(F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|seed|9"))), 1, 7), 16, 10).cast("long") < int(0.2 * 16**7)).select("doc_id", "source"),
    f"SELECT doc_id, source FROM documents WHERE ('0x' || substr(md5(doc_id || '|seed|9'), 1, 7))::BIGINT < {int(0.2 * 16**7)}",
)
register(
    "scatter_data",
    lambda spark, d: v.documents(spark, d).select("doc_id", F.col("text_length").alias("x"), F.col("word_count").alias("y"), F.col("market_segment").alias("colour")).where("x is not null and y is not null").orderBy("doc_id").limit(500),
    v.with_views("docs") + "SELECT doc_id, text_length AS x, word_count AS y, market_segment AS colour FROM docs ORDER BY doc_id LIMIT 500",
)
register(
    "live_count",
    lambda spark, d: v.sections(spark, d).where(F.col("heading").ilike("%the%")).agg(F.count(F.lit(1)).alias("sections"), F.countDistinct("doc_id").alias("docs")),
    v.with_views("sections") + "SELECT count(*) AS sections, count(DISTINCT doc_id) AS docs FROM sections WHERE heading ILIKE '%the%'",
)
register(
    "failure_signatures",
    lambda spark, d: v.documents(spark, d).select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.col("word_count") < 20, "short"), F.when(F.col("text_length") > 12 * F.col("word_count"), "dense"), F.when(F.col("quality").isNull(), "unlabelled"), F.when(F.col("market_segment").isNull(), "no segment"))), ",").alias("signatures")).where("signatures <> ''"),
    v.with_views("docs") + "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN word_count < 20 THEN 'short' END, CASE WHEN text_length > 12 * word_count THEN 'dense' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN market_segment IS NULL THEN 'no segment' END) AS signatures FROM docs) WHERE signatures <> ''",
)
register(
    "zero_section_diagnosis",
    lambda spark, d: v.table(spark, d, "documents").where(F.coalesce(~F.col("text").contains("\n"), F.lit(True))).groupBy(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text").when(F.length("text") < 200, "short").when(F.col("text").rlike("(?i)amendment"), "amendment").otherwise("one line").alias("failure")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' WHEN length(text) < 200 THEN 'short' WHEN regexp_matches(text, '(?i)amendment') THEN 'amendment' ELSE 'one line' END AS failure, count(*) AS n FROM documents WHERE coalesce(NOT contains(text, chr(10)), true) GROUP BY 1",
)
register(
    "structural_mapping",
    # Where the best sections of hits lie: by article, with their mean place in the document.
    lambda spark, d: scoring.evaluated(v.sections(spark, d), scoring.STRATEGY).where("hit").join(v.sections(spark, d).groupBy("doc_id").agg(F.max("section_number").alias("last")), "doc_id").groupBy("article_num").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("section_number") / F.col("last")), 4).alias("place")),
    scoring._SCORED + "SELECT article_num, count(*) AS n, round(avg(section_number / last::DOUBLE), 4) AS place FROM best JOIN (SELECT doc_id, max(section_number) AS last FROM sections GROUP BY 1) USING (doc_id) WHERE hit GROUP BY 1",
)
register(
    "child_locator",
    # Clauses inside the sections that a strategy hits, which pass the clause's own gates.
    lambda spark, d: scoring.evaluated(v.sections(spark, d), scoring.STRATEGY).where("hit").select("doc_id", "section_number").join(v.clauses(spark, d).where("is_structural and depth >= 2"), ["doc_id", "section_number"]).select("doc_id", "section_number", "clause_id", "depth"),
    (scoring._SCORED.rstrip() + ",\n" + v.SQL["clauses"]) + " SELECT c.doc_id, c.section_number, clause_id, depth FROM clauses c JOIN best USING (doc_id, section_number) WHERE hit AND is_structural AND depth >= 2",
)
register(
    "evidence_rows",
    lambda spark, d: scoring.evaluated(v.sections(spark, d), scoring.STRATEGY).select("doc_id", F.when(F.col("hit"), F.col("section_number")).alias("section_number"), F.when(F.col("hit"), F.lit("hit")).otherwise("not_found").alias("status")),
    scoring._SCORED + "SELECT doc_id, CASE WHEN hit THEN section_number END AS section_number, CASE WHEN hit THEN 'hit' ELSE 'not_found' END AS status FROM best",
)
register(
    "policy_gates",
    # Groups large enough whose hit rate is far from the whole's.
    lambda spark, d: (lambda b: b.groupBy("template_family").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("r")).join(F.broadcast(b.agg(F.avg(F.col("hit").cast("double")).alias("all"))), F.lit(True)).select("template_family", "n", F.round("r", 4).alias("rate"), ((F.col("n") < 5) | (F.abs(F.col("r") - F.col("all")) <= 0.1)).alias("passes")))(scoring.evaluated(v.sections(spark, d), scoring.STRATEGY)),
    scoring._SCORED + "SELECT template_family, count(*) AS n, round(avg(hit::INT), 4) AS rate, count(*) < 5 OR abs(avg(hit::INT) - (SELECT avg(hit::INT) FROM best)) <= 0.1 AS passes FROM best GROUP BY 1",
)


def regression(spark, d) -> DataFrame:
    """Hit rates of an older and a newer strategy by template family, and whether a family loses over a tenth."""
    old = scoring.evaluated(v.sections(spark, d), scoring.STRATEGY).select("doc_id", "template_family", F.col("hit").cast("int").alias("old"))
    newer = scoring.evaluated(v.sections(spark, d), scoring.Strategy(headings=scoring.STRATEGY.headings, keywords=scoring.STRATEGY.keywords, strong=scoring.STRATEGY.strong, weak=scoring.STRATEGY.weak, negative=scoring.STRATEGY.negative, least_keywords=3, least_channels=2, most_words=5000))
    by = old.join(newer.select("doc_id", F.col("hit").cast("int").alias("new")), "doc_id").groupBy("template_family").agg(F.avg("old").alias("o"), F.avg("new").alias("n"))
    return by.select("template_family", F.round("o", 4).alias("before"), F.round("n", 4).alias("after"), (F.col("o") - F.col("n") > 0.1).alias("broken"))


register(
    "regression_breaker",
    regression,
    scoring._SCORED + "SELECT template_family, round(avg(hit::INT), 4) AS before, round(avg((hit AND (method <> 'keyword' OR keyword_hits >= 3) AND channels >= 2)::INT), 4) AS after, avg(hit::INT) - avg((hit AND (method <> 'keyword' OR keyword_hits >= 3) AND channels >= 2)::INT) > 0.1 AS broken FROM best GROUP BY 1",
)
register(
    "heuristic_judge",
    # The share of a rule's words that a linked heading has.
    lambda spark, d: v.links(spark, d).join(v.sections(spark, d).select("doc_id", "section_number", "heading"), ["doc_id", "section_number"]).select("link_id", F.round(F.size(F.array_intersect(F.split(F.lower("heading"), "\\s+"), F.array(F.lit("the"), F.lit("of"), F.lit("in"), F.lit("and")))) / 4.0, 4).alias("overlap")).withColumn("verdict", F.when(F.col("overlap") >= 0.5, "correct").when(F.col("overlap") > 0, "partial").otherwise("wrong")),
    v.with_views("sections", "links") + "SELECT link_id, overlap, CASE WHEN overlap >= 0.5 THEN 'correct' WHEN overlap > 0 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT link_id, round(len(list_intersect(regexp_split_to_array(lower(heading), '\\s+'), ['the', 'of', 'in', 'and'])) / 4.0::DOUBLE, 4) AS overlap FROM links JOIN sections USING (doc_id, section_number))",
)
