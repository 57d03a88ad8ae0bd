"""Joins over the document hierarchy.

Equi keys are always part of a join, so ranges and contains conditions are checked
within a document; a side is broadcast only where it is one row or counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..registry import register

TERM_STEP = 40


def _terms(spark, d) -> DataFrame:
    """Definitions with a character position (they lie a fixed step apart)."""
    return v.definitions(spark, d).select("doc_id", "term", "pattern_engine", "confidence", (F.col("ordinal") * TERM_STEP + 1).alias("place"))


_TERMS = "terms AS (SELECT doc_id, term, pattern_engine, confidence, ordinal * 40 + 1 AS place FROM definitions)"

register(
    "inner_two_keys",
    lambda spark, d: v.clauses(spark, d).join(v.sections(spark, d), ["doc_id", "section_number"]).groupBy("template_family").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")),
    v.with_views("sections", "clauses") + "SELECT template_family, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM clauses JOIN sections USING (doc_id, section_number) GROUP BY template_family",
)
register(
    "sections_in_articles",
    lambda spark, d: v.sections(spark, d).join(v.articles(spark, d), ["doc_id", "article_num"]).groupBy("doc_id", "article_num", "title").agg(F.count(F.lit(1)).alias("n")),
    v.with_views("sections", "articles") + "SELECT doc_id, article_num, title, count(*) AS n FROM sections JOIN articles USING (doc_id, article_num) GROUP BY 1, 2, 3",
)
register(
    "left_levels",
    lambda spark, d: v.clauses(spark, d).join(v.sections(spark, d).select("doc_id", "section_number", "article_num", "heading"), ["doc_id", "section_number"], "left").join(v.articles(spark, d).select("doc_id", "article_num", "title"), ["doc_id", "article_num"], "left").select("clause_id", "section_number", "heading", "title"),
    v.with_views("sections", "articles", "clauses") + "SELECT clause_id, c.section_number, s.heading, a.title FROM clauses c LEFT JOIN sections s USING (doc_id, section_number) LEFT JOIN articles a USING (doc_id, article_num)",
)
register(
    "left_aggregated",
    lambda spark, d: v.articles(spark, d).join(v.sections(spark, d).groupBy("doc_id", "article_num").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), ["doc_id", "article_num"], "left").select("doc_id", "article_num", F.coalesce("n", F.lit(0)).alias("n"), "chars"),
    v.with_views("sections", "articles") + "SELECT a.doc_id, a.article_num, coalesce(n, 0) AS n, chars FROM articles a LEFT JOIN (SELECT doc_id, article_num, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM sections GROUP BY 1, 2) USING (doc_id, article_num)",
)
register(
    "semi_exists",
    lambda spark, d: v.sections(spark, d).join(v.clauses(spark, d).where("parse_confidence < 0.92 and label = 'F'").select("doc_id", "section_number"), ["doc_id", "section_number"], "left_semi").select("doc_id", "section_number"),
    v.with_views("sections", "clauses") + "SELECT doc_id, section_number FROM sections s WHERE EXISTS (SELECT 1 FROM clauses c WHERE c.doc_id = s.doc_id AND c.section_number = s.section_number AND parse_confidence < 0.92 AND label = 'F')",
)


def in_span(sections: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    terms = terms.withColumnRenamed("doc_id", "_doc")
    inside = (F.col("place") >= F.col("char_start")) & (F.col("place") < F.col("char_start") + F.col("chars"))
    out = sections.join(terms, (sections["doc_id"] == F.col("_doc")) & inside, how)
    return out if how == "left_semi" else out.drop("_doc")


register(
    "range_semi",
    lambda spark, d: in_span(v.placed_sections(spark, d), _terms(spark, d), "left_semi").select("doc_id", "section_number", "char_start"),
    v.with_views("sections", "placed", "definitions") + f", {_TERMS} SELECT doc_id, section_number, char_start FROM placed s WHERE EXISTS (SELECT 1 FROM terms t WHERE t.doc_id = s.doc_id AND place >= char_start AND place < char_start + chars)",
)
register(
    "range_left",
    lambda spark, d: in_span(v.placed_sections(spark, d), _terms(spark, d), "left").groupBy("doc_id", "section_number").agg(F.count("term").alias("terms"), F.min("term").alias("first")),
    v.with_views("sections", "placed", "definitions") + f", {_TERMS} SELECT s.doc_id, section_number, count(term) AS terms, min(term) AS first FROM placed s LEFT JOIN terms t ON t.doc_id = s.doc_id AND place >= char_start AND place < char_start + chars GROUP BY 1, 2",
)
register(
    "range_left_all",
    lambda spark, d: in_span(v.placed_sections(spark, d), _terms(spark, d), "left").groupBy("doc_id", "section_number").agg(F.count("term").alias("terms"), F.min("term").alias("first")),
    v.with_views("sections", "placed", "definitions") + f", {_TERMS} SELECT s.doc_id, section_number, count(term) AS terms, min(term) AS first FROM placed s LEFT JOIN terms t ON t.doc_id = s.doc_id AND place >= char_start AND place < char_start + chars GROUP BY 1, 2",
)
register(
    "range_inner",
    lambda spark, d: in_span(v.placed_sections(spark, d), _terms(spark, d), "inner").where(F.col("text").contains(F.col("term"))).groupBy("template_family", "pattern_engine").agg(F.count(F.lit(1)).alias("n")),
    v.with_views("sections", "placed", "definitions") + f", {_TERMS} SELECT template_family, pattern_engine, count(*) AS n FROM placed s JOIN terms t ON t.doc_id = s.doc_id AND place >= char_start AND place < char_start + chars AND contains(s.text, t.term) GROUP BY 1, 2",
)


def best_clause(spark, d):
    best = W.partitionBy("doc_id", "section_number").orderBy(F.desc("is_structural"), F.desc("depth"), F.col("clause_number"))
    top = v.clauses(spark, d).withColumn("_k", F.row_number().over(best)).where("_k = 1").select("doc_id", "section_number", "clause_id", "depth")
    return v.sections(spark, d).join(top, ["doc_id", "section_number"], "left").select("doc_id", "section_number", "clause_id", "depth")


register(
    "lateral_top1_all",
    best_clause,
    v.with_views("sections", "clauses") + "SELECT s.doc_id, s.section_number, c.clause_id, c.depth FROM sections s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, section_number ORDER BY is_structural DESC, depth DESC, clause_number) AS k FROM clauses) c ON c.doc_id = s.doc_id AND c.section_number = s.section_number AND k = 1",
)
register(
    "lateral_top1",
    best_clause,
    v.with_views("sections", "clauses") + "SELECT s.doc_id, s.section_number, c.clause_id, c.depth FROM sections s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, section_number ORDER BY is_structural DESC, depth DESC, clause_number) AS k FROM clauses) c ON c.doc_id = s.doc_id AND c.section_number = s.section_number AND k = 1",
)
register(
    "orphan_anti",
    lambda spark, d: v.clauses(spark, d).where("parent_id is not null").join(v.clauses(spark, d).select(F.col("doc_id").alias("p_doc"), F.col("clause_id").alias("p_id")), (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_id") == F.col("p_id")), "left_anti").select("clause_id", "parent_id", "depth"),
    v.with_views("clauses") + "SELECT clause_id, parent_id, depth FROM clauses c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clauses p WHERE p.doc_id = c.doc_id AND p.clause_id = c.parent_id)",
)
register(
    "anti_background",
    lambda spark, d: v.documents(spark, d).join(v.links(spark, d).where("status = 'active'").select("doc_id"), "doc_id", "left_anti").groupBy("template_family").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words")),
    v.with_views("docs", "links") + "SELECT template_family, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM links WHERE status = 'active') GROUP BY 1",
)


def squeezed(column: str):
    return F.regexp_replace(F.lower(column), "\\s+", "")


def phrase_containment(spark, d):
    """Benchmark items found in a text: an equi join on the item's first words, then the exact containment.

    Only (document, hash of n words) rows meet the items; the texts join the distinct
    candidates. Items of under six words are keyed by all of theirs, so texts give runs
    of the few lengths that items have.
    """
    words = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = lambda i, n: F.xxhash64(F.array_join(F.slice("words", i, n), " "))
    items = v.table(spark, d, "benchmark").select("item_id", words.alias("words")).where(F.size("words") > 0).withColumn("n", F.least(F.lit(6), F.size("words")))
    lengths = [r["n"] for r in items.select("n").distinct().collect()]  # six at most
    items = items.select("item_id", F.array_join("words", " ").alias("phrase"), F.xxhash64("n", hashed(F.lit(1), F.col("n"))).alias("key"))
    texts = v.table(spark, d, "documents").select("doc_id", words.alias("words"))
    slices = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.xxhash64(F.lit(n), hashed(i, n)))
    runs = [F.when(F.size("words") >= n, slices(n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    keys = texts.select("doc_id", F.explode(F.concat(*runs)).alias("key")) if runs else texts.select("doc_id", F.lit(0).cast("long").alias("key"))
    found = keys.join(items.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    bodies = texts.select("doc_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("body"))
    named = bodies.join(found, "doc_id").join(items.select("item_id", "phrase"), "item_id")
    return named.where(F.col("body").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select("doc_id", "item_id")


register(
    "phrase_containment",
    phrase_containment,
    """WITH i AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), ' ') AS phrase, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM benchmark),
b AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ' AS body FROM documents)
SELECT doc_id, item_id FROM b JOIN i ON contains(body, ' ' || phrase || ' ') AND n > 0""",
)


def heading_patterns(headings: DataFrame, patterns: DataFrame, most: int = 200) -> DataFrame:
    """(doc_id, section_number, pattern): patterns against headings, both ways round with white space squeezed.

    Patterns are a table of a few hundred words; up to ``most`` at a time become one
    expression, so no heading is paired with every pattern.
    """
    words = [r["pattern"] for r in patterns.select("pattern").distinct().orderBy("pattern").collect()]
    h = squeezed("heading")
    blocks = []
    for k in range(0, max(1, len(words)), most):
        hit = F.array_compact(F.array(*(F.when((h.contains(p.replace(" ", ""))) | ((F.length(h) >= 4) & F.lit(p.replace(" ", "")).contains(h)), F.lit(p)) for p in words[k : k + most])))
        blocks.append(headings.select("doc_id", "section_number", F.explode(hit.cast("array<string>")).alias("pattern")))
    return reduce(DataFrame.unionByName, blocks)


def _patterns(spark) -> DataFrame:
    return spark.createDataFrame([("the of",), ("und die",), ("de la",), ("is and",)], "pattern string")


register(
    "heading_patterns",
    lambda spark, d: heading_patterns(v.sections(spark, d), _patterns(spark)),
    v.with_views("sections")
    + """, p AS (SELECT unnest(['the of', 'und die', 'de la', 'is and']) AS pattern), h AS (SELECT doc_id, section_number, regexp_replace(lower(heading), '\\s+', '', 'g') AS h FROM sections)
SELECT doc_id, section_number, pattern FROM h JOIN p ON contains(h, replace(pattern, ' ', '')) OR (length(h) >= 4 AND contains(replace(pattern, ' ', ''), h))""",
)


def terms_in_text(spark, d):
    t = v.definitions(spark, d).select("doc_id", F.lower("term").alias("term")).distinct()
    s = v.sections(spark, d).select("doc_id", "section_number", F.lower("text").alias("low"))
    return s.join(t, "doc_id").where(F.col("low").contains(F.col("term"))).groupBy("doc_id", "section_number").agg(F.count(F.lit(1)).alias("terms"))


register(
    "terms_in_text_all",
    terms_in_text,
    v.with_views("sections", "definitions") + "SELECT s.doc_id, section_number, count(*) AS terms FROM sections s JOIN (SELECT DISTINCT doc_id, lower(term) AS term FROM definitions) t ON t.doc_id = s.doc_id AND contains(lower(s.text), t.term) GROUP BY 1, 2",
)
register(
    "terms_in_text",
    terms_in_text,
    v.with_views("sections", "definitions") + "SELECT s.doc_id, section_number, count(*) AS terms FROM sections s JOIN (SELECT DISTINCT doc_id, lower(term) AS term FROM definitions) t ON t.doc_id = s.doc_id AND contains(lower(s.text), t.term) GROUP BY 1, 2",
)


def alias_resolution(spark, d):
    """Links under old or canonical family ids: each id resolves to all its canonical families, and those to themselves and their descendants."""
    nation = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = nation.select("r_name", F.concat("r_name", F.lit("."), "n_name").alias("path"))
    families = tree.select(F.col("r_name").alias("canonical"), F.explode(F.array("path", "r_name")).alias("path")).distinct()
    # An old id stands for two regions; a canonical one for itself.
    regions = v.table(spark, d, "region").select("r_regionkey", "r_name")
    old = regions.select(F.concat(F.lit("old-"), (F.col("r_regionkey") % 2).cast("string")).alias("alias"), F.col("r_name").alias("canonical"))
    alias = old.unionByName(regions.select(F.col("r_name").alias("alias"), F.col("r_name").alias("canonical"))).join(families, "canonical")
    s = v.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).otherwise(F.concat("r_name", F.lit("."), "n_name")).alias("path"))
    return s.join(alias, "path").groupBy("alias", "canonical").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


register(
    "alias_resolution",
    alias_resolution,
    """WITH n AS (SELECT r_regionkey, r_name, n_nationkey, r_name || '.' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT DISTINCT r_name AS canonical, path FROM n UNION SELECT DISTINCT r_name, r_name FROM n),
a AS (SELECT 'old-' || (r_regionkey % 2) AS alias, r_name AS canonical FROM region UNION ALL SELECT r_name, r_name FROM region), s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN r_name ELSE path END AS path FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT alias, canonical, count(*) AS n, count(DISTINCT path) AS paths FROM s JOIN f USING (path) JOIN a USING (canonical) GROUP BY 1, 2""",
)


def cooccurrence(links: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of families that share a unit, from each unit's distinct families: few, so pairs stay few."""
    units = links.groupBy(*within).agg(F.array_sort(F.collect_set("family_id")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return units.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


for _name, _keys in (("cooccurrence_documents", ["doc_id"]), ("cooccurrence_sections", ["doc_id", "section_number"])):
    register(
        _name,
        lambda spark, d, keys=_keys: cooccurrence(v.links(spark, d), keys),
        v.with_views("links") + ", u AS (SELECT DISTINCT {0}, family_id FROM links) SELECT x.family_id AS a, y.family_id AS b, count(*) AS n FROM u x JOIN u y USING ({0}) WHERE x.family_id < y.family_id GROUP BY 1, 2".format(", ".join(_keys)),
    )
register(
    "top1_history",
    lambda spark, d: v.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at")),
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY user_id",
)
register(
    "correlated_in",
    lambda spark, d: v.links(spark, d).join(v.sections(spark, d).where(F.col("text").contains("the")).select("doc_id", "section_number"), ["doc_id", "section_number"], "left_semi").groupBy("family_id").agg(F.count(F.lit(1)).alias("n")),
    v.with_views("sections", "links") + "SELECT family_id, count(*) AS n FROM links l WHERE section_number IN (SELECT section_number FROM sections s WHERE s.doc_id = l.doc_id AND contains(s.text, 'the')) GROUP BY family_id",
)
