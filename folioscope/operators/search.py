"""Search and filter operators over the document hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as flt
from ..plans import views as v
from ..registry import register


def kwic(df: DataFrame, text: str, query: str, context: int = 30) -> DataFrame:
    """First hit of a literal query with its context; only rows that have one."""
    at = F.instr(F.lower(text), query.lower())
    df = df.withColumn("_at", at).where("_at > 0")
    n = len(query)
    return df.withColumns(
        {
            "hit_offset": (F.col("_at") - 1).cast("long"),
            "before": F.substring(text, F.greatest(F.lit(1), F.col("_at") - context), F.least(F.lit(context), F.col("_at") - 1)),
            "hit": F.substring(text, F.col("_at"), F.lit(n)),
            "after": F.substring(text, F.col("_at") + n, F.lit(context)),
        }
    ).drop("_at")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def after_key(score: str, keys: list[str], last: tuple) -> Column:
    """Rows after ``last`` in the order score descending, then keys ascending."""
    best, *rest = last
    out = F.col(score) < best
    same = F.col(score) == best
    for key, value in zip(keys, rest, strict=True):
        out = out | (same & (F.col(key) > value))
        same = same & (F.col(key) == value)
    return out


def section_search(spark, d):
    hit = flt.compiled("heading", flt.any_of("the", "der"))
    df = v.placed_sections(spark, d).where(hit & (F.col("article_num") <= 2))
    return page(df.select("doc_id", "section_number", "heading", "char_start"), [F.col("doc_id"), F.col("char_start")], 200)


register(
    "section_search",
    section_search,
    v.with_views("sections", "placed")
    + "SELECT doc_id, section_number, heading, char_start FROM placed WHERE (heading ILIKE '%the%' OR heading ILIKE '%der%') AND article_num <= 2 ORDER BY doc_id, char_start LIMIT 200",
)


def kwic_search(spark, d):
    return kwic(v.sections(spark, d), "text", "in the").select("doc_id", "section_number", "hit_offset", "before", "hit", "after")


register(
    "kwic_search",
    kwic_search,
    v.with_views("sections")
    + """SELECT doc_id, section_number, p - 1 AS hit_offset, substring(text, greatest(1, p - 30), least(30, p - 1)) AS before, substring(text, p, 6) AS hit, substring(text, p + 6, 30) AS after
FROM (SELECT *, instr(lower(text), 'in the') AS p FROM sections) WHERE p > 0""",
)


def in_document_search(spark, d):
    return kwic(v.sections(spark, d).where("doc_id = 7"), "text", "the", 12).select("section_number", "hit_offset", "before", "after")


register(
    "in_document_search",
    in_document_search,
    v.with_views("sections")
    + "SELECT section_number, p - 1 AS hit_offset, substring(text, greatest(1, p - 12), least(12, p - 1)) AS before, substring(text, p + 3, 12) AS after FROM (SELECT *, instr(lower(text), 'the') AS p FROM sections WHERE doc_id = 7) WHERE p > 0",
)

_NESTED = flt.all_of(flt.any_of("tion", "keit", "ment"), flt.none_of("100%", "_x"), {"operator": "or", "children": [{"value": "and", "negate": True}, flt.all_of({"value": "the"}, {"value": "of"})]})
_DEEP = {"value": "a"}
for _ in range(6):
    _DEEP = flt.all_of(_DEEP)
_FILTERS = {"nested": _NESTED, "wild": flt.any_of(*["a*"] * 11), "deep": _DEEP, "empty": flt.all_of({"operator": "or", "children": []}, {"value": ""}), "near": flt.near("a", "b", 3)}
register(
    "filter_nested",
    lambda spark, d: v.documents(spark, d).where(flt.compiled("text", _NESTED)).select("doc_id", "template_family"),
    v.with_views("docs")
    + "SELECT doc_id, template_family FROM docs WHERE (text ILIKE '%tion%' OR text ILIKE '%keit%' OR text ILIKE '%ment%') AND NOT (contains(lower(text), '100%') OR contains(lower(text), '_x')) AND (NOT contains(lower(text), 'and') OR (text ILIKE '%the%' AND text ILIKE '%of%'))",
)
register(
    "filter_negated_group",
    lambda spark, d: v.documents(spark, d).where(flt.compiled("text", {"operator": "and", "negate": True, "children": [{"value": "the"}, flt.any_of("zu", "le")]})).select("doc_id"),
    v.with_views("docs") + "SELECT doc_id FROM docs WHERE NOT (text ILIKE '%the%' AND (text ILIKE '%zu%' OR text ILIKE '%le%'))",
)
register(
    "filter_legacy_terms",
    lambda spark, d: v.sections(spark, d).where(flt.compiled("heading", flt.from_terms([("", "and"), ("or", "und"), ("and not", "the")]))).select("doc_id", "section_number"),
    v.with_views("sections") + "SELECT doc_id, section_number FROM sections WHERE (heading ILIKE '%and%' OR heading ILIKE '%und%') AND NOT heading ILIKE '%the%'",
)
register(
    "filter_regex",
    lambda spark, d: v.sections(spark, d).where(flt.compiled("heading", {"value": "^(the|and)[a-z]* ", "match": "regex"})).select("doc_id", "section_number", "heading"),
    v.with_views("sections") + "SELECT doc_id, section_number, heading FROM sections WHERE regexp_matches(heading, '(?i)^(the|and)[a-z]* ')",
)
register(
    "filter_glob",
    lambda spark, d: v.definitions(spark, d).where(flt.compiled("term", {"value": "th*ing", "match": "glob"})).groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    v.with_views("definitions") + "SELECT term, count(*) AS n FROM definitions WHERE regexp_matches(term, '(?i)^th.*ing$') GROUP BY term",
)
register(
    "proximity_filter",
    lambda spark, d: v.sections(spark, d).where(flt.compiled("text", flt.near("the", "of", 3))).select("doc_id", "section_number"),
    v.with_views("sections")
    + "SELECT doc_id, section_number FROM sections WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])(?:the[^A-Za-z0-9]+(?:[A-Za-z0-9]+[^A-Za-z0-9]+){0,2}of|of[^A-Za-z0-9]+(?:[A-Za-z0-9]+[^A-Za-z0-9]+){0,2}the)(?:[^A-Za-z0-9]|$)')",
)


def meta_filter(spark, d):
    keep = flt.number_filter("text_length", ">=", 2000) & flt.number_filter("word_count", "<", 900) & F.col("market_segment").ilike("E%")
    return v.documents(spark, d).where(keep & F.col("cohort")).select("doc_id", "market_segment", "text_length", "word_count")


register("meta_filter", meta_filter, v.with_views("docs") + "SELECT doc_id, market_segment, text_length, word_count FROM docs WHERE text_length >= 2000 AND word_count < 900 AND market_segment ILIKE 'E%' AND cohort")
register(
    "meta_year_filter",
    lambda spark, d: v.links(spark, d).where((F.year("created_at") == 1995) & flt.number_filter("confidence", ">", 0.3)).select("link_id", "family_id", F.year("created_at").cast("long").alias("vintage")),
    v.with_views("links") + "SELECT link_id, family_id, extract(year FROM created_at) AS vintage FROM links WHERE extract(year FROM created_at) = 1995 AND confidence > 0.3",
)
register(
    "article_filter",
    lambda spark, d: v.articles(spark, d).where(flt.article_filter("Article iv") | flt.article_filter("the", negate=False)).select("doc_id", "article_num", "title"),
    v.with_views("sections", "articles") + "SELECT doc_id, article_num, title FROM articles WHERE title ILIKE '%Article iv%' OR concept ILIKE '%Article iv%' OR article_num = 4 OR title ILIKE '%the%' OR concept ILIKE '%the%'",
)


def multi_field(spark, d):
    """Heading, article, clause and defined term at once: one scan of sections and two semi joins."""
    s = v.placed_sections(spark, d).where(flt.compiled("heading", flt.any_of("an", "en")))
    s = s.join(v.articles(spark, d).where(flt.article_filter("e")), ["doc_id", "article_num"], "left_semi")
    c = v.clauses(spark, d).where("is_structural and quantity > 10").select("doc_id", "section_number")
    s = s.join(c, ["doc_id", "section_number"], "left_semi")
    t = v.definitions(spark, d).select(F.col("doc_id"), (F.col("ordinal") * 40 + 1).alias("at"))
    s = s.join(t, (s["doc_id"] == t["doc_id"]) & (t["at"] >= s["char_start"]) & (t["at"] < s["char_start"] + s["chars"]), "left_semi")
    return s.select("doc_id", "section_number", "heading")


register(
    "multi_field",
    multi_field,
    v.with_views("sections", "placed", "articles", "clauses", "definitions")
    + """SELECT doc_id, section_number, heading FROM placed s WHERE (heading ILIKE '%an%' OR heading ILIKE '%en%')
AND EXISTS (SELECT 1 FROM articles a WHERE a.doc_id = s.doc_id AND a.article_num = s.article_num AND (a.title ILIKE '%e%' OR a.concept ILIKE '%e%'))
AND EXISTS (SELECT 1 FROM clauses c WHERE c.doc_id = s.doc_id AND c.section_number = s.section_number AND c.is_structural AND c.quantity > 10)
AND EXISTS (SELECT 1 FROM definitions t WHERE t.doc_id = s.doc_id AND t.ordinal * 40 + 1 >= s.char_start AND t.ordinal * 40 + 1 < s.char_start + s.chars)""",
)


def traffic_light(spark, d):
    """How many documents each node of a filter matches: leaves are columns, nodes are booleans over them, one pass of counts."""
    leaves, verdicts = flt.explained("text", _NESTED)
    df = v.table(spark, d, "documents").select(*(c.alias(k) for k, c in leaves.items()))
    counts = [F.struct(F.lit(p).alias("path"), F.count_if(c).alias("matched"), F.count_if(~c).alias("failed")).alias(f"n{i}") for i, (p, c) in enumerate(verdicts.items())]
    return df.agg(*counts).select(F.explode(F.array(*(f"n{i}" for i in range(len(counts))))).alias("e")).select("e.*")  # one row


def why_not(spark, d):
    """Of each document that a filter misses: the parts of its top group that fail, and those that would do if muted alone."""
    leaves, verdicts = flt.explained("text", _NESTED)
    df = v.table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in leaves.items()))
    tops = {p: c for p, c in verdicts.items() if p.count(".") == 1}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(p)) for p, c in tops.items())))
    df = df.where(~verdicts["0"]).select("doc_id", failed.alias("f"))
    return df.select("doc_id", F.array_join("f", ",").alias("failed"), F.when(F.size("f") == 1, F.get("f", F.lit(0))).alias("mute"))


register(
    "traffic_light",
    traffic_light,
    v.with_views("docs")
    + """, t AS (SELECT contains(lower(text), 'tion') AS a, contains(lower(text), 'keit') AS b, contains(lower(text), 'ment') AS c, contains(lower(text), '100%') AS p, contains(lower(text), '_x') AS q,
  contains(lower(text), 'and') AS x, contains(lower(text), 'the') AS y, contains(lower(text), 'of') AS z FROM docs),
n AS (SELECT unnest(['0', '0.0', '0.0.0', '0.0.1', '0.0.2', '0.1', '0.1.0', '0.1.1', '0.2', '0.2.0', '0.2.1', '0.2.1.0', '0.2.1.1']) AS path,
  unnest([(a OR b OR c) AND NOT (p OR q) AND (NOT x OR (y AND z)), a OR b OR c, a, b, c, NOT (p OR q), p, q, NOT x OR (y AND z), NOT x, y AND z, y, z]) AS m FROM t)
SELECT path, count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS failed FROM n GROUP BY path""",
)
register(
    "why_not",
    why_not,
    """WITH t AS (SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'keit') OR contains(lower(text), 'ment') AS a, NOT (contains(lower(text), '100%') OR contains(lower(text), '_x')) AS b, NOT contains(lower(text), 'and') OR (contains(lower(text), 'the') AND contains(lower(text), 'of')) AS c FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN NOT a THEN '0.0' END, CASE WHEN NOT b THEN '0.1' END, CASE WHEN NOT c THEN '0.2' END) AS failed, CASE WHEN a::INT + b::INT + c::INT = 2 THEN CASE WHEN NOT a THEN '0.0' WHEN NOT b THEN '0.1' ELSE '0.2' END END AS mute FROM t WHERE NOT (a AND b AND c)""",
)
register(
    "filter_costs",
    lambda spark, d: spark.createDataFrame([(n, flt.cost(f), ",".join(flt.problems(f))) for n, f in _FILTERS.items()], "name string, cost int, problems string"),
    "SELECT unnest(['nested', 'wild', 'deep', 'empty', 'near']) AS name, unnest([15, 34, 7, 3, 7]) AS cost, unnest(['', 'too many wildcards', 'nested too deeply', 'empty group,empty value', '']) AS problems",
)
register(
    "legacy_flat_terms",
    lambda spark, d: v.sections(spark, d).where(flt.left_to_right("heading", [("", "the"), ("or", "and"), ("and not", "of")])).select("doc_id", "section_number"),
    v.with_views("sections") + "SELECT doc_id, section_number FROM sections WHERE (heading ILIKE '%the%' OR heading ILIKE '%and%') AND NOT heading ILIKE '%of%'",
)
register(
    "cohort_predicate",
    lambda spark, d: v.sections(spark, d).join(v.documents(spark, d).where("cohort and word_count >= 100").select("doc_id"), "doc_id", "left_semi").groupBy("template_family").agg(F.count(F.lit(1)).alias("n_sections")),
    v.with_views("docs", "sections") + "SELECT template_family, count(*) AS n_sections FROM sections WHERE doc_id IN (SELECT doc_id FROM docs WHERE cohort AND word_count >= 100) GROUP BY template_family",
)


def ranges_and_tuples(spark, d):
    wanted = v.links(spark, d).where("status = 'active'").select("doc_id", "section_number").distinct()
    s = v.sections(spark, d).where(F.col("chars").between(50, 400) & F.col("template_family").isin("src1", "src2", "src3"))
    return s.join(wanted, ["doc_id", "section_number"], "left_semi").select("doc_id", "section_number", "chars")


register(
    "ranges_and_tuples",
    ranges_and_tuples,
    v.with_views("sections", "links") + "SELECT doc_id, section_number, chars FROM sections WHERE chars BETWEEN 50 AND 400 AND template_family IN ('src1', 'src2', 'src3') AND (doc_id, section_number) IN (SELECT doc_id, section_number FROM links WHERE status = 'active')",
)
register(
    "keyset_page",
    lambda spark, d: page(v.links(spark, d).where(after_key("confidence", ["doc_id", "link_id"], (0.5, 100, 1))).select("link_id", "doc_id", "confidence"), [F.desc("confidence"), F.col("doc_id"), F.col("link_id")], 50),
    v.with_views("links") + "SELECT link_id, doc_id, confidence FROM links WHERE confidence < 0.5 OR (confidence = 0.5 AND (doc_id > 100 OR (doc_id = 100 AND link_id > 1))) ORDER BY confidence DESC, doc_id, link_id LIMIT 50",
)
SORTABLE = {"text_length": "text_length", "words": "word_count", "document": "doc_id"}


def sorted_page(df: DataFrame, by: str, down: bool, limit: int, offset: int) -> DataFrame:
    """A page in one of the orders that are allowed; ties by document."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by!r}")
    column = F.col(SORTABLE[by])
    return page(df, [column.desc() if down else column.asc(), F.col("doc_id")], limit, offset)


register(
    "offset_page",
    lambda spark, d: sorted_page(v.documents(spark, d).select("doc_id", "text_length"), "text_length", True, 25, 50),
    v.with_views("docs") + "SELECT doc_id, text_length FROM docs ORDER BY text_length DESC, doc_id LIMIT 25 OFFSET 50",
)
register(
    "scope_expression",
    lambda spark, d: v.table(spark, d, "customer").groupBy(F.coalesce(F.nullif(F.trim(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))), F.lit("")), F.lit("unscoped")).alias("scope")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), 'unscoped') AS scope, count(*) AS n FROM customer GROUP BY 1",
)
register(
    "descendant_prefix",
    lambda spark, d: v.clauses(spark, d).where((F.col("clause_id") == "7") | F.col("clause_id").startswith("7.")).select("clause_id", "depth"),
    v.with_views("clauses") + "SELECT clause_id, depth FROM clauses WHERE clause_id = '7' OR clause_id LIKE '7.%'",
)
register(
    "autocomplete",
    lambda spark, d: page(v.definitions(spark, d).where(F.col("term").ilike("an%")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("term")], 10),
    v.with_views("definitions") + "SELECT term, count(*) AS n FROM definitions WHERE term ILIKE 'an%' GROUP BY term ORDER BY n DESC, term LIMIT 10",
)
register(
    "case_projection",
    lambda spark, d: v.documents(spark, d).select("doc_id", F.concat(F.lit("words "), F.col("word_count"), F.lit(", quality "), F.col("quality")).alias("detail"), F.when(F.col("word_count") < 50, "short").when(F.col("word_count") < 500, "medium").otherwise("long").alias("size")),
    v.with_views("docs") + "SELECT doc_id, 'words ' || word_count || ', quality ' || quality AS detail, CASE WHEN word_count < 50 THEN 'short' WHEN word_count < 500 THEN 'medium' ELSE 'long' END AS size FROM docs",
)


def unified_query(spark, d):
    """One predicate over articles, sections and clauses: hits of each level in documents that have all three, and those documents."""
    a = v.articles(spark, d).where(flt.article_filter("the")).select("doc_id", F.lit("article").alias("level"))
    s = v.sections(spark, d).where(flt.compiled("heading", flt.any_of("the"))).select("doc_id", F.lit("section").alias("level"))
    c = v.clauses(spark, d).where("label = 'O' and depth >= 2").select("doc_id", F.lit("clause").alias("level"))
    per = reduce(DataFrame.unionByName, (a, s, c)).groupBy("doc_id").agg(*(F.count_if(F.col("level") == x).alias(x) for x in ("article", "section", "clause")))
    per = per.where("article > 0 and section > 0 and clause > 0")
    x = per.agg(F.count(F.lit(1)).alias("docs"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("article", "section", "clause")))
    return x.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(k).alias("hits"), "docs") for k in ("article", "section", "clause")))).alias("e")).select("e.*")  # one row


register(
    "unified_query",
    unified_query,
    v.with_views("sections", "articles", "clauses")
    + """, h AS (SELECT doc_id, 'article' AS level FROM articles WHERE title ILIKE '%the%' OR concept ILIKE '%the%' UNION ALL SELECT doc_id, 'section' FROM sections WHERE heading ILIKE '%the%' UNION ALL SELECT doc_id, 'clause' FROM clauses WHERE label = 'O' AND depth >= 2),
a AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT level) = 3) SELECT l.level, count(h.doc_id) AS hits, (SELECT count(*) FROM a) AS docs FROM (SELECT unnest(['article', 'section', 'clause']) AS level) l LEFT JOIN (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM a)) h USING (level) GROUP BY 1""",
)
def clause_search(spark, d):
    """Clauses within a range of depths, in sections whose heading matches, with a keyword in the heading or the label."""
    heads = v.sections(spark, d).where(F.col("heading").rlike("(?i)^(the|in)")).select("doc_id", "section_number", "heading")
    c = v.clauses(spark, d).where(F.col("depth").between(2, 3)).join(heads, ["doc_id", "section_number"])
    return c.where(flt.compiled("heading", flt.any_of("of")) | flt.compiled("label", flt.any_of("o"))).select("clause_id", "section_number", "depth")


register(
    "clause_search",
    clause_search,
    v.with_views("sections", "clauses") + "SELECT clause_id, section_number, depth FROM clauses JOIN sections USING (doc_id, section_number) WHERE depth BETWEEN 2 AND 3 AND regexp_matches(heading, '(?i)^(the|in)') AND (heading ILIKE '%of%' OR label ILIKE '%o%')",
)


def integrity(spark, d):
    """Duplicate keys, orphans and blank keys of each level, as counts."""
    s, c, l = v.sections(spark, d), v.clauses(spark, d), v.links(spark, d)
    repeated = lambda df, keys, name: df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    orphans = lambda df, name: df.join(v.table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    blank = s.agg(F.count_if(F.coalesce(F.trim("heading"), F.lit("")) == "").alias("n")).select(F.lit("blank heading").alias("problem"), "n")
    return reduce(DataFrame.unionByName, (repeated(s, ["doc_id", "section_number"], "repeated section"), repeated(l, ["doc_id", "section_number", "family_id"], "repeated link"), orphans(c, "orphan clause"), orphans(l, "orphan link"), blank))


register(
    "integrity_checks",
    integrity,
    v.with_views("sections", "clauses", "links")
    + """SELECT 'repeated section' AS problem, count(*) AS n FROM (SELECT 1 FROM sections GROUP BY doc_id, section_number HAVING count(*) > 1)
UNION ALL SELECT 'repeated link', count(*) FROM (SELECT 1 FROM links GROUP BY doc_id, section_number, family_id HAVING count(*) > 1)
UNION ALL SELECT 'orphan clause', count(*) FROM clauses WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orphan link', count(*) FROM links WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'blank heading', count(*) FROM sections WHERE coalesce(trim(heading), '') = ''""",
)
