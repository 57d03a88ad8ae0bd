"""The catalogue of 38 suspicious conditions of documents, with counts, filter and page.

Sections, clauses and definitions are each reduced to one row a document; these join
the documents by doc_id once, and one projection sets all flags. Conditions that are
alternatives stay together under ``cohort_only``.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..registry import register

# Tiers, their categories and the default limits.
TIERS = {
    "structural": ["missing_sections", "low_section_count", "excessive_section_count", "section_fallback_used", "section_numbering_gap", "empty_section_headings"],
    "clauses": ["zero_clauses", "low_clause_density", "low_avg_clause_confidence", "orphan_deep_clause", "inconsistent_sibling_depth", "deep_nesting_outlier", "low_structural_ratio", "rootless_deep_clause", "clause_root_label_repeat_explosion", "clause_dup_id_burst", "clause_depth_reset_after_deep"],
    "definitions": ["low_definitions", "zero_definitions", "high_definition_count", "duplicate_definitions", "single_engine_definitions", "definition_truncated_at_cap", "definition_signature_leak", "definition_malformed_term"],
    "metadata": ["extreme_facility", "missing_borrower", "missing_facility_size", "missing_closing_date", "unknown_doc_type"],
    "document": ["extreme_word_count", "short_text", "extreme_text_ratio", "very_short_document"],
    "template": ["orphan_template", "non_credit_agreement", "uncertain_market_segment", "non_cohort_large_doc"],
}
LIMITS = {
    "words": 5000, "many_words": 10000, "some_words": 1000, "few_words": 500, "few_sections": 4, "density": 2.0,
    "few_definitions": 20, "many_definitions": 500, "facility_low": 1.0, "facility_high": 10000.0, "chars": 10000, "chars_per_word": 15.0,
    "clauses": 10, "confidence": 0.4, "deep": 3, "very_deep": 4, "total_clauses": 10, "structural_pct": 50.0,
    "one_engine": 10, "cap": 1999, "capped": 5, "malformed": 20, "term_chars": 80, "root_repeats": 200,
    "dup_structural": 200, "dup_ratio": 0.9, "reset_from": 4, "resets": 2,
}
CAPPED_ENGINES = ("quoted", "smart_quote", "parenthetical")
# What a term that leaked from a signature page holds, and how one that is a party starts.
_FIXED = json.loads((Path(__file__).parent / "term_patterns.json").read_text())
SIGNATURE, PARTY_START = _FIXED["signature"], _FIXED["party_start"]

COLUMNS = ("doc_type", "market_segment", "word_count", "section_count", "definition_count", "clause_count", "facility_size_mm")


def clause_facts(clauses: DataFrame, k: dict) -> list[DataFrame]:
    """One row a document each: totals, missing parents, uneven siblings, repeated root labels, depth resets."""
    c = clauses.withColumns({"level": F.size(F.split("clause_id", "\\.")), "inner": F.lower(F.regexp_extract("label", r"\(([A-Za-z0-9]+)\)", 1)), "rootless": F.coalesce("parent_id", F.lit("")) == ""})
    yes = F.col("is_structural")
    totals = c.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_clauses"),
        F.avg("parse_confidence").alias("avg_confidence"),
        F.count_if("is_structural").alias("structural"),
        F.count_if(yes & (F.col("level") > k["very_deep"])).alias("deep_clauses"),
        F.max(F.when(yes & (F.col("level") > k["very_deep"]), F.col("level"))).alias("max_level"),
        F.count_if(yes & (F.col("level") > 1) & F.col("rootless")).alias("rootless"),
        F.count_if(yes & F.col("clause_id").contains("_dup")).alias("dup_ids"),
    )
    own = c.where(yes & ~F.col("rootless"))
    parents = c.select(F.col("doc_id").alias("_d"), F.col("section_number").alias("_s"), F.col("clause_id").alias("_c"))
    orphans = own.where(F.col("level") >= k["deep"]).join(parents, (F.col("doc_id") == F.col("_d")) & F.col("section_number").eqNullSafe(F.col("_s")) & (F.col("parent_id") == F.col("_c")), "left_anti")
    orphans = orphans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphans"))
    uneven = own.groupBy("doc_id", "section_number", "parent_id").agg(F.count(F.lit(1)).alias("m"), F.min("level").alias("a"), F.max("level").alias("b")).where("a <> b")
    uneven = uneven.groupBy("doc_id").agg(F.count(F.lit(1)).alias("uneven_groups"), F.sum("m").alias("uneven_clauses"))
    roots = c.where(yes & (F.col("level") == 1) & (F.col("inner") != "")).groupBy("doc_id", "section_number", "inner").agg(F.count(F.lit(1)).alias("m"))
    roots = roots.groupBy("doc_id").agg(F.max("m").alias("root_repeats"))
    before = F.lag("level").over(W.partitionBy("doc_id", "section_number").orderBy("span_start"))
    resets = c.where(yes).withColumn("before", before).where((F.col("before") >= k["reset_from"]) & (F.col("level") == 1) & F.col("inner").rlike("^[m-z]$"))
    resets = resets.groupBy("doc_id", "section_number").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= k["resets"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("reset_sections"), F.sum("m").alias("resets"))
    return [totals, orphans, uneven, roots, resets]


def definition_facts(definitions: DataFrame, k: dict) -> DataFrame:
    """One row a document: repeated terms, the one engine, capped, leaked and malformed terms."""
    term = F.trim(F.coalesce("term", F.lit("")))
    capped = (F.col("definition_chars") >= k["cap"]) & F.col("pattern_engine").isin(*CAPPED_ENGINES) & (F.length(term) >= 3)
    leaked = F.lower(term).rlike(SIGNATURE)
    bad = F.coalesce("term", F.lit("")).contains("\n") | (F.length(term) > k["term_chars"]) | F.lower(term).rlike(PARTY_START)
    per_term = definitions.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("m"), F.min("pattern_engine").alias("lo"), F.max("pattern_engine").alias("hi"), F.count_if(capped).alias("capped"), F.count_if(leaked).alias("leaked"), F.count_if(bad).alias("malformed"))
    return per_term.groupBy("doc_id").agg(F.count_if(F.col("m") > 1).alias("dup_terms"), F.sum("m").alias("n_definitions"), F.min("lo").alias("engine"), F.max("hi").alias("engine_hi"), *(F.sum(x).alias(x) for x in ("capped", "leaked", "malformed")))


def section_facts(sections: DataFrame) -> list[DataFrame]:
    """One row a document each: gaps between whole section numbers, and blank headings."""
    whole = sections.where(~F.col("section_number").contains(".")).select("doc_id", F.try_to_number("section_number", F.lit("999999999999")).cast("double").alias("n"))
    gaps = whole.where("n is not null").withColumn("before", F.lag("n").over(W.partitionBy("doc_id").orderBy("n"))).where("n - before > 1 and n > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("gaps"))
    blank = sections.where(F.trim(F.coalesce("heading", F.lit(""))) == "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("blank_headings"))
    return [gaps, blank]


def fences(docs: DataFrame, column: str) -> DataFrame:
    """One row (lo, hi): a half and one quartile ranges out; null where there are under four values or no range."""
    q = docs.agg(F.count(column).alias("m"), F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    able = (F.col("m") >= 4) & (F.col("q3") > F.col("q1"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select(F.when(able, F.col("q1") - reach).alias(f"{column}_lo"), F.when(able, F.col("q3") + reach).alias(f"{column}_hi"))


def _flags(k: dict) -> list[Column]:
    c = F.col
    say = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    words, sections = c("word_count"), c("section_count")
    big, bigger = words > k["words"], words > k["many_words"]
    density, ratio = F.round(F.try_divide(c("clause_count").cast("double"), sections), 1), F.round(F.try_divide(c("text_length").cast("double"), words), 1)
    pct = F.round(F.try_divide(100.0 * c("structural"), c("n_clauses")), 1)
    dup = F.try_divide(c("dup_ids").cast("double"), c("structural"))
    kind = c("doc_type")
    why = F.when(words < k["few_words"], say("short: ", words, " words")).when(~kind.isin("credit_agreement", "other", ""), say("type ", kind)).when(big, say("unread headings in ", words, " words")).otherwise("no sections")
    whole = lambda x: F.round(x, 0).cast("int")
    rules = [
        ("missing_sections", "high", sections == 0, why),
        ("low_section_count", "medium", sections.between(1, k["few_sections"]) & big, say(sections, " sections in ", words, " words")),
        ("section_fallback_used", "low", c("section_fallback_used") & (sections > 0), say(sections, " sections by fallback")),
        ("zero_clauses", "medium", (c("clause_count") == 0) & (sections > 0), say("sections without clauses")),
        ("low_clause_density", "medium", (c("clause_count") > 0) & (sections > 0) & (F.try_divide(c("clause_count").cast("double"), sections) < k["density"]), say(density, " clauses a section")),
        ("low_definitions", "medium", (c("definition_count") < k["few_definitions"]) & bigger, say("few definitions in a long document")),
        ("zero_definitions", "high", (c("definition_count") == 0) & big, say("no definition in ", words, " words")),
        ("high_definition_count", "medium", c("definition_count") > k["many_definitions"], say(c("definition_count"), " definitions")),
        ("extreme_facility", "low", (c("facility_size_mm") > k["facility_high"]) | (c("facility_size_mm") < k["facility_low"]), say("facility size out of range")),
        ("missing_borrower", "medium", F.trim(F.coalesce("borrower", F.lit(""))) == "", say("no borrower")),
        ("missing_facility_size", "medium", c("facility_size_mm").isNull() & big, say("no facility size in ", words, " words")),
        ("missing_closing_date", "low", c("closing_date").isNull() & big, say("no closing date")),
        ("unknown_doc_type", "high", (c("doc_type_confidence") == "low") | kind.isin("", "other") | kind.isNull(), say("unsure type: ", F.coalesce(kind, F.lit("NULL")))),
        ("short_text", "medium", (c("text_length") < k["chars"]) & (c("text_length") > 0), say(c("text_length"), " characters")),
        ("extreme_text_ratio", "medium", (words > 0) & (F.try_divide(c("text_length").cast("double"), words) > k["chars_per_word"]), say(ratio, " characters a word")),
        ("very_short_document", "high", (words < k["words"]) & (words > 0), say(words, " words")),
        ("orphan_template", "low", F.trim(F.coalesce("template_family", F.lit(""))) == "", say("no template family")),
        ("non_credit_agreement", "medium", ~kind.isin("credit_agreement", "") & (words > k["some_words"]), say("type ", kind, ", confidence ", F.coalesce("doc_type_confidence", F.lit("none")))),
        ("uncertain_market_segment", "low", (c("segment_confidence") == "low") & (c("market_segment") == "uncertain"), say("segment uncertain")),
        ("non_cohort_large_doc", "low", ~c("cohort_included") & bigger, say(words, " words outside the cohort")),
        ("low_avg_clause_confidence", "high", (c("clause_count") > k["clauses"]) & (c("avg_confidence") < k["confidence"]), say("confidence ", F.round("avg_confidence", 3), " over ", c("n_clauses"), " clauses")),
        ("orphan_deep_clause", "high", c("orphans") > 0, say(c("orphans"), " deep clauses without their parent")),
        ("inconsistent_sibling_depth", "high", c("uneven_groups") > 0, say(c("uneven_groups"), " groups, ", c("uneven_clauses"), " clauses")),
        ("deep_nesting_outlier", "low", c("deep_clauses") > 0, say("level ", c("max_level"), ", ", c("deep_clauses"), " deep clauses")),
        ("low_structural_ratio", "medium", (c("n_clauses") >= k["total_clauses"]) & (pct < k["structural_pct"]), say(pct, "% structural, ", c("structural"), " of ", c("n_clauses"))),
        ("rootless_deep_clause", "medium", c("rootless") > 0, say(c("rootless"), " deep clauses without a parent link")),
        ("clause_root_label_repeat_explosion", "high", c("root_repeats") >= k["root_repeats"], say("root label repeated ", c("root_repeats"), " times")),
        ("clause_dup_id_burst", "high", (c("structural") >= k["dup_structural"]) & (dup > k["dup_ratio"]), say(F.round(100.0 * dup, 1), "% duplicate ids")),
        ("clause_depth_reset_after_deep", "high", c("reset_sections") > 0, say(c("reset_sections"), " sections, ", c("resets"), " resets")),
        ("duplicate_definitions", "low", c("dup_terms") > 0, say(c("dup_terms"), " terms defined again")),
        ("single_engine_definitions", "low", (c("engine") == c("engine_hi")) & (c("n_definitions") >= k["one_engine"]), say(c("n_definitions"), " definitions by ", c("engine"))),
        ("definition_truncated_at_cap", "high", c("capped") >= k["capped"], say(c("capped"), " definitions at the cap")),
        ("definition_signature_leak", "high", c("leaked") > 0, say(c("leaked"), " terms with signature marks")),
        ("definition_malformed_term", "medium", c("malformed") >= k["malformed"], say(c("malformed"), " malformed terms")),
        ("section_numbering_gap", "medium", c("gaps") > 0, say(c("gaps"), " numbering gaps")),
        ("empty_section_headings", "medium", c("blank_headings") > 0, say(c("blank_headings"), " blank headings")),
        ("extreme_word_count", "low", (words < c("word_count_lo")) | (words > c("word_count_hi")), say(words, " words, fences ", whole(c("word_count_lo")), " to ", whole(c("word_count_hi")))),
        ("excessive_section_count", "low", sections > c("section_count_hi"), say(sections, " sections, fence ", whole(c("section_count_hi")))),
    ]
    return [F.when(test, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"), detail.alias("detail"))) for name, severity, test, detail in rules]


def edge_cases(docs: DataFrame, sections: DataFrame, clauses: DataFrame, definitions: DataFrame, limits: dict | None = None, cohort_only: bool = False) -> DataFrame:
    """(doc_id, borrower, category, severity, detail and the document's measures), a row for each condition that a document meets."""
    k = LIMITS | (limits or {})
    docs = docs.where("cohort_included") if cohort_only else docs
    wide = docs
    for facts in (*clause_facts(clauses, k), definition_facts(definitions, k), *section_facts(sections)):
        wide = wide.join(facts, "doc_id", "left")
    for column in ("word_count", "section_count"):
        wide = wide.join(F.broadcast(fences(docs, column)), F.lit(True))  # one row
    found = wide.select("doc_id", "borrower", *COLUMNS, F.explode(F.array_compact(F.array(*_flags(k)))).alias("x"))
    return found.select("doc_id", "borrower", "x.*", *COLUMNS)


def counts(cases: DataFrame) -> DataFrame:
    """(category, tier, n) of all categories that occur."""
    tier = F.create_map(*(F.lit(x) for t, names in TIERS.items() for n in names for x in (n, t)))
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", tier[F.col("category")])


def page(cases: DataFrame, category: str = "all", number: int = 0, size: int = 50) -> DataFrame:
    if category != "all":
        cases = cases.where(F.col("category") == category)
    return cases.orderBy("category", "doc_id").offset(number * size).limit(size)


# Stand-ins over the provided tables; their documents are short, so the queries below lower the limits.
QUERY_LIMITS = LIMITS | {
    "words": 300, "many_words": 600, "some_words": 100, "few_words": 30, "few_definitions": 5, "many_definitions": 60, "chars": 500, "chars_per_word": 6.0,
    "clauses": 4, "total_clauses": 5, "one_engine": 3, "malformed": 1, "term_chars": 9, "capped": 2, "root_repeats": 2, "dup_structural": 2, "dup_ratio": 0.2, "resets": 1,
}
PATHS = ["a", "a.i", "a.i.A", "a.i.A.1", "a.i.A.1.x", "n", "n_dup1"]
PARENTS = ["", "a", "a.i", "a.i.A", "a.i.A.1", "", ""]
LABELS = ["(a)", "(i)", "(A)", "(1)", "(x)", "(n)", "(n)"]


def documents(spark, d) -> DataFrame:
    labels = v.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    orders = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_totalprice", "o_orderdate")
    names = v.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    n_clauses = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    df = v.table(spark, d, "documents").join(labels, "doc_id", "left").join(orders.join(names, "o_custkey", "left"), "doc_id", "left").join(n_clauses, "doc_id", "left")
    return df.select(
        "doc_id",
        F.when(F.col("o_custkey") % 11 != 0, F.col("c_name")).alias("borrower"),
        F.when(F.col("lang") == "en", "credit_agreement").when(F.col("lang") == "de", "other").otherwise(F.col("lang")).alias("doc_type"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("doc_type_confidence"),
        F.when(F.col("toxic") == 1, "uncertain").otherwise("leveraged").alias("market_segment"),
        F.when(F.col("toxic") == 1, "low").otherwise("high").alias("segment_confidence"),
        F.size(F.split(F.trim("text"), "\\s+")).cast("long").alias("word_count"),
        F.col("n_chars").alias("text_length"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("section_count"),
        F.regexp_count("text", F.lit("[A-Z][a-z]{3,}")).cast("long").alias("definition_count"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("clause_count"),
        (F.col("o_totalprice") / 25.0).alias("facility_size_mm"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate")).alias("closing_date"),
        F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("template_family"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("cohort_included"),
        (F.col("doc_id") % 4 == 0).alias("section_fallback_used"),
    )


def sections(spark, d) -> DataFrame:
    n = F.col("section_number")
    return v.sections(spark, d).select("doc_id", F.when(n % 5 == 4, F.concat(n, F.lit(".1"))).otherwise(n.cast("string")).alias("section_number"), "heading")


def clauses(spark, d) -> DataFrame:
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("l_linenumber"))
    parent = F.when(F.col("l_partkey") % 5 == 0, "").when((F.col("l_partkey") % 7 == 0) & (F.col("l_linenumber") > 1), "zz").otherwise(at(PARENTS))
    return v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).cast("string").alias("section_number"), at(PATHS).alias("clause_id"), parent.alias("parent_id"), at(LABELS).alias("label"),
        (F.col("l_linenumber") * 100).alias("span_start"), (F.col("l_tax") * 10).alias("parse_confidence"), (F.col("l_returnflag") != "R").alias("is_structural"),
    )


def definitions(spark, d) -> DataFrame:
    engine = F.element_at(F.array(*map(F.lit, (*CAPPED_ENGINES, "colon"))), (F.length("term") % 4 + 1).cast("int"))
    return v.definitions(spark, d).select("doc_id", "term", engine.alias("pattern_engine"), (F.length("term") * 250).alias("definition_chars"))


def over_tables(spark, d, **options) -> DataFrame:
    return edge_cases(documents(spark, d), sections(spark, d), clauses(spark, d), definitions(spark, d), QUERY_LIMITS, **options)


def _sql() -> str:
    k = QUERY_LIMITS
    rules = {
        "missing_sections": ("high", "section_count = 0", f"CASE WHEN word_count < {k['few_words']} THEN 'short: ' || word_count || ' words' WHEN doc_type NOT IN ('credit_agreement', 'other', '') THEN 'type ' || doc_type WHEN word_count > {k['words']} THEN 'unread headings in ' || word_count || ' words' ELSE 'no sections' END"),
        "low_section_count": ("medium", f"section_count BETWEEN 1 AND {k['few_sections']} AND word_count > {k['words']}", "section_count || ' sections in ' || word_count || ' words'"),
        "section_fallback_used": ("low", "section_fallback_used AND section_count > 0", "section_count || ' sections by fallback'"),
        "zero_clauses": ("medium", "clause_count = 0 AND section_count > 0", "'sections without clauses'"),
        "low_clause_density": ("medium", f"clause_count > 0 AND section_count > 0 AND clause_count::DOUBLE / section_count < {k['density']}", "round(clause_count::DOUBLE / section_count, 1) || ' clauses a section'"),
        "low_definitions": ("medium", f"definition_count < {k['few_definitions']} AND word_count > {k['many_words']}", "'few definitions in a long document'"),
        "zero_definitions": ("high", f"definition_count = 0 AND word_count > {k['words']}", "'no definition in ' || word_count || ' words'"),
        "high_definition_count": ("medium", f"definition_count > {k['many_definitions']}", "definition_count || ' definitions'"),
        "extreme_facility": ("low", f"facility_size_mm > {k['facility_high']} OR facility_size_mm < {k['facility_low']}", "'facility size out of range'"),
        "missing_borrower": ("medium", "trim(coalesce(borrower, '')) = ''", "'no borrower'"),
        "missing_facility_size": ("medium", f"facility_size_mm IS NULL AND word_count > {k['words']}", "'no facility size in ' || word_count || ' words'"),
        "missing_closing_date": ("low", f"closing_date IS NULL AND word_count > {k['words']}", "'no closing date'"),
        "unknown_doc_type": ("high", "doc_type_confidence = 'low' OR doc_type IN ('', 'other') OR doc_type IS NULL", "'unsure type: ' || coalesce(doc_type, 'NULL')"),
        "short_text": ("medium", f"text_length < {k['chars']} AND text_length > 0", "text_length || ' characters'"),
        "extreme_text_ratio": ("medium", f"word_count > 0 AND text_length::DOUBLE / word_count > {k['chars_per_word']}", "round(text_length::DOUBLE / word_count, 1) || ' characters a word'"),
        "very_short_document": ("high", f"word_count < {k['words']} AND word_count > 0", "word_count || ' words'"),
        "orphan_template": ("low", "trim(coalesce(template_family, '')) = ''", "'no template family'"),
        "non_credit_agreement": ("medium", f"doc_type NOT IN ('credit_agreement', '') AND word_count > {k['some_words']}", "'type ' || doc_type || ', confidence ' || doc_type_confidence"),
        "uncertain_market_segment": ("low", "segment_confidence = 'low' AND market_segment = 'uncertain'", "'segment uncertain'"),
        "non_cohort_large_doc": ("low", f"NOT cohort_included AND word_count > {k['many_words']}", "word_count || ' words outside the cohort'"),
        "low_avg_clause_confidence": ("high", f"clause_count > {k['clauses']} AND avg_confidence < {k['confidence']}", "'confidence ' || round(avg_confidence, 3) || ' over ' || n_clauses || ' clauses'"),
        "orphan_deep_clause": ("high", "orphans > 0", "orphans || ' deep clauses without their parent'"),
        "inconsistent_sibling_depth": ("high", "uneven_groups > 0", "uneven_groups || ' groups, ' || uneven_clauses || ' clauses'"),
        "deep_nesting_outlier": ("low", "deep_clauses > 0", "'level ' || max_level || ', ' || deep_clauses || ' deep clauses'"),
        "low_structural_ratio": ("medium", f"n_clauses >= {k['total_clauses']} AND round(100.0::DOUBLE * structural / n_clauses, 1) < {k['structural_pct']}", "round(100.0::DOUBLE * structural / n_clauses, 1) || '% structural, ' || structural || ' of ' || n_clauses"),
        "rootless_deep_clause": ("medium", "rootless > 0", "rootless || ' deep clauses without a parent link'"),
        "clause_root_label_repeat_explosion": ("high", f"root_repeats >= {k['root_repeats']}", "'root label repeated ' || root_repeats || ' times'"),
        "clause_dup_id_burst": ("high", f"structural >= {k['dup_structural']} AND dup_ids::DOUBLE / structural > {k['dup_ratio']}", "round(100.0::DOUBLE * (dup_ids::DOUBLE / structural), 1) || '% duplicate ids'"),
        "clause_depth_reset_after_deep": ("high", "reset_sections > 0", "reset_sections || ' sections, ' || resets || ' resets'"),
        "duplicate_definitions": ("low", "dup_terms > 0", "dup_terms || ' terms defined again'"),
        "single_engine_definitions": ("low", f"engines = 1 AND n_definitions >= {k['one_engine']}", "n_definitions || ' definitions by ' || engine"),
        "definition_truncated_at_cap": ("high", f"capped >= {k['capped']}", "capped || ' definitions at the cap'"),
        "definition_signature_leak": ("high", "leaked > 0", "leaked || ' terms with signature marks'"),
        "definition_malformed_term": ("medium", f"malformed >= {k['malformed']}", "malformed || ' malformed terms'"),
        "section_numbering_gap": ("medium", "gaps > 0", "gaps || ' numbering gaps'"),
        "empty_section_headings": ("medium", "blank_headings > 0", "blank_headings || ' blank headings'"),
        "extreme_word_count": ("low", "q3 > q1 AND (word_count < q1 - 1.5 * (q3 - q1) OR word_count > q3 + 1.5 * (q3 - q1))", "word_count || ' words, fences ' || CAST(round(q1 - 1.5 * (q3 - q1)) AS INT) || ' to ' || CAST(round(q3 + 1.5 * (q3 - q1)) AS INT)"),
        "excessive_section_count": ("low", "s3 > s1 AND section_count > s3 + 1.5 * (s3 - s1)", "section_count || ' sections, fence ' || CAST(round(s3 + 1.5 * (s3 - s1)) AS INT)"),
    }
    quoted = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]"
    unions = "\nUNION ALL ".join(f"SELECT doc_id, borrower, '{name}' AS category, '{sev}' AS severity, {detail} AS detail, {', '.join(COLUMNS)} FROM wide WHERE {test}" for name, (sev, test, detail) in rules.items())
    return (
        v.with_views("sections", "definitions")
        + f""", ecd AS (SELECT d.doc_id, CASE WHEN o_custkey % 11 <> 0 THEN c_name END AS borrower, CASE lang WHEN 'en' THEN 'credit_agreement' WHEN 'de' THEN 'other' ELSE lang END AS doc_type,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS doc_type_confidence, CASE WHEN toxic = 1 THEN 'uncertain' ELSE 'leveraged' END AS market_segment, CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END AS segment_confidence,
  CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS BIGINT) AS word_count, n_chars AS text_length, length(text) - length(replace(text, chr(10), '')) AS section_count, len(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS definition_count,
  coalesce(n_lines, 0) AS clause_count, o_totalprice / 25.0::DOUBLE AS facility_size_mm, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS closing_date, CASE WHEN d.doc_id % 13 <> 0 THEN source END AS template_family,
  coalesce(quality, 0) = 1 AS cohort_included, d.doc_id % 4 = 0 AS section_fallback_used
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN orders o ON o_orderkey = d.doc_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey AS doc_id, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (doc_id)),
ecs AS (SELECT doc_id, CASE WHEN section_number % 5 = 4 THEN section_number || '.1' ELSE section_number::VARCHAR END AS section_number, heading FROM sections),
ecc AS (SELECT *, len(string_split(clause_id, '.')) AS level, lower(regexp_extract(label, '\\(([A-Za-z0-9]+)\\)', 1)) AS lab FROM (SELECT l_orderkey AS doc_id, (l_suppkey % 2)::VARCHAR AS section_number, {quoted(PATHS)}[l_linenumber] AS clause_id,
  CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 7 = 0 AND l_linenumber > 1 THEN 'zz' ELSE {quoted(PARENTS)}[l_linenumber] END AS parent_id, {quoted(LABELS)}[l_linenumber] AS label, l_linenumber * 100 AS span_start, l_tax * 10 AS parse_confidence, l_returnflag <> 'R' AS is_structural FROM lineitem)),
ecf AS (SELECT doc_id, term, {quoted((*CAPPED_ENGINES, "colon"))}[length(term) % 4 + 1] AS engine, length(term) * 250 AS chars FROM definitions),
f1 AS (SELECT doc_id, count(*) AS n_clauses, avg(parse_confidence) AS avg_confidence, count(*) FILTER (is_structural) AS structural, count(*) FILTER (is_structural AND level > 4) AS deep_clauses, max(level) FILTER (is_structural AND level > 4) AS max_level,
  count(*) FILTER (is_structural AND level > 1 AND parent_id = '') AS rootless, count(*) FILTER (is_structural AND contains(clause_id, '_dup')) AS dup_ids FROM ecc GROUP BY 1),
f2 AS (SELECT doc_id, count(*) AS orphans FROM ecc c WHERE level >= 3 AND is_structural AND parent_id <> '' AND NOT EXISTS (SELECT 1 FROM ecc p WHERE p.doc_id = c.doc_id AND p.section_number = c.section_number AND p.clause_id = c.parent_id) GROUP BY 1),
f3 AS (SELECT doc_id, count(*) AS uneven_groups, sum(m) AS uneven_clauses FROM (SELECT doc_id, count(*) AS m FROM ecc WHERE is_structural AND parent_id <> '' GROUP BY doc_id, section_number, parent_id HAVING count(DISTINCT level) > 1) GROUP BY 1),
f4 AS (SELECT doc_id, max(m) AS root_repeats FROM (SELECT doc_id, count(*) AS m FROM ecc WHERE is_structural AND level = 1 AND lab <> '' GROUP BY doc_id, section_number, lab) GROUP BY 1),
f5 AS (SELECT doc_id, count(*) AS reset_sections, sum(m) AS resets FROM (SELECT doc_id, count(*) AS m FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id, section_number ORDER BY span_start) AS prev FROM ecc WHERE is_structural) WHERE prev >= 4 AND level = 1 AND length(lab) = 1 AND lab BETWEEN 'm' AND 'z' GROUP BY doc_id, section_number) GROUP BY 1),
f6 AS (SELECT doc_id, count(*) FILTER (m > 1) AS dup_terms FROM (SELECT doc_id, term, count(*) AS m FROM ecf GROUP BY 1, 2) GROUP BY 1),
f7 AS (SELECT doc_id, count(*) AS n_definitions, min(engine) AS engine, count(DISTINCT engine) AS engines, count(*) FILTER (chars >= {k['cap']} AND engine <> 'colon' AND length(term) >= 3) AS capped,
  count(*) FILTER (regexp_matches(lower(term), '{SIGNATURE}')) AS leaked, count(*) FILTER (contains(term, chr(10)) OR length(trim(term)) > {k['term_chars']} OR regexp_matches(lower(term), '{PARTY_START}')) AS malformed FROM ecf GROUP BY 1),
f8 AS (SELECT doc_id, count(*) AS gaps FROM (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM (SELECT doc_id, section_number::DOUBLE AS n FROM ecs WHERE NOT contains(section_number, '.'))) WHERE n - prev > 1 AND n > 1 GROUP BY 1),
f9 AS (SELECT doc_id, count(*) AS blank_headings FROM ecs WHERE trim(heading) = '' GROUP BY 1),
q AS (SELECT quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.75) AS q3, quantile_cont(section_count, 0.25) AS s1, quantile_cont(section_count, 0.75) AS s3 FROM ecd),
wide AS (SELECT * FROM ecd LEFT JOIN f1 USING (doc_id) LEFT JOIN f2 USING (doc_id) LEFT JOIN f3 USING (doc_id) LEFT JOIN f4 USING (doc_id) LEFT JOIN f5 USING (doc_id) LEFT JOIN f6 USING (doc_id) LEFT JOIN f7 USING (doc_id) LEFT JOIN f8 USING (doc_id) LEFT JOIN f9 USING (doc_id), q),
cases AS ({unions})
"""
    )


_SQL = _sql()
_TIER_SQL = "CASE " + " ".join(f"WHEN category IN ({', '.join(repr(n) for n in names)}) THEN '{t}'" for t, names in TIERS.items()) + " END"
for _tier, _names in TIERS.items():
    for _name in _names:
        register(f"edge_{_name}", lambda spark, d, name=_name: over_tables(spark, d).where(F.col("category") == name), _SQL + f"SELECT * FROM cases WHERE category = '{_name}'")
register("edge_case_counts", lambda spark, d: counts(over_tables(spark, d)), _SQL + f"SELECT category, count(*) AS n, {_TIER_SQL} AS tier FROM cases GROUP BY 1")
register("edge_case_page", lambda spark, d: page(over_tables(spark, d), number=2), _SQL + "SELECT * FROM cases ORDER BY category, doc_id LIMIT 50 OFFSET 100")
register("edge_cases_of_cohort", lambda spark, d: over_tables(spark, d, cohort_only=True).where("category not in ('extreme_word_count', 'excessive_section_count')"), _SQL + "SELECT * FROM cases WHERE doc_id IN (SELECT doc_id FROM ecd WHERE cohort_included) AND category NOT IN ('extreme_word_count', 'excessive_section_count')")
