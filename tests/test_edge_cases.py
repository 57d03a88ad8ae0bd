"""Every condition of the catalogue on documents made to meet it, and a clean one that meets none."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.operators import edge_cases as ec

CLEAN = {"doc_id": 0, "borrower": "B", "doc_type": "credit_agreement", "doc_type_confidence": "high", "market_segment": "leveraged", "segment_confidence": "high", "word_count": 9000, "text_length": 50000, "section_count": 40, "definition_count": 100, "clause_count": 200, "facility_size_mm": 100.0, "closing_date": "2020-01-01", "template_family": "t", "cohort_included": True, "section_fallback_used": False}

DOCUMENTS = {
    "missing_sections": {"section_count": 0}, "low_section_count": {"section_count": 3}, "section_fallback_used": {"section_fallback_used": True}, "zero_clauses": {"clause_count": 0},
    "low_clause_density": {"clause_count": 50}, "low_definitions": {"definition_count": 5, "word_count": 10500}, "zero_definitions": {"definition_count": 0}, "high_definition_count": {"definition_count": 501},
    "extreme_facility": {"facility_size_mm": 0.5}, "missing_borrower": {"borrower": " "}, "missing_facility_size": {"facility_size_mm": None}, "missing_closing_date": {"closing_date": None},
    "unknown_doc_type": {"doc_type_confidence": "low"}, "short_text": {"text_length": 9000}, "extreme_text_ratio": {"text_length": 140000}, "very_short_document": {"word_count": 4000},
    "orphan_template": {"template_family": None}, "non_credit_agreement": {"doc_type": "waiver"}, "uncertain_market_segment": {"market_segment": "uncertain", "segment_confidence": "low"}, "non_cohort_large_doc": {"cohort_included": False, "word_count": 10500},
    "extreme_word_count": {"word_count": 90000}, "excessive_section_count": {"section_count": 400, "clause_count": 2000},
}


def clause(doc, clause_id, parent, label="(a)", at=0, structural=True, confidence=0.9, section="1"):
    return (doc, section, clause_id, parent, label, at, confidence, structural)


def test_every_category(spark):
    names = [n for tier in ec.TIERS.values() for n in tier]
    ids = {n: i + 1 for i, n in enumerate(names)}
    docs = [Row(**CLEAN)] + [Row(**(CLEAN | {"doc_id": ids[n]} | DOCUMENTS.get(n, {}))) for n in names]
    docs += [Row(**(CLEAN | {"doc_id": 100 + k, "word_count": 8900 + 20 * k, "section_count": 36 + k})) for k in range(56)]
    d = ids
    clauses = [clause(d["low_avg_clause_confidence"], "a", "", confidence=0.1), clause(d["orphan_deep_clause"], "a.i.A", "a.i"), clause(d["deep_nesting_outlier"], "a.i.A.1", ""), clause(d["rootless_deep_clause"], "a.i", None)]
    clauses += [clause(d["inconsistent_sibling_depth"], x, "a") for x in ("a", "a.i", "a.ii")]
    deep = d["deep_nesting_outlier"]
    clauses += [clause(deep, "a.i.A.1.x", "a.i.A.1")]
    clauses += [clause(d["low_structural_ratio"], f"{k}", "", structural=k < 4) for k in range(10)]
    clauses += [clause(d["clause_root_label_repeat_explosion"], f"r{k}", "") for k in range(200)]
    clauses += [clause(d["clause_dup_id_burst"], f"b_dup{k}" if k < 190 else f"b{k}", "", label=f"(x{k})") for k in range(200)]
    for k in range(2):
        clauses += [clause(d["clause_depth_reset_after_deep"], "a.i.A.1", "a.i.A", at=10 * k), clause(d["clause_depth_reset_after_deep"], "n", "", "(n)", at=10 * k + 1)]
    clauses += [clause(d["clause_depth_reset_after_deep"], "a.i.A", "", at=99)]
    terms = [(d["duplicate_definitions"], "T", e, 50) for e in ("quoted", "colon")]
    terms += [(d["single_engine_definitions"], f"Term {k}", "quoted", 50) for k in range(10)]
    terms += [(d["definition_truncated_at_cap"], f"Term {k}", "quoted", 1999) for k in range(5)]
    terms += [(d["definition_signature_leak"], "By : someone", "quoted", 50)]
    terms += [(d["definition_malformed_term"], f"the Borrower {k}", "quoted" if k else "colon", 50) for k in range(20)]
    sections = [(d["section_numbering_gap"], n, "H") for n in ("1", "2", "2.5", "5")] + [(d["empty_section_headings"], "1", " ")]
    found = ec.edge_cases(
        spark.createDataFrame(docs, "doc_id long, borrower string, doc_type string, doc_type_confidence string, market_segment string, segment_confidence string, word_count long, text_length long, section_count long, definition_count long, clause_count long, facility_size_mm double, closing_date string, template_family string, cohort_included boolean, section_fallback_used boolean"),
        spark.createDataFrame(sections, "doc_id long, section_number string, heading string"),
        spark.createDataFrame(clauses, "doc_id long, section_number string, clause_id string, parent_id string, label string, span_start int, parse_confidence double, is_structural boolean"),
        spark.createDataFrame(terms, "doc_id long, term string, pattern_engine string, definition_chars int"),
    ).cache()
    got = {(r["doc_id"], r["category"]) for r in found.collect()}
    assert {(ids[n], n) for n in names} <= got
    assert not [c for i, c in got if i == 0 or i >= 100]
    assert {r["tier"] for r in ec.counts(found).collect()} == set(ec.TIERS)
    assert ec.page(found, "missing_borrower").count() == 1
    assert found.where(F.col("detail").isNull()).count() == 0


def test_alternatives_stay_within_the_cohort(spark):
    docs = spark.createDataFrame([Row(**(CLEAN | {"doc_id": 5, "borrower": None, "template_family": "", "doc_type": None, "cohort_included": False}))], "doc_id long, borrower string, doc_type string, doc_type_confidence string, market_segment string, segment_confidence string, word_count long, text_length long, section_count long, definition_count long, clause_count long, facility_size_mm double, closing_date string, template_family string, cohort_included boolean, section_fallback_used boolean")
    empty = (spark.createDataFrame([], s) for s in ("doc_id long, section_number string, heading string", "doc_id long, section_number string, clause_id string, parent_id string, label string, span_start int, parse_confidence double, is_structural boolean", "doc_id long, term string, pattern_engine string, definition_chars int"))
    tables = list(empty)
    assert ec.edge_cases(docs, *tables, cohort_only=True).count() == 0
    assert {r["category"] for r in ec.edge_cases(docs, *tables).collect()} == {"missing_borrower", "orphan_template", "unknown_doc_type"}
