"""Rule scan and bulk run on a small rule book: matches, inheritance, terms, reconciliation, conflicts, and a rerun."""

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from folioscope import registry
from folioscope.operators import rules
from folioscope.plans.stages import written

RULE = "rule_id string, family_id string, scope_id string, version int, status string, parent_family_id string, scope_mode string, granularity string, phrases array<string>, concepts array<string>, terms array<string>, term_phrases array<string>"
SECTION = "doc_id string, section_number string, article_num int, heading string, char_start int, char_end int"
LINK = "link_id string, family_id string, scope_id string, doc_id string, section_number string, clause_key string, status string"


def rule(rule_id, family, phrases, version=1, status="published", scope=None, parent=None, mode="corpus", grain="section", concepts=(), terms=(), term_phrases=()):
    return (rule_id, family, scope, version, status, parent, mode, grain, list(phrases), list(concepts), list(terms), list(term_phrases))


BOOK = [
    rule("debt1", "debt", ["Old Words"], version=1),
    rule("debt2", "debt", ["Limitation on Debt", "Indebtedness"], version=2),
    rule("debt3", "debt", ["Nothing"], version=9, status="archived"),
    rule("ratio", "debt.ratio", ["ratio"], mode="inherited"),
    rule("liens", "liens", ["Permitted Liens Basket of Grantor"], concepts=["negative"]),
    rule("any", "any", [], concepts=["Definitions"]),
    rule("terms", "terms", ["Defined Terms"], grain="defined_term", term_phrases=["ebitda"], terms=["EBITDA", "Net Income"]),
    rule("nobody", "", ["x"]),
]
SECTIONS = [
    ("d1", "1.01", 1, "Defined Terms", 0, 100), ("d1", "7.01", 7, "Indebtedness", 100, 200), ("d1", "7.02", 7, "Limitation on Debt; Ratio Test", 200, 300), ("d1", "7.03", 7, "Liens Basket Permitted here", 300, 400),
    ("d1", "7.04", 7, "Ratio of Anything", 400, 500), ("d2", "7.01", 7, " LIMITATION ON DEBT ", 0, 50), ("d2", "7.02", 8, "Basket Liens Permitted", 50, 90), ("d2", "9.01", 9, "", 90, 95), ("d2", "9.02", 9, None, 95, 99),
]
ARTICLES = [("d1", 1, "DEFINITIONS"), ("d1", 7, "NEGATIVE_COVENANTS"), ("d2", 7, "negative covenants"), ("d2", 8, "affirmative")]
DEFINITIONS = [("d1", "Consolidated EBITDA", 10, 40), ("d1", "EBITDA", 120, 150), ("d1", "Other", 50, 60), ("d2", "EBITDA", 5, 9)]
LINKS = [
    ("old", "debt", "debt", "d1", "7.03", "", "active"), ("same", "debt", "debt", "d1", "7.01", "__section__", "active"), ("user", "debt", "debt", "d2", "7.01", None, "unlinked"),
    ("else", "elsewhere", "elsewhere", "d1", "7.03", "__section__", "active"),
]
MATRIX = [("debt", "elsewhere", "exclusive"), ("elsewhere", "liens", "warn"), ("debt", "debt.ratio", "shared_ok")]


@pytest.fixture(scope="module")
def book(spark):
    return {
        "rules": spark.createDataFrame(BOOK, RULE), "sections": spark.createDataFrame(SECTIONS, SECTION), "articles": spark.createDataFrame(ARTICLES, "doc_id string, article_num int, concept string"),
        "definitions": spark.createDataFrame(DEFINITIONS, "doc_id string, term string, char_start int, char_end int"), "links": spark.createDataFrame(LINKS, LINK), "matrix": spark.createDataFrame(MATRIX, "a string, b string, policy string"),
    }


@pytest.fixture(scope="module")
def run(book):
    return rules.bulk_run(book["rules"], book["sections"], book["articles"], book["definitions"], book["links"])


def test_scan(book):
    found = {(r["rule_id"], r["doc_id"], r["section_number"], r["clause_key"]): r for r in rules.scan(rules.latest_rules(book["rules"]), book["sections"], book["articles"], book["definitions"]).collect()}
    by_rule = {}
    for (rid, *place), r in found.items():
        by_rule.setdefault(rid, {})[tuple(place)] = (r["match_type"], r["matched_value"])
    whole = "__section__"
    assert by_rule == {
        "debt2": {("d1", "7.01", whole): ("exact", "Indebtedness"), ("d1", "7.02", whole): ("substring", "Limitation on Debt"), ("d2", "7.01", whole): ("exact", "Limitation on Debt")},
        "ratio": {("d1", "7.02", whole): ("substring", "ratio"), ("d1", "7.04", whole): ("substring", "ratio")},
        "liens": {("d1", "7.03", whole): ("partial", "Permitted Liens Basket of Grantor")},
        "any": {("d1", "1.01", whole): ("none", "")},
        "terms": {("d1", "1.01", "__def__:10:40:Consolidated EBITDA"): ("exact", "Defined Terms")},
    }
    scores = {k[:3]: r["confidence"] for k, r in found.items()}
    assert scores["debt2", "d1", "7.01"] == round(0.22 * 0.5 + 0.28 + 0.5 * 0.5, 6)
    assert scores["liens", "d1", "7.03"] == round(0.28 * 0.3 + 0.5 * 0.5, 6)
    assert scores["terms", "d1", "1.01"] == round(0.22 * 0.5 + 0.28 + 0.09 * 0.5 + 0.5 * 0.41, 6)


def test_run_reconciles(book, run):
    candidates, actions = run
    ratio = {(r["doc_id"], r["section_number"]) for r in candidates.where("rule_id = 'ratio'").collect()}
    assert ratio == {("d1", "7.02")}  # inherited: only where the parent has a link
    got = {(r["scope_id"], r["doc_id"], r["section_number"]): (r["action"], r["status"]) for r in actions.collect()}
    assert got == {
        ("debt", "d1", "7.01"): ("keep", "active"), ("debt", "d1", "7.02"): ("create", "pending_review"), ("debt", "d1", "7.03"): ("unlink", "unlinked"), ("debt", "d2", "7.01"): ("skip", "unlinked"),
        ("debt.ratio", "d1", "7.02"): ("create", "pending_review"), ("terms", "d1", "1.01"): ("create", "pending_review"),
    }


def test_rerun_changes_nothing(book, run):
    after = rules.applied(book["links"], run[1])
    assert after.count() == len(LINKS) + 3 and {r["link_id"]: r["status"] for r in after.where("link_id IN ('old', 'same', 'user', 'else')").collect()} == {"old": "unlinked", "same": "active", "user": "unlinked", "else": "active"}
    _, again = rules.bulk_run(book["rules"], book["sections"], book["articles"], book["definitions"], after)
    assert again.where("action IN ('create', 'unlink')").isEmpty() and again.where("action = 'keep'").count() == 4
    assert rules.applied(after, again).exceptAll(after).isEmpty()


def test_conflicts_and_summary(book, run):
    found = {(r["rule_id"], r["section_number"], r["other_family"], r["policy"]) for r in rules.run_conflicts(run[0], book["links"], book["matrix"]).collect()}
    assert found == {("liens", "7.03", "elsewhere", "warn")}
    sums = {r["scope_id"]: (r["candidates"], r["created"], r["kept"], r["unlinked"]) for r in rules.run_summary(*run).collect()}
    assert sums == {"debt": (3, 1, 1, 1), "debt.ratio": (1, 1, 0, 0), "liens": (1, 0, 0, 0), "any": (1, 0, 0, 0), "terms": (1, 1, 0, 0)}


def test_explicit_parents_and_levels(spark):
    book = spark.createDataFrame([rule("a", "a", ["x"]), rule("c", "a.b.c", ["x"], mode="inherited"), rule("d", "z", ["x"], mode="inherited", parent="a.b.c"), rule("e", "q.r", ["x"], mode="inherited"), rule("g", "a.b.c.d.e", ["x"], mode="inherited", parent="missing")], RULE)
    got = {r["rule_id"]: (r["parent"], r["level"]) for r in rules.in_order(rules.latest_rules(book)).collect()}
    # z comes before a.b.c, so its parent has nothing new for it yet.
    assert got == {"a": (None, 0), "c": ("a", 1), "d": ("a.b.c", 0), "e": (None, 0), "g": ("a.b.c", 2)}


def test_index_finds_what_all_pairs_find(spark):
    phrases = ["a", "of", "debt", "limitation on debt", "xyz", "on the", "é", "one two three four", "  ", "b c d"]
    headings = ["a", "", "debt", "on debt", "limitation on debt here", "café", "one three", "four five one two", "two", "of", "offer", "d c", "xy"]
    needles, texts = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for xs, n in ((phrases, "needle"), ([h for h in headings if h], "h")))
    assert {tuple(r) for r in rules.contained(needles, texts).collect()} == {(n, h) for n in phrases for h in headings if h and n in h}
    words = lambda x: set(x.split())
    half = {(n, h) for n in phrases for h in headings if words(n) and 2 * len(words(n) & words(h)) >= len(words(n))}
    assert {tuple(r) for r in rules.half_shared(needles, texts).collect()} == half


def test_empty_book(spark, book):
    none = book["rules"].limit(0)
    candidates, actions = rules.bulk_run(none, book["sections"], book["articles"], book["definitions"], book["links"])
    assert candidates.count() == 0 and actions.count() == 0
    assert rules.scan(rules.latest_rules(book["rules"]), book["sections"].limit(0), book["articles"], book["definitions"]).count() == 0
    assert rules.token(F.lit("x")) is not None


def broadcast_parts(df):
    """The parts of the plan below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for k, line in enumerate(lines):
        if (at := line.find("BroadcastExchange")) >= 0:
            rest = [next((j for j, c in enumerate(x) if c.isalpha() or c == "*"), 0) for x in lines[k + 1 :]]
            yield "\n".join(lines[k : k + 1 + next((j for j, x in enumerate(rest) if x <= at), len(rest))])


def test_exploded_texts_are_never_broadcast(spark):
    """A written table of texts is small as a file; its runs and words are not."""
    texts = written(spark.range(300).selectExpr("concat('heading number ', id) AS h"))
    needles = spark.createDataFrame([("number 7",), ("heading of",)], "needle string")
    for search in (rules.contained, rules.half_shared):
        assert not [p for p in broadcast_parts(search(needles, texts)) if "Generate" in p]
        assert search(needles, texts).count() == {rules.contained: 11, rules.half_shared: 600}[search]


def test_blank_phrases_and_unmatched_ones_as_in_sql(spark, tmp_path):
    """A first line that is blank makes a rule of blank phrases, which finds nothing; a phrase that contains a heading but shares too few words with it gives no score."""
    docs = [(1, "\nx y\nq", "en", "s"), (2, "x y\nx", "en", "s"), (3, " p q\np", "de", "s"), (4, "a b c d e\nb c\nc", "en", "t"), (5, "z c\nb c", "de", "t")]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(tmp_path)
    for name in ("rule_scan", "bulk_run_summary"):
        assert compare(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) is None


def test_conflicts_send_no_growing_side_to_the_driver(spark):
    """Only the matrix, a table of rules, may be broadcast; others are merged however small they are."""
    turn = "struct<depth: int, family_id: string, v: int, rule_id: string>"
    own = spark.createDataFrame([("r1", "a", (0, "a", 0, "r1"), "d", "1"), ("r2", "b", (0, "b", 0, "r2"), "d", "1")], f"rule_id string, family_id string, turn {turn}, doc_id string, section_number string")
    links, matrix = spark.createDataFrame([("l", "c", "c", "d", "1", "", "active")], LINK), spark.createDataFrame([("a", "b", "warn"), ("a", "c", "exclusive")], "a string, b string, policy string")
    out = rules.run_conflicts(own, links, matrix)
    assert {tuple(r) for r in out.collect()} == {("r2", "d", "1", "a", "warn"), ("r1", "d", "1", "c", "exclusive")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=merge)") == 1
