"""Counts of n-grams on small sections."""

from folioscope.operators import discovery


def test_counts_are_written_once(spark):
    rows = [(1, 1, "alpha beta alpha", True), (1, 2, "alpha", True), (2, 1, "alpha gamma", False), (3, 1, None, False)]
    split = spark.createDataFrame(rows, "doc_id long, section_number long, text string, target boolean")
    by, totals = discovery.counted(split)
    got = {r.gram: (r.ts, r.bs, r.tu, r.bu, r.docs) for r in by.collect()}
    assert got["alpha"] == (2, 1, 3, 1, 1) and got["alpha beta"] == (1, 0, 1, 0, 1) and got["gamma"] == (0, 1, 0, 1, 0)
    assert totals.first().asDict() == {"nt": 2, "nb": 2, "all_tu": 6, "all_bu": 3}
    assert hasattr(by, "written_at")  # read by the totals and the places, counted once


def test_keywords_have_three_tiers(spark):
    """Ten anchors, ten for sections, five specific ones; words with hyphens, and no section without text."""
    texts = [(1, k, f"cross_default non-core {'rare' if k == 1 else 'often'}", True) for k in range(1, 5)]
    texts += [(1, 5, "", True), (1, 6, None, True), (2, 1, "other", False), (2, 2, "", False)]
    split = spark.createDataFrame(texts, "doc_id long, section_number long, text string, target boolean")
    got = [(r.gram, r.rate, r.tier) for r in discovery.keyword_tiers(split).collect()]
    most = {"cross_default": 1.0, "non-core": 1.0, "cross_default non-core": 1.0, "non-core often": 0.75, "often": 0.75, "non-core rare": 0.25, "rare": 0.25}
    assert {(g, r) for g, r, tier in got if tier == "anchor"} == set(most.items())
    assert [g for g, _, tier in got if tier == "specific"] == ["cross_default", "cross_default non-core", "non-core", "non-core often", "often"]
    assert not [g for g, _, tier in got if tier == "section"]


def test_profile_shuffles_counts_only(spark):
    """Sections count with or without words; what is shuffled has no section in it."""
    rows = [(1, 1, "alpha beta alpha ab", True), (1, 2, None, True), (1, 3, "", True), (2, 1, "gamma alpha", False)]
    out = discovery.family_profile(spark.createDataFrame(rows, "doc_id long, section_number long, text string, target boolean"))
    assert {tuple(r) for r in out.collect()} == {(True, 3, 3, 2, 0.666667), (False, 1, 2, 2, 1.0)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
