"""Linking by rules: scan of a rule table over sections, and the run that reconciles stored links.

Rules are rows. Their phrases meet the distinct headings through an inverted index: a
phrase that a heading contains shares its rarest run of three characters with it, and one
of which half the words occur shares one of its rarest words, so that only such pairs are
looked at. Articles and documents are joined afterwards, parents come before children,
and one full outer join of the found keys with the stored ones says what to create, keep
and unlink. Sides that grow with the input are merged: a side that is small in compressed
form would be broadcast through the driver, where it is many times as large.

Columns: rules (rule_id, family_id, scope_id, version, status, parent_family_id,
scope_mode, granularity, phrases, concepts, terms, term_phrases); sections (doc_id,
section_number, article_num, heading, and char_start, char_end where rules of granularity
``defined_term`` are used); articles (doc_id, article_num, concept); definitions (doc_id,
term, char_start, char_end); links (link_id, family_id, scope_id, doc_id, section_number,
clause_key, status); matrix (a, b, policy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..plans.stages import beside, delete, joined_by_size, written
from ..registry import register
from .scoring import link_confidence

GRAM = 3
WHOLE = "__section__"
ACTIVE = ("published", "draft")
CONFLICTING = ("exclusive", "warn", "compound_covenant")


def lowered(text: Column) -> Column:
    return F.lower(F.trim(text))


def token(text: Column) -> Column:
    """Lower-case letters and digits with underscores between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def latest_rules(rules: DataFrame) -> DataFrame:
    """The active rule with the highest version of each scope, ties by id; rules without scope and family go."""
    scope = F.coalesce(F.nullif(F.trim("scope_id"), F.lit("")), F.nullif(F.trim("family_id"), F.lit("")))
    df = rules.where(F.col("status").isin(*ACTIVE) | F.col("status").isNull()).withColumn("scope_id", scope).where("scope_id is not null")
    order = W.partitionBy("scope_id").orderBy(F.desc(F.coalesce("version", F.lit(0))), "rule_id")
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def grams(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, F.lit(width)))))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, h): the distinct texts (h) that contain each distinct needle.

    A needle is looked up by the run of three characters (or itself, if shorter) that
    the fewest texts have. Only runs that some needle has are counted.
    """
    own = F.when(F.length("needle") >= GRAM, grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    asked = written(needles.where("needle <> ''").select("needle", F.explode(own).alias("g")))
    widths = [r[0] for r in asked.select(F.length("g").alias("w")).distinct().orderBy("w").collect()]  # at most three
    keys = [F.coalesce(grams(F.col("h"), w), F.array().cast("array<string>")) for w in widths]
    held = texts.select("h", F.explode(F.concat(*keys) if keys else F.array().cast("array<string>")).alias("g"))
    common = held.join(beside(asked.select("g").distinct()), "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(common, "g").groupBy("needle").agg(F.min(F.struct("n", "g")).alias("x"), F.count(F.lit(1)).alias("met"))
    # A text that holds the needle has all its runs, so a needle with a run that no text has is in none.
    runs = asked.groupBy("needle").agg(F.count(F.lit(1)).alias("runs"))
    rarest = written(rarest.join(runs, "needle").where("met = runs").select("needle", F.col("x.g").alias("g")))
    return held.join(beside(rarest), "g").where(F.col("h").contains(F.col("needle"))).select("needle", "h")


def half_shared(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, h): the texts that have at least half of the needle's distinct words.

    Of n words a text with half of them has at least one among any n - ceil(n / 2) + 1;
    the needle is looked up by those that the fewest texts have, and a pair counts at the
    first of them that the text has.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, "\\s+"), lambda w: w != ""))
    asked = written(needles.select("needle", words(F.col("needle")).alias("nw")).select("needle", "nw", F.explode("nw").alias("w")))
    each = texts.select("h", F.explode(words(F.col("h"))).alias("w"))
    common = each.join(beside(asked.select("w").distinct()), "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    first = asked.join(common, "w", "left").groupBy("needle").agg(F.first("nw").alias("nw"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("x"))  # one needle's words
    kept = F.size("nw") - F.ceil(F.size("nw") / 2).cast("int") + 1
    keys = first.select("needle", "nw", F.filter(F.slice("x", F.lit(1), kept), lambda x: x["n"] > 0)["w"].alias("ks"))
    keys = written(keys.select("needle", "nw", "ks", F.explode("ks").alias("w")))
    of_text = words(F.col("h"))
    pairs = each.join(beside(keys), "w").where(2 * F.size(F.array_intersect(of_text, "nw")) >= F.size("nw"))
    return pairs.where(F.col("w") == F.get(F.array_intersect("ks", of_text), F.lit(0))).select("needle", "h")


def heading_matches(rules: DataFrame, headings: DataFrame) -> DataFrame:
    """(rule_id, h, rank, i): of the rule's phrases the first (place i) that the heading contains (rank 0), else the first of which it has half the words (rank 1).

    The rows of a heading lie in one partition.
    """
    values = written(rules.select("rule_id", F.posexplode("phrases").alias("i", "value")).select("rule_id", "i", lowered(F.col("value")).alias("needle")).where("needle <> ''"))
    needles, texts = values.select("needle").distinct(), headings.where("h <> ''")
    pairs = contained(needles, texts).withColumn("rank", F.lit(0)).unionByName(half_shared(needles, texts).withColumn("rank", F.lit(1)))
    # The two hold a pair once each; what is shuffled are a heading and numbers.
    best = pairs.join(beside(values), "needle").select("h", "rule_id", "rank", "i").repartition("h").groupBy("rule_id", "h").agg(F.min(F.struct("rank", "i")).alias("x"))
    return best.select("rule_id", "h", "x.rank", "x.i")


def concept_matches(concepts: Column, actual: Column) -> Column:
    """Whether one of the rule's concepts equals, contains or lies in the article's; without concepts, always."""
    return (F.size(concepts) == 0) | (actual != "") & F.exists(concepts, lambda c: (token(c) != "") & (actual.contains(token(c)) | token(c).contains(actual)))


def exactness(heading: Column, phrases: Column) -> Column:
    """1 for an equal heading, 0.7 where it contains a phrase, 0.5 where a phrase contains it of which it has half the words, 0.3 where a word is shared."""
    lows = F.filter(F.transform(phrases, lowered), lambda x: x != "")
    words = F.split(heading, "\\s+")
    half = lambda x: 2 * F.size(F.array_intersect(F.split(x, "\\s+"), words)) >= F.size(F.array_distinct(F.split(x, "\\s+")))
    return (
        F.when(heading == "", 0.0)
        .when(F.exists(lows, lambda x: x == heading), 1.0)
        .when(F.exists(lows, lambda x: heading.contains(x)), 0.7)
        .when(F.exists(lows, lambda x: x.contains(heading) & half(x)), 0.5)
        .when(F.exists(lows, lambda x: F.arrays_overlap(F.split(x, "\\s+"), words)), 0.3)
        .otherwise(0.0)
    )


def scan(rules: DataFrame, sections: DataFrame, articles: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row for each section, or matching definition in it, that a rule finds, with confidence and tier.

    ``rules`` are latest_rules. A rule that lists no phrase takes every section of its
    concepts, one without either takes all. One whose phrases are all blank finds none.
    """
    none = F.array().cast("array<string>")
    rules = written(rules.withColumns({c: F.coalesce(c, none) for c in ("phrases", "concepts", "terms", "term_phrases")}))
    has_phrase = F.size("phrases") > 0
    rows = sections.withColumns({"h": lowered(F.coalesce("heading", F.lit("")))}).join(articles.select("doc_id", "article_num", "concept").dropDuplicates(["doc_id", "article_num"]).hint("merge"), ["doc_id", "article_num"], "left").withColumn("actual", token(F.col("concept")))
    # Of a document's terms only those that some rule expects are gathered, beside its sections.
    expected = written(rules.select(F.explode("terms").alias("t")).select(F.lower("t").alias("t")).distinct())
    if expected.isEmpty():
        rows = rows.withColumn("present", none)
    else:
        present = definitions.select("doc_id", F.lower("term").alias("t")).join(beside(expected), "t", "left_semi").groupBy("doc_id").agg(F.collect_set("t").alias("present"))
        rows = rows.join(present.hint("merge"), "doc_id", "left").withColumn("present", F.coalesce("present", none))
    rows = written(rows)
    total = rows.count()
    packed = F.collect_list(F.struct("rule_id", "rank", "i")).alias("found")  # at most the rules
    headings = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    by_heading = written(heading_matches(rules.where(has_phrase), headings.select("h")).groupBy("h").agg(packed).join(headings.hint("merge"), "h"))
    found = [joined_by_size(rows, by_heading, "h", total).drop("n")]
    open_rules = rules.where(~has_phrase)
    plain = [F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("i")]
    if not open_rules.isEmpty():
        actuals = written(rows.groupBy(F.col("actual").alias("h")).agg(F.count(F.lit(1)).alias("n")))
        tokens = open_rules.select("rule_id", F.explode("concepts").alias("c")).select("rule_id", token(F.col("c")).alias("needle")).where("needle <> ''")
        some, texts = tokens.select("needle").distinct(), actuals.where("h <> ''").select("h")
        pairs = contained(some, texts).union(contained(texts.withColumnRenamed("h", "needle"), some.withColumnRenamed("needle", "h")).select(F.col("h"), F.col("needle"))).distinct()
        by_concept = written(pairs.join(tokens, "needle").select("h", "rule_id", *plain).distinct().groupBy("h").agg(packed).join(actuals, "h").withColumnRenamed("h", "actual"))
        found.append(joined_by_size(rows, by_concept, "actual", total).drop("n"))
        universal = open_rules.where(F.size("concepts") == 0).select("rule_id", *plain).agg(packed)  # one row
        found.append(rows.join(F.broadcast(universal.where(F.size("found") > 0)), F.lit(True)))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.withColumn("x", F.explode("found")).select("*", "x.*").drop("x", "found")
    book = rules.select("rule_id", "family_id", "scope_id", "version", "granularity", "phrases", "concepts", "terms", "term_phrases")
    df = pairs.join(beside(book), "rule_id").where(concept_matches(F.col("concepts"), F.col("actual"))).withColumn("matched_value", F.coalesce(F.get("phrases", F.col("i")), F.lit("")))
    kind = F.when(F.col("rank").isNull(), "none").when(F.col("rank") == 1, "partial").when(lowered(F.col("matched_value")) == F.col("h"), "exact").otherwise("substring")
    df = df.withColumn("match_type", kind)
    wanted = F.array_distinct(F.transform("terms", lambda t: F.lower(t)))
    share = F.size(F.array_intersect(wanted, "present")) / F.size(wanted)
    unknown = F.lit(None).cast("double")
    df = df.withColumns(
        {
            "article": F.when(F.size("concepts") == 0, 0.5).when(F.array_contains("concepts", F.col("concept")), 1.0).otherwise(0.0),
            "heading_score": exactness(F.col("h"), F.col("phrases")), "clause": unknown, "template": unknown,
            "terms_score": F.when(F.size(wanted) > 0, share).otherwise(0.5), "structure": unknown, "semantic": unknown,
        }
    )
    names = ["rule_id", "family_id", "scope_id", "version", "doc_id", "section_number", "match_type", "matched_value"]
    scored = link_confidence(df.drop("heading", "terms").withColumnsRenamed({"heading_score": "heading", "terms_score": "terms"}))
    by_term = F.coalesce(F.col("granularity") == "defined_term", F.lit(False)) & (F.size("term_phrases") > 0)
    out = scored.where(~by_term).select(*names, F.lit(WHOLE).alias("clause_key"), "confidence", "tier")
    if {"char_start", "char_end"} <= set(sections.columns):
        spans = definitions.select("doc_id", "term", F.col("char_start").alias("from"), F.col("char_end").alias("to"))
        inside = (F.col("char_start") <= F.col("from")) & (F.col("to") <= F.col("char_end"))
        meant = F.exists("term_phrases", lambda p: (F.trim(p) != "") & F.lower(F.trim("term")).contains(lowered(p)))
        terms = scored.where(by_term).join(spans, "doc_id").where(inside & meant & (F.trim("term") != ""))
        out = out.unionByName(terms.select(*names, F.concat_ws(":", F.lit("__def__"), "from", "to", F.trim("term")).alias("clause_key"), "confidence", "tier"))
    return out


def in_order(rules: DataFrame) -> DataFrame:
    """``rules`` with ``turn`` (their order: depth, family, version), ``parent`` (the explicit one or the nearest ancestor that has a rule) and ``level``.

    An inherited rule's level is above those of its parent's rules that come before it.
    """
    dots = F.size(F.split("family_id", "\\.")) - 1
    df = rules.withColumn("turn", F.struct(dots.alias("depth"), "family_id", (-F.coalesce("version", F.lit(0))).alias("v"), "rule_id"))
    families = rules.select(F.col("family_id").alias("ancestor")).distinct()
    parts = F.filter(F.split("family_id", "\\."), lambda p: p != "")
    ancestors = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct((1 + k).alias("near"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("ancestor"))))
    named = F.struct(F.lit(1_000_000).alias("near"), F.trim(F.coalesce("parent_family_id", F.lit(""))).alias("ancestor"))
    up = df.select("rule_id", F.explode(F.concat(F.array(named), F.coalesce(ancestors, F.array().cast("array<struct<near: int, ancestor: string>>")))).alias("x")).select("rule_id", "x.*")
    up = up.join(families, "ancestor").groupBy("rule_id").agg(F.max(F.struct("near", "ancestor")).alias("x")).select("rule_id", F.col("x.ancestor").alias("parent"))
    inherited = F.lower(F.trim(F.coalesce("scope_mode", F.lit("corpus")))) == "inherited"
    df = df.join(up, "rule_id", "left").withColumn("parent", F.when(inherited, F.col("parent")))
    level = written(df.select("rule_id", "family_id", "parent", "turn", F.lit(0).alias("level")))
    while True:
        above = level.select(F.col("family_id").alias("parent"), F.col("turn").alias("before"), F.col("level").alias("upper"))
        higher = level.join(above, "parent").where("before < turn").groupBy("rule_id").agg((F.max("upper") + 1).alias("higher"))
        after = written(level.join(higher, "rule_id", "left").select("rule_id", "family_id", "parent", "turn", F.coalesce("higher", F.lit(0)).alias("level")))
        same = after.select("rule_id", "level").exceptAll(level.select("rule_id", "level")).isEmpty()
        delete(level)
        level = after
        if same:
            return df.join(level.select("rule_id", "level"), "rule_id")


KEY = ["scope_id", "family_id", "doc_id", "section_number", "clause_key"]


def bulk_run(rules: DataFrame, sections: DataFrame, articles: DataFrame, definitions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, actions) of one run over all documents; both are written tables.

    Candidates have ``turn`` and the columns of ``scan``. A rule that inherits its scope
    sees only the sections that its parent family has linked by then. Actions are one row
    for each key of an active scope: ``create`` (active if the tier is high, else
    pending), ``keep``, ``unlink`` for stored links that no rule finds any more, and
    ``skip`` for found ones that were unlinked before. Links of other scopes stay as
    they are.
    """
    rules = written(in_order(written(latest_rules(rules))))
    raw = written(scan(rules.drop("turn", "parent", "level"), sections, articles, definitions).join(rules.select("rule_id", "turn", "parent", "level"), "rule_id"))
    stored = links.withColumn("clause_key", F.coalesce(F.nullif(F.trim("clause_key"), F.lit("")), F.lit(WHOLE)))
    gone = stored.where("status = 'unlinked'").select(*KEY).distinct()
    place = ["doc_id", "section_number"]
    done = []
    for level in range((rules.agg(F.max("level")).first()[0] or 0) + 1):
        now = raw.where(F.col("level") == level)
        free = now.where("parent is null")
        if level or not now.where("parent is not null").isEmpty():
            bound = now.where("parent is not null")
            # What the parent has linked by the rule's turn: by its earlier rules of this run, and by stored links of scopes without such a rule.
            earlier = rules.select(F.col("rule_id").alias("child"), "parent", F.col("turn").alias("at")).where("parent is not null").join(rules.select(F.col("family_id").alias("parent"), "scope_id", F.col("turn").alias("before"), F.col("rule_id").alias("by")), "parent").where("before < at")
            own = [x.where("tier <> 'low'").join(gone.hint("merge"), KEY, "left_anti").select(F.col("rule_id").alias("by"), *place) for x in done]
            scope = None
            for x in own:
                scope = x if scope is None else scope.unionByName(x)
            kept = stored.where("status <> 'unlinked'").select(F.col("family_id").alias("parent"), "scope_id", *place)
            kept = kept.join(rules.where("parent is not null").select("parent", F.col("rule_id").alias("child")), "parent").join(earlier.select("child", "scope_id"), ["child", "scope_id"], "left_anti").select(F.col("child").alias("rule_id"), *place)
            allowed = kept if scope is None else kept.unionByName(scope.join(earlier.select("child", "by"), "by").select(F.col("child").alias("rule_id"), *place))
            free = free.unionByName(bound.join(allowed.distinct().hint("merge"), ["rule_id", *place], "left_semi").select(*free.columns))
        done.append(written(free))
    candidates = done[0]
    for x in done[1:]:
        candidates = candidates.unionByName(x)
    candidates = written(candidates.drop("parent", "level"))
    linkable = candidates.where("tier <> 'low'").groupBy(*KEY).agg(F.max_by(F.struct("rule_id", "version", "confidence", "tier"), F.struct("confidence", "rule_id")).alias("x")).select(*KEY, "x.*", F.lit(True).alias("found"))
    scopes = rules.select("scope_id", "family_id").distinct()
    order = W.partitionBy(*KEY).orderBy(F.col("status") == "unlinked", "link_id")
    have = stored.join(scopes, ["scope_id", "family_id"], "left_semi").withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*KEY, "link_id", "status")
    both = linkable.join(have, KEY, "full")
    action = (
        F.when(F.col("found") & F.col("link_id").isNull(), "create").when(F.col("found") & (F.col("status") == "unlinked"), "skip").when(F.col("found"), "keep").when(F.col("status") != "unlinked", "unlink")
    )
    new_id = F.sha2(F.concat_ws("|", *KEY), 256)
    status = F.when(action == "create", F.when(F.col("tier") == "high", "active").otherwise("pending_review")).when(action == "unlink", "unlinked").otherwise(F.col("status"))
    actions = both.select(*KEY, F.coalesce("link_id", new_id).alias("link_id"), action.alias("action"), status.alias("status"), "rule_id", "version", "confidence", "tier").where("action is not null")
    actions = written(actions)
    delete(raw, rules, *done)
    return candidates, actions


def applied(links: DataFrame, actions: DataFrame) -> DataFrame:
    """The stored links after a run: created ones are added, unlinked ones marked; a rerun with the same rules changes nothing."""
    change = actions.where("action = 'unlink'").select("link_id", F.lit("unlinked").alias("_new"))
    old = links.join(change, "link_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    names = ["link_id", *KEY, "status"]
    return old.select(*names).unionByName(actions.where("action = 'create'").select(*names))


def run_conflicts(candidates: DataFrame, links: DataFrame, matrix: DataFrame) -> DataFrame:
    """(rule_id, doc_id, section_number, other_family, policy): conflicts of a candidate with active links and with rules before its own.

    Families of a section are distinct and at most as many as there are rules.
    """
    own = candidates.select("rule_id", "family_id", "turn", "doc_id", "section_number").distinct()
    stored = links.where("status = 'active'").select(F.col("family_id").alias("other_family"), F.lit(None).cast(own.schema["turn"].dataType).alias("other_turn"), "doc_id", "section_number")
    others = own.select(F.col("family_id").alias("other_family"), F.col("turn").alias("other_turn"), "doc_id", "section_number").unionByName(stored).distinct()
    pairs = own.join(others.hint("merge"), ["doc_id", "section_number"]).where((F.col("family_id") != F.col("other_family")) & (F.col("other_turn").isNull() | (F.col("other_turn") < F.col("turn"))))
    pairs = pairs.select("rule_id", "doc_id", "section_number", "other_family", F.least("family_id", "other_family").alias("a"), F.greatest("family_id", "other_family").alias("b")).distinct()
    return pairs.join(matrix.where(F.col("policy").isin(*CONFLICTING)).select("a", "b", "policy"), ["a", "b"]).select("rule_id", "doc_id", "section_number", "other_family", "policy")


def run_summary(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """(scope_id, candidates, high, medium, low, created, kept, unlinked) of each scope."""
    found = candidates.groupBy("scope_id").agg(F.count(F.lit(1)).alias("candidates"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")))
    made = actions.groupBy("scope_id").agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("create", "created"), ("keep", "kept"), ("unlink", "unlinked"))))
    return found.join(made, "scope_id", "full").fillna(0)


def _inputs(spark, d) -> dict[str, DataFrame]:
    """Rules and stored links that stand in for a rule book: phrases and scopes of each source, and of each language in it."""
    docs = v.table(spark, d, "documents").select("doc_id", F.col("lang"))
    s = v.sections(spark, d).join(docs.hint("merge"), "doc_id").select("doc_id", "section_number", "article_num", "heading", F.col("template_family").alias("src"), "lang")
    firsts = s.where("section_number = 1")
    starts = lambda c, n: F.array_join(F.slice(F.split(c, " "), 1, n), " ")
    empty = F.array().cast("array<string>")
    top = firsts.groupBy("src").agg(F.min("heading").alias("lo"), F.max("heading").alias("hi"))
    books = F.array(
        F.struct(F.lit(1).alias("version"), F.lit("published").alias("status"), F.array("lo").alias("phrases")),
        F.struct(F.lit(2).alias("version"), F.lit(None).cast("string").alias("status"), F.array(starts("hi", 2), F.col("lo")).alias("phrases")),
        F.struct(F.lit(3).alias("version"), F.lit("archived").alias("status"), F.array("hi").alias("phrases")),
    )
    parents = top.select("src", F.explode(books).alias("x")).select(
        F.concat_ws("#", "src", "x.version").alias("rule_id"), F.col("src").alias("family_id"), F.lit(None).cast("string").alias("scope_id"), "x.version", "x.status",
        F.lit(None).cast("string").alias("parent_family_id"), F.lit("corpus").alias("scope_mode"), "x.phrases", empty.alias("concepts"),
    )
    below = firsts.groupBy("src", "lang").agg(F.min("heading").alias("lo"))
    family = F.concat_ws(".", "src", "lang")
    children = below.select(
        F.concat_ws("#", family, F.lit("1")).alias("rule_id"), family.alias("family_id"), family.alias("scope_id"), F.lit(1).alias("version"), F.lit("draft").alias("status"),
        F.lit(None).cast("string").alias("parent_family_id"), F.lit("inherited").alias("scope_mode"), F.array(starts("lo", 1)).alias("phrases"),
        F.when(F.col("lang") == "de", F.array(F.left("lo", F.lit(3)))).otherwise(empty).alias("concepts"),
    )
    rules = parents.unionByName(children).withColumns({"granularity": F.lit("section"), "terms": empty, "term_phrases": empty})
    size = F.length("heading")
    link = lambda prefix, fam, status: (F.concat_ws("-", F.lit(prefix), "doc_id", "section_number").alias("link_id"), fam.alias("family_id"), fam.alias("scope_id"), "doc_id", "section_number", F.lit(WHOLE).alias("clause_key"), status.alias("status"))
    links = s.where(size % 3 == 0).select(*link("p", F.col("src"), F.when(size % 2 == 0, "active").otherwise("unlinked"))).unionByName(s.where(size % 5 == 0).select(*link("c", family, F.lit("pending_review"))))
    matrix = below.select(F.col("src").alias("a"), family.alias("b"), F.when(F.col("lang") == "en", "exclusive").when(F.col("lang") == "de", "warn").otherwise("shared_ok").alias("policy"))
    return {"rules": rules, "sections": s.select("doc_id", "section_number", "article_num", "heading"), "articles": v.articles(spark, d), "definitions": v.definitions(spark, d).select("doc_id", "term"), "links": links, "matrix": matrix}


def _run(spark, d) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    x = _inputs(spark, d)
    return *bulk_run(x["rules"], x["sections"], x["articles"], x["definitions"], x["links"]), x


_BOOK = (
    v.with_views("sections", "articles")
    + """, s AS (SELECT doc_id, section_number, article_num, heading, template_family AS src, lang, lower(trim(heading, ' ')) AS h, length(heading) AS size FROM sections JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
top AS (SELECT src, min(heading) AS lo, max(heading) AS hi FROM s WHERE section_number = 1 GROUP BY 1), below AS (SELECT src, lang, src || '.' || lang AS family, min(heading) AS lo FROM s WHERE section_number = 1 GROUP BY 1, 2),
r AS (SELECT src || '#2' AS rule_id, src AS family_id, src AS scope_id, 2 AS version, NULL AS parent, [array_to_string(string_split(hi, ' ')[1:2], ' '), lo] AS phrases, ''::VARCHAR AS concept FROM top
  UNION ALL SELECT family || '#1', family, family, 1, src, [string_split(lo, ' ')[1]], CASE WHEN lang = 'de' THEN left(lo, 3) ELSE '' END FROM below),
p AS (SELECT rule_id, i, phrases[i] AS value, lower(trim(phrases[i], ' ')) AS needle FROM r, unnest(range(1, 3)) AS t(i) WHERE i <= len(phrases) AND lower(trim(phrases[i], ' ')) <> ''),
x AS (SELECT DISTINCT needle, h FROM (SELECT DISTINCT needle FROM p) JOIN (SELECT DISTINCT h FROM s WHERE h <> '') ON contains(h, needle) OR 2 * len(list_intersect(regexp_split_to_array(h, '\\s+'), list_distinct(regexp_split_to_array(needle, '\\s+')))) >= len(list_distinct(regexp_split_to_array(needle, '\\s+')))),
m AS (SELECT rule_id, h, arg_min(CASE WHEN needle = h THEN 'exact' WHEN contains(h, needle) THEN 'substring' ELSE 'partial' END, (CASE WHEN contains(h, needle) THEN 0 ELSE 10 END) + i) AS match_type, arg_min(value, (CASE WHEN contains(h, needle) THEN 0 ELSE 10 END) + i) AS matched_value,
  max(CASE WHEN needle = h THEN 1.0 WHEN contains(h, needle) THEN 0.7 WHEN contains(needle, h) THEN 0.5 ELSE 0.3 END)::DOUBLE AS exact FROM x JOIN p USING (needle) GROUP BY 1, 2),
tok AS (SELECT *, trim(regexp_replace(lower(concept), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM r),
c0 AS (SELECT t.rule_id, family_id, scope_id, version, t.parent, doc_id, section_number, match_type, matched_value, exact, t.concept, a.concept AS actual, t.t, trim(regexp_replace(lower(coalesce(a.concept, '')), '[^a-z0-9]+', '_', 'g'), '_') AS act
  FROM m JOIN tok t USING (rule_id) JOIN s USING (h) LEFT JOIN articles a USING (doc_id, article_num)),
c1 AS (SELECT *, round(0.22::DOUBLE * (CASE WHEN concept = '' THEN 0.5 WHEN actual = concept THEN 1 ELSE 0 END)::DOUBLE + 0.28::DOUBLE * exact + 0.13::DOUBLE * 0.5 + 0.10::DOUBLE * 0.5 + 0.09::DOUBLE * 0.5 + 0.08::DOUBLE * 0.5 + 0.10::DOUBLE * 0.5, 6) AS confidence
  FROM c0 WHERE concept = '' OR (act <> '' AND t <> '' AND (contains(act, t) OR contains(t, act)))),
c2 AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM c1),
links AS (SELECT 'p-' || doc_id || '-' || section_number AS link_id, src AS family_id, doc_id, section_number, CASE WHEN size % 2 = 0 THEN 'active' ELSE 'unlinked' END AS status FROM s WHERE size % 3 = 0
  UNION ALL SELECT 'c-' || doc_id || '-' || section_number, src || '.' || lang, doc_id, section_number, 'pending_review' FROM s WHERE size % 5 = 0),
c AS (SELECT * FROM c2 WHERE parent IS NULL UNION ALL SELECT k.* FROM c2 k WHERE EXISTS (SELECT 1 FROM c2 u WHERE u.family_id = k.parent AND u.tier <> 'low' AND u.doc_id = k.doc_id AND u.section_number = k.section_number
  AND NOT EXISTS (SELECT 1 FROM links l WHERE l.family_id = u.family_id AND l.doc_id = u.doc_id AND l.section_number = u.section_number AND l.status = 'unlinked'))),
a AS (SELECT coalesce(c.family_id, l.family_id) AS scope_id, coalesce(c.doc_id, l.doc_id) AS doc_id, coalesce(c.section_number, l.section_number) AS section_number,
  CASE WHEN c.rule_id IS NOT NULL AND link_id IS NULL THEN 'create' WHEN c.rule_id IS NOT NULL AND status = 'unlinked' THEN 'skip' WHEN c.rule_id IS NOT NULL THEN 'keep' WHEN status <> 'unlinked' THEN 'unlink' END AS action, c.rule_id, tier, status AS old
  FROM (SELECT * FROM c WHERE tier <> 'low') c FULL JOIN links l ON l.family_id = c.family_id AND l.doc_id = c.doc_id AND l.section_number = c.section_number)
"""
)
register(
    "rule_scan",
    lambda spark, d: (lambda x: scan(latest_rules(x["rules"]), x["sections"], x["articles"], x["definitions"]).select("rule_id", "doc_id", "section_number", "match_type", "matched_value", "confidence", "tier"))(_inputs(spark, d)),
    _BOOK + "SELECT rule_id, doc_id, section_number, match_type, matched_value, confidence, tier FROM c2",
)
register(
    "bulk_run_actions",
    lambda spark, d: _run(spark, d)[1].select("scope_id", "doc_id", "section_number", "action", "status", "rule_id"),
    _BOOK + "SELECT scope_id, doc_id, section_number, action, CASE action WHEN 'create' THEN CASE WHEN tier = 'high' THEN 'active' ELSE 'pending_review' END WHEN 'unlink' THEN 'unlinked' ELSE old END AS status, rule_id FROM a WHERE action IS NOT NULL",
)
register(
    "bulk_run_conflicts",
    lambda spark, d: (lambda c, a, x: run_conflicts(c, x["links"], x["matrix"]))(*_run(spark, d)),
    _BOOK
    + """, o AS (SELECT DISTINCT rule_id, family_id, parent, doc_id, section_number FROM c), e AS (SELECT family_id, doc_id, section_number, CASE WHEN contains(family_id, '.') THEN 1 ELSE 0 END AS depth FROM o UNION SELECT family_id, doc_id, section_number, -1 FROM links WHERE status = 'active'),
k AS (SELECT src AS a, family AS b, CASE lang WHEN 'en' THEN 'exclusive' WHEN 'de' THEN 'warn' ELSE 'shared_ok' END AS policy FROM below)
SELECT DISTINCT o.rule_id, o.doc_id, o.section_number, e.family_id AS other_family, policy FROM o JOIN e ON o.doc_id = e.doc_id AND o.section_number = e.section_number AND o.family_id <> e.family_id
  AND (e.depth = -1 OR (e.depth, e.family_id) < (CASE WHEN contains(o.family_id, '.') THEN 1 ELSE 0 END, o.family_id)) JOIN k ON k.a = least(o.family_id, e.family_id) AND k.b = greatest(o.family_id, e.family_id) WHERE policy IN ('exclusive', 'warn')""",
)
register(
    "bulk_run_summary",
    lambda spark, d: (lambda c, a, x: run_summary(c, a))(*_run(spark, d)),
    _BOOK
    + """, f AS (SELECT scope_id, count(*) AS candidates, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'low') AS low FROM c GROUP BY 1),
g AS (SELECT scope_id, count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'unlink') AS unlinked FROM a WHERE action IS NOT NULL GROUP BY 1)
SELECT coalesce(f.scope_id, g.scope_id) AS scope_id, coalesce(candidates, 0) AS candidates, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(created, 0) AS created, coalesce(kept, 0) AS kept, coalesce(unlinked, 0) AS unlinked FROM f FULL JOIN g ON f.scope_id = g.scope_id""",
)
