"""Quality rules: a threshold table compiled into one Spark projection.

Each rule is a row (name, count, bound, per): it fails where
``100 * count > bound * per`` (or ``<`` for least bounds). All counts are native
expressions over one split of the text; there is no shuffle and no user function.

Edge cases: null and empty text have no words, so every count is 0, the length
rule fails and the row is not kept. Texts of any length are judged whole. Rows are
judged one by one, so repeated rows get equal verdicts; an empty table gives an
empty result. Other columns pass through; an input column that has the name of a
computed one is replaced by it.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 5
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "als am an auf aus bei das dem den der des die ein eine er es für im in ist mit nach nicht sich sie und von zu zum "
    "au aux avec ce dans de des du elle en est et il je la le les ne ou par pas pour que qui sur un une "
    "al como con de del el en es la las lo los más no o para por que se sin su un una y"
).split()


class Rule(NamedTuple):
    """Fails where 100 * count is over ``most`` * per, or under ``least`` * per; ``over``: only for more words than that."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None
    over: int = 0


BASE_RULES = (
    Rule("too_few_words", "n_words", "one", least=1000),
    Rule("repeats_itself", "n_repeat_words", "n_words", most=20),
)
RULES = (
    Rule("short_words", "word_chars", "n_words", least=150),
    Rule("long_words", "word_chars", "n_words", most=3000),
    Rule("symbols", "n_symbols", "n_words", most=25),
    Rule("exclamations", "n_marks", "n_words", most=25),
    Rule("no_stop_words", "n_stop_words", "n_words", least=1, over=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
)


def failed(rule: Rule) -> Column:
    per = F.lit(1) if rule.per == "one" else F.col(rule.per)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (100 * F.col(rule.count) < rule.least * per)
    if rule.most is not None:
        out = out | (100 * F.col(rule.count) > rule.most * per)
    return out & (F.col("n_words") > rule.over) if rule.over else out


def repeat_words(words: Column, n_words: Column) -> Column:
    """Words in windows of 5 that occur twice or more; sorts window hashes, so n log n."""
    starts = F.when(
        n_words >= WINDOW,
        F.array_sort(F.transform(F.sequence(F.lit(1), (n_words - WINDOW + 1).cast("int")), lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i")))),
    )
    return starts


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, session.SPACES, "")) > 0)
    df = docs.withColumns(
        {
            "_words": F.filter(F.split(body, session.SPACE_CLASS + "+"), lambda w: w != ""),
            "_lines": lines,
            "word_chars": F.length(F.translate(body, session.SPACES, "")).cast("long"),
            "n_symbols": (chars - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_marks": (chars - F.length(F.translate(body, MARKS, ""))).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "_windows": repeat_words(F.col("_words"), F.size("_words")),
        }
    )
    same = lambda x, j: F.coalesce(F.get(F.col("_windows"), j)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("_windows", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_words", "_lines", "_windows")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows with their counts, ``failed_rules``, ``base_failed`` and ``kept``."""
    either = lambda some: reduce(lambda a, b: a | b, map(failed, some), F.lit(False))
    names = F.array_compact(F.array(*(F.when(failed(r), F.lit(r.name)) for r in (*base, *rules))))
    return with_counts(docs).withColumns({"base_failed": either(base), "kept": ~either((*base, *rules)), "failed_rules": names})


def passing(docs: DataFrame) -> DataFrame:
    """The rows that pass, as they came, whatever the names of their columns.

    The verdict picks the row or nothing before any filter, so that no condition on the
    counts is pushed below the projections and written out there anew for each use.
    """
    held = docs.select(F.struct("*").alias("_all"), "text")
    rows = judged(held).select(F.explode_outer(F.when(F.col("kept"), F.array("_all"))).alias("_all"))
    return rows.where("_all is not null").select(*(F.col("_all").getField(c).alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir).select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SPACE_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {_SPACE_CHARS}, '')) > 0) AS lines FROM d),
w AS (SELECT doc_id, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS win FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i) WHERE len(words) >= {WINDOW}),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, {_SPACE_CHARS}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(translate(text, '{MARKS}', '')) AS BIGINT) AS n_marks,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * word_chars < 150 * n_words OR 100 * word_chars > 3000 * n_words OR 100 * n_symbols > 25 * n_words
    OR 100 * n_marks > 25 * n_words OR (n_words > 50 AND 100 * n_stop_words < n_words) OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b
"""
