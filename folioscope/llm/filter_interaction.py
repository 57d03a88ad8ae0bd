"""Filter interaction audit: what each filter removes in every order in which the filters may run.

One projection judges each text by the plain filters and writes its length and the
hashes of its successive blocks. Exact copies are found by refining a partition: rows
of equal length form a class, each round splits the classes by the next block's hash
and drops those of one row, and what is left is compared by its whole text. A row is
then a mask of the filters that it fails; the masks are counted for each part, and all
orders are read off those counts.

Edge cases: null text counts as empty, null parts as ''. Null and empty texts are
copies of one another. A row without a doc_id is in no class: it is nobody's copy and
nobody is its copy. Repeated rows (equal id and text) aren't copies of each other, but
all of them are copies of a smaller id with that text. Texts of any length are judged
and compared whole. Of several labels of an id the largest counts, and each row of a
repeated id has them. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .sketches import among

#: Code points of the first block; each further one is ``GROWTH`` times as long, so that seven cover any string.
BLOCK, GROWTH, BLOCKS = 256, 16, 7
#: A class is hot with more than 1 / HOT of all rows, so that there are fewer hot ones than HOT.
HOT = 10_000
COPY = "E"


def words(body: Column) -> Column:
    return F.filter(F.split(body, session.SPACE_CLASS + "+"), lambda w: w != "")


#: Name and failure of each plain filter, from the columns body, words and n_words.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 50 * F.col("n_words"),
    "C": lambda: 100 * F.length(F.regexp_replace("body", "[^A-Z]+", "")) > 3 * F.length("body"),
    "D": lambda: F.col("body").rlike("[#$%&*|]"),
}


def block_hashes(body: Column) -> Column:
    """The hash of each block of the text; a block begins where the one before ends."""
    starts = [BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS)]
    return F.array_compact(F.array(*(F.when(F.length(body) > s, F.xxhash64(F.substring(body, s + 1, BLOCK * GROWTH**k))) for k, s in enumerate(starts))))


def refined(cls: Column, block: Column, bits: int) -> Column:
    """The class of rows of one class and one block; equal numbers for different ones only leave more to compare."""
    h = F.xxhash64(cls, block)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def last_class(bits: int) -> Column:
    return F.aggregate("blocks", F.col("length"), lambda c, b: refined(c, b, bits))


def by_class(rows: DataFrame, classes: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` joined with ``classes`` (cls, n, ...) by class: the hot ones, of which fewer than HOT can be, without a shuffle."""
    most = max(1, total // HOT)
    hot, others = F.broadcast(classes.where(F.col("n") > most)), classes.where(F.col("n") <= most)
    rest = rows.join(hot.select("cls"), "cls", "left_anti").join(others, "cls", how)
    return rows.join(hot, "cls", "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def shared_classes(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(cls): the classes of two rows or more after the last block of ``rows`` (length, blocks), as a written table.

    Rounds grow with the logarithm of the longest text that shares its length and all
    its earlier blocks with another one.
    """
    left, k = rows.select(F.col("length").alias("cls"), "blocks"), 0
    written = None
    while True:
        counts = session.kept_table(left.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        most, total = left.agg(F.max(F.size("blocks")), F.count(F.lit(1))).first()
        if written is not None and k >= (most or 0) or not total:
            if written is not None:
                session.drop(written)
            return counts
        some = by_class(left, counts, total, "left_semi")
        some = some.select(F.when(F.size("blocks") > k, refined(F.col("cls"), F.get("blocks", F.lit(k)), bits)).otherwise(F.col("cls")).alias("cls"), "blocks")
        after = session.kept_table(some)
        session.drop(counts, *([written] if written is not None else []))
        left = written = after
        k += 1


def judged(docs: DataFrame, part: str = "lang", filters: dict[str, Callable[[], Column]] = FILTERS, bits: int = 64) -> DataFrame:
    """(doc_id, part, mask): bit i is the i-th filter's failure, the last bit that of a copy. A written table.

    ``bits`` narrows the class numbers, for tests of what happens when they collide.
    """
    base = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("body"))

    def measured(df: DataFrame) -> DataFrame:
        df = df.withColumn("words", words(F.col("body"))).withColumn("n_words", F.size("words"))
        bit = sum((F.when(failure(), F.lit(1 << i)).otherwise(F.lit(0)) for i, failure in enumerate(filters.values())), F.lit(0))
        return df.withColumns({"mask": bit, "length": F.length("body").cast("long"), "blocks": block_hashes(F.col("body"))})

    rows = session.kept_table(measured(base).select("doc_id", "part", "mask", "length", "blocks").withColumn("cls", last_class(bits)))
    named = rows.where("doc_id is not null")
    shared = shared_classes(named, bits)
    texts = base.where("doc_id is not null").select(F.col("doc_id").alias("id"), "part", "body")
    texts = texts.withColumns({"length": F.length("body").cast("long"), "blocks": block_hashes(F.col("body"))})
    # The class number takes the place of the id in the filter of rows, so that only what shares a class is compared.
    texts = among(texts.select("id", "part", "body", last_class(bits).alias("doc_id")), shared.select(F.col("cls").alias("doc_id")))
    exact = texts.groupBy("doc_id", "body").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))
    found = session.kept_table(exact.groupBy(F.col("doc_id").alias("cls")).agg(F.sum("m").alias("n"), F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")).where("n > 1"))
    one = found.where("texts = 1").drop("texts")
    copy = 1 << len(filters)
    marked = by_class(named, one, named.count(), "left").select("doc_id", "part", F.when(F.col("first") < F.col("doc_id"), F.col("mask") + copy).otherwise(F.col("mask")).alias("mask"), "cls")
    mixed = found.where("texts > 1").select(F.col("cls").alias("doc_id"))
    if not mixed.isEmpty():  # numbers collided: these classes' rows are judged again, beside their text
        again = measured(among(texts, mixed).select(F.col("doc_id").alias("cls"), F.col("id").alias("doc_id"), "part", "body"))
        firsts = exact.select(F.col("doc_id").alias("cls"), "body", "first", "m")
        hot = max(1, again.count() // HOT)
        exactly = lambda side, key: again.join(side, ["cls", "body"], key)
        frequent = F.broadcast(firsts.where(F.col("m") > hot).drop("m"))
        both = exactly(frequent, "inner").unionByName(exactly(frequent.select("cls", "body"), "left_anti").join(firsts.where(F.col("m") <= hot).drop("m"), ["cls", "body"]))
        both = both.join(mixed.withColumnRenamed("doc_id", "cls"), "cls", "left_semi").select("doc_id", "part", F.when(F.col("first") < F.col("doc_id"), F.col("mask") + copy).otherwise(F.col("mask")).alias("mask"))
        marked = marked.join(mixed.withColumnRenamed("doc_id", "cls"), "cls", "left_anti").drop("cls").unionByName(both)
    out = session.kept_table(marked.select("doc_id", "part", "mask").unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask")))
    session.drop(rows, shared, found)
    return out


def audit(masks: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step.

    The counts of a part are one row for each mask, at most two to the number of
    filters; a list of all steps of all orders is exploded beside them.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = (
        masks.join(marks, F.col("doc_id") == F.col("id"), "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    )
    orders = ["".join(o) for o in itertools.permutations(letters)]
    bit = {c: 1 << i for i, c in enumerate(letters)}
    steps = [{"filter_order": o, "step": k + 1, "bit": bit[c], "before": sum(bit[b] for b in o[:k])} for o in orders for k, c in enumerate(o)]
    df = counts.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")))
    mask, here, before = F.col("mask"), F.col("s.bit"), F.col("s.before")
    fails = mask.bitwiseAND(here) != 0
    gone = mask.bitwiseAND(before) != 0
    of = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(F.lit(0))).cast("long")
    # Among the k filters that a document fails, each comes first in one of k orders.
    share = F.element_at(F.array(*(F.lit(len(orders) // k) for k in range(1, len(letters) + 1))), F.greatest(F.bit_count(mask), F.lit(1)))
    return df.groupBy("part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step")).agg(
        of(~fails & ~gone).alias("kept"),
        of(fails & ~gone).alias("removed"),
        of(fails & gone).alias("redundant"),
        of(mask == here).alias("unique_fails"),
        of(fails & ~gone, "good").alias("good_lost"),
        of(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(judged(session.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"), "".join(FILTERS) + COPY)


_SUM = "CAST(sum(CASE WHEN {} THEN {} ELSE 0 END) AS BIGINT)"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
f AS (
  SELECT d.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false) AS e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) v, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) w,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) x, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) y, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) z
  WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
t AS (SELECT m.*, filter_order, CAST(step AS INT) AS step, bit, coalesce(before, 0)::INT AS before FROM m, s)
SELECT part, filter_order, step, {_SUM.format("mask & (bit | before) = 0", "n")} AS kept, {_SUM.format("mask & bit <> 0 AND mask & before = 0", "n")} AS removed,
  {_SUM.format("mask & bit <> 0 AND mask & before <> 0", "n")} AS redundant, {_SUM.format("mask = bit", "n")} AS unique_fails,
  {_SUM.format("mask & bit <> 0 AND mask & before = 0", "good")} AS good_lost, {_SUM.format("mask & bit <> 0 AND mask & before = 0", "toxic")} AS toxic_lost,
  {_SUM.format("mask & bit <> 0", "n * (120 // bit_count(mask))")} AS shapley
FROM t GROUP BY part, filter_order, step
"""
