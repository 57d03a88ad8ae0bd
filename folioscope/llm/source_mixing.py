"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources by code point (null last) weigh ``weights``, repeating, and share
``boost`` times all words; a target stops at ``most`` times its source's words and
the excess is shared again by weight. That is the level L at which
``sum(min(cap, weight * L))`` meets the total, found on the table of sources.

Which documents: a hash orders each source's documents and deals them into
``BLOCKS`` blocks. A source takes every document ``base`` times (its whole passes)
and, for the rest of its target, the leading blocks, the leading documents of the
block in which the target falls, and from the next few hundred documents those that
fill the remaining gap, largest first. So prefix sums run over blocks, and over
documents only inside the one block where the target falls. A source of at most
``SMALL`` documents takes instead the subset, first and second copies counted, whose
sum comes nearest its target; sums a thousandth of the target apart or less are held
as one while they are built up.

Where they go: a multivariate hypergeometric splitting tree. The root holds each
source's exact quota of taken blocks; each node draws, source by source, how many of
its blocks go left (an exact draw: the largest of log weight plus Gumbel noise), so
quotas stay exact at every level and each output shard ends up with its share of
every source. Each source's blocks, permuted by hash, fill the shards' quotas in
turn, so shards draw disjoint blocks; within a shard ``order_key`` gives the local
shuffle. All noise is hashed from the seed: reruns agree.

Edge cases: null text has size 0 and is never taken short of a whole pass (its taken
words are 0 anyway); a null source is a source of its own; rows with equal doc_id
share their fate; null doc_id hashes like any other value. Empty tables give empty
results. Texts of any length are counted whole. Other columns pass through, whatever
their names, but for inputs named like an output, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import session

WEIGHTS = (5.0, 2.0, 1.0)
BLOCKS_LOG = 10
BLOCKS = 1 << BLOCKS_LOG
#: Documents after the boundary that may fill the gap to the target.
FILL = 256
#: Sources of so many documents at most take their nearest subset; two bits a document in a long.
SMALL = 31
#: The columns that the mix reads.
READ = ("doc_id", "source", "text")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), session.SPACE_CLASS + "+"), "")).cast("long")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size, the order hash ``_h`` (63 bits) and its block."""
    return docs.withColumns({"size": word_count(F.col("text")), "_h": F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 1)}).withColumn("_b", F.shiftright("_h", 63 - BLOCKS_LOG).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, boost: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, weight, target)."""
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("rank", F.row_number().over(by_code_point))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    df = df.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    upto = W.orderBy("level", "rank").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"total": boost * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "capped": F.sum("cap").over(upto), "weight_upto": F.sum("weight").over(upto)})
    rest = F.col("all_weight") - F.col("weight_upto")
    full = F.when(F.col("capped") + F.col("level") * rest <= F.col("total"), F.struct("level", "rank", "capped", rest.alias("rest")))
    df = df.withColumn("full", F.max(full).over(everything))
    level = F.when(F.col("full").isNull(), F.col("total") / F.col("all_weight")).when(F.col("full.rest") > 0, (F.col("total") - F.col("full.capped")) / F.col("full.rest"))
    return df.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "rank", "weight", "target")


def _noise(*parts: Column) -> Column:
    """Gumbel noise hashed from ``parts``."""
    u = (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _hypergeometric(pop: Column, good: Column, draws: Column, *key: Column) -> Column:
    """How many of ``draws`` from ``pop`` are among the ``good``: an exact draw by the Gumbel-max rule."""
    low, high = F.greatest(F.lit(0), draws - (pop - good)), F.least(draws, good)

    def step(s: Column, x: Column) -> Column:
        ratio = ((good - x + 1) * (draws - x + 1)).cast("double") / (x * (pop - good - draws + x)).cast("double")
        weight = F.when(x == low, F.lit(0.0)).otherwise(s["w"] + F.log(ratio))
        score = weight + _noise(*key, x)
        return F.struct(weight.alias("w"), F.greatest(score, s["best"]).alias("best"), F.when(score > s["best"], x).otherwise(s["x"]).alias("x"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("x"))
    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["x"])


def _draw(*key: Column):
    def draw(s: Column, q: Column) -> Column:
        x = _hypergeometric(s["pop"], q, s["draws"], *key, s["i"])
        # An array of one, so that the draw is made once for each source.
        return F.element_at(F.transform(F.array(x), lambda x: F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["draws"] - x).alias("draws"), (s["pop"] - q).alias("pop"), (s["i"] + 1).alias("i"))), 1)

    return draw


def _shifted(blocks: Column, by: int) -> Column:
    return F.transform(blocks, lambda v: v + by)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """One row with ``quotas`` array<int> to (shard, quotas) for 2**levels shards."""
    nodes = quotas.select(F.lit(0).alias("node"), "quotas")
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0), lambda s, q: s + q)
        start = F.struct(F.array().cast(T.ArrayType(T.IntegerType())).alias("out"), F.ceil(F.col("total") / 2).cast("int").alias("draws"), F.col("total").alias("pop"), F.lit(0).alias("i"))

        left = F.aggregate("quotas", start, _draw(F.lit(seed), F.lit(level), F.col("node")), lambda s: s["out"])
        nodes = nodes.withColumn("total", total).withColumn("left", left)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.*")
    return nodes.withColumnRenamed("node", "shard")


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, _h, _b), written once: all that planning reads, so texts are read once."""
    return session.kept_table(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))


def nearest_subsets(d: DataFrame, src: DataFrame) -> DataFrame:
    """(source, picks, twice): for each source in ``src`` (few documents), the hashes of those taken and of those taken twice."""
    mine = src.select(F.col("source").alias("_source"), "target")
    rows = d.join(F.broadcast(mine), d["source"].eqNullSafe(F.col("_source"))).where("size > 0")  # a row for each source
    rows = rows.groupBy("source", "_h").agg(F.sum("size").alias("size"), F.first("target").alias("target"))
    own = rows.groupBy("source").agg(F.first("target").alias("target"), F.sort_array(F.collect_list(F.struct("size", "_h")), asc=False).alias("docs"))
    step = F.greatest(F.lit(1.0), F.col("target") / 1000)
    state = lambda total, mask: F.struct(total.alias("sum"), mask.alias("mask"))

    def grow(sums: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * x["i"])
        taken = lambda k: F.transform(sums, lambda s: state(s["sum"] + k * x["size"], s["mask"] + k * bit))
        more = F.concat(sums, taken(1), taken(2))
        near = F.array_sort(F.filter(more, lambda s: s["sum"] <= F.col("target") + 20 * step))
        # An array of one, so that the sums are sorted once.
        thin = lambda a: F.filter(a, lambda s, i: (i == 0) | (F.floor(s["sum"] / step) != F.floor(F.get(a, i - 1)["sum"] / step)))
        return F.element_at(F.transform(F.array(near), thin), 1)

    start = F.array(state(F.lit(0).cast("long"), F.lit(0).cast("long")))
    sums = F.aggregate(F.transform("docs", lambda x, i: F.struct(x["size"].alias("size"), i.alias("i"))), start, grow)
    best = F.array_min(F.transform(sums, lambda s: F.struct(F.abs(s["sum"] - F.col("target")).alias("off"), s["mask"].alias("mask"))))
    own = own.withColumn("mask", best["mask"])
    times = lambda i: F.call_function("shiftrightunsigned", F.col("mask"), 2 * i).bitwiseAND(F.lit(3).cast("long"))
    of = lambda least: F.transform(F.filter("docs", lambda x, i: times(i) >= least), lambda x: x["_h"])
    return own.select(F.col("source").alias("_source3"), of(1).alias("picks_of_few"), of(2).alias("twice"))


def mix_plan(d: DataFrame, weights: tuple[float, ...] = WEIGHTS, boost: float = 1.5, most: int = 2, levels: int = 4, seed: int = 17) -> DataFrame:
    """From ``sized`` rows, one row for each source: size, target, base passes, what else it takes, and the shard of each taken block.

    Window and array work here is over sources times blocks; documents enter only
    as sums by block and, where the target falls, as one block's (hash, size).
    """
    d = d.select("source", "size", "_h", "_b")
    blocks = session.kept(d.groupBy("source", "_b").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    counts = blocks.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    src = targets(counts.drop("n_docs"), weights, boost, most).join(counts.select(F.col("source").alias("_s"), (F.col("n_docs") <= SMALL).alias("few")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    size = F.col("source_size")
    src = src.withColumn("base", F.when(F.col("few"), 0).otherwise(F.least(F.lit(most), F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0))).cast("int"))
    src = src.withColumn("rest", F.when(~F.col("few") & (F.col("base") < most), F.greatest(F.lit(0.0), F.col("target") - F.col("base") * size)).otherwise(0.0))
    src = session.kept(src)

    mine = src.select(F.col("source").alias("_source"), "rest")
    upto = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    b = blocks.join(mine, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    b = b.withColumns({"cum": F.sum("size").over(upto), "cum_n": F.sum("n").over(upto)})
    before, before_n = F.col("cum") - F.col("size"), F.col("cum_n") - F.col("n")
    whole = W.partitionBy("source")
    falls = (F.col("cum") > F.col("rest")) & (before <= F.col("rest"))
    b = b.withColumn("edge", F.max(F.when(falls, F.struct(F.col("_b").alias("b"), before.alias("before"), before_n.alias("n")))).over(whole))
    region = b.where((F.col("_b") >= F.col("edge.b")) & (before_n < F.col("edge.n") + FILL) & (F.col("rest") > 0)).select(F.col("source").alias("_source"), F.col("_b").alias("_block"), F.col("edge.before").alias("before"), "rest")
    near = d.join(region, d["source"].eqNullSafe(F.col("_source")) & (d["_b"] == F.col("_block"))).select("source", "_h", "size", "before", "rest")
    in_order = W.partitionBy("source").orderBy("_h", "size")
    near = near.withColumn("reach", F.col("before") + F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    near = near.withColumn("lead", F.col("reach") <= F.col("rest"))
    near = near.withColumn("after", F.when(~F.col("lead"), F.row_number().over(W.partitionBy("source", "lead").orderBy("_h", "size"))))
    found = near.groupBy("source").agg(
        F.max(F.when(F.col("lead"), F.col("_h"))).alias("upto"),
        (F.first("rest") - F.coalesce(F.max(F.when(F.col("lead"), F.col("reach"))), F.first("before"))).alias("gap"),
        F.sort_array(F.collect_list(F.when((F.col("after") <= FILL) & (F.col("size") > 0), F.struct("size", "_h"))), asc=False).alias("near"),
    )
    fits = F.aggregate(
        "near",
        F.struct(F.col("gap").cast("double").alias("gap"), F.array().cast("array<bigint>").alias("took")),
        lambda s, x: F.when(x["size"] <= s["gap"], F.struct((s["gap"] - x["size"]).alias("gap"), F.concat(s["took"], F.array(x["_h"])).alias("took"))).otherwise(s),
    )
    found = found.withColumn("fit", fits)
    left = F.filter("near", lambda x: ~F.array_contains(F.col("fit.took"), x["_h"]))
    found = found.withColumn("last", F.array_min(left))
    picks = F.when(F.col("last.size") < 2 * F.col("fit.gap"), F.concat("fit.took", F.array("last._h"))).otherwise(F.col("fit.took"))
    found = found.select(F.col("source").alias("_source"), "upto", picks.alias("picks"))

    edges = b.groupBy("source").agg(F.sort_array(F.collect_list("_b")).alias("own"), F.first("edge.b").alias("edge_b")).withColumnRenamed("source", "_source2")
    plan = src.join(found, src["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    plan = plan.join(edges, plan["source"].eqNullSafe(F.col("_source2")), "left").drop("_source2")
    plan = plan.join(nearest_subsets(d, src.where("few")), plan["source"].eqNullSafe(F.col("_source3")), "left").drop("_source3")
    plan = plan.withColumns({"picks": F.coalesce("picks_of_few", "picks"), "twice": F.coalesce("twice", F.array().cast("array<bigint>"))}).drop("picks_of_few", "few")
    plan = plan.withColumns({"upto": F.coalesce("upto", F.when((F.col("rest") > 0) & (F.col("edge_b") > 0), F.shiftleft(F.col("edge_b").cast("long"), 63 - BLOCKS_LOG) - 1), F.lit(-1).cast("long")), "picks": F.coalesce("picks", F.array().cast("array<bigint>"))})
    block_of = lambda hashes: F.transform(hashes, lambda x: F.shiftright(x, 63 - BLOCKS_LOG).cast("int"))
    extra = F.array_distinct(F.concat(F.filter("own", lambda x: x <= F.shiftright("upto", 63 - BLOCKS_LOG)), block_of("picks")))
    passes = [F.when(F.col("base") > p, F.col("own")).when(F.col("base") == p, extra).otherwise(F.array_distinct(block_of("twice")) if p == 1 else F.array().cast("array<int>")) for p in range(most)]
    plan = plan.withColumn("taken_blocks", F.flatten(F.array(*(_shifted(x, p * BLOCKS) for p, x in enumerate(passes)))))
    plan = session.kept(plan.drop("own", "edge_b"))

    root = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.size("taken_blocks").alias("q")))), lambda x: x["q"]).alias("quotas"))
    leaves = split_quotas(root, levels, seed).select("shard", F.posexplode("quotas").alias("_i", "q"))
    slots = leaves.groupBy((F.col("_i") + 1).alias("_rank")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "q"))), lambda x: F.array_repeat(x["shard"], x["q"]))).alias("slots"))
    plan = plan.join(slots, F.col("rank") == F.col("_rank"), "left").drop("_rank")
    permuted = F.transform(F.array_sort(F.transform("taken_blocks", lambda x: F.struct(F.xxhash64(x, F.col("rank"), F.lit(seed)).alias("h"), x.alias("x")))), lambda x: x["x"])
    # Written before it is searched below; else the optimiser sorts anew for each search.
    plan = session.kept(plan.withColumn("permuted", permuted))
    shard_of = F.transform(F.sequence(F.lit(0), F.lit(most * BLOCKS - 1)), lambda x: F.get(F.col("slots"), F.array_position("permuted", x).cast("int") - 1))
    return session.kept(plan.withColumn("shard_of", shard_of).drop("permuted", "slots", "taken_blocks"))


def assigned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with size, _h and _b get source_size, target, copies, taken and the shard of each copy."""
    df = session.join_small(rows, plan.drop("rank", "weight", "rest"), "source", "_h", most=2000)
    more = (F.col("_h") <= F.col("upto")) | F.array_contains("picks", F.col("_h"))
    df = df.withColumn("copies", F.col("base") + more.cast("int") + F.array_contains("twice", F.col("_h")).cast("int"))
    shards = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: F.get(F.col("shard_of"), p * BLOCKS + F.col("_b")))).otherwise(F.array().cast("array<int>"))
    return df.withColumns({"taken": F.col("copies") * F.col("size"), "shards": shards}).drop("_b", "base", "upto", "picks", "twice", "shard_of")


def _packed(docs: DataFrame) -> DataFrame:
    """What the mix reads, and the other columns in one, so that no name clashes with those used here."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in READ]
    return docs.select(*READ, F.struct(*rest, F.lit(True).alias("any")).alias("_rest"))


def _unpacked(df: DataFrame, docs: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """All columns of ``docs`` but those named like an output, then the outputs."""
    named = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in outputs]
    return df.select(*(F.col(c) if c in READ else F.col("_rest").getField(f"c{i}").alias(c) for i, c in named), *outputs)


def _taken(docs: DataFrame, levels: int, seed: int, options: dict) -> DataFrame:
    plan = mix_plan(sized(docs, seed), levels=levels, seed=seed, **options)
    return assigned(keyed(_packed(docs), seed), plan)


def mixed(docs: DataFrame, levels: int = 4, seed: int = 17, **options) -> DataFrame:
    """Every row and column of ``docs``, with its size, its source's size and target, and the copies, words and shards taken."""
    return _unpacked(_taken(docs, levels, seed, options), docs, ("size", "source_size", "target", "copies", "taken", "shards"))


def mixed_copies(docs: DataFrame, levels: int = 4, seed: int = 17, **options) -> DataFrame:
    """One row for each copy that the mix takes, with its shard, copy number and local shuffle key."""
    df = _taken(docs, levels, seed, options).select("*", F.posexplode("shards").alias("copy", "shard"))
    df = df.withColumn("order_key", F.xxhash64("_h", "copy", F.lit(seed + 1)))
    return _unpacked(df, docs, ("size", "source_size", "target", "taken", "copy", "shard", "order_key"))


def write_shards(copies: DataFrame, path: str) -> None:
    """Write each shard in its shuffled order."""
    copies.repartition("shard").sortWithinPartitions("shard", "order_key").write.partitionBy("shard").parquet(path)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(session.documents(spark, sf_dir))
    return assigned(rows, mix_plan(rows)).select("doc_id", "size", "source_size", "target", "taken", "shards")
