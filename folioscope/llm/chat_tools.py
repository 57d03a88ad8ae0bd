"""Chat formatting: linking tool calls and results, with DataFrame functions only.

Calls and results meet in a hash join on their identifier. Arguments are parsed as
variants and checked against schema rows (tool, field, type, required, least length);
canonical JSON has its keys sorted at every level (variants keep objects in key
order), no spaces, and null where a value is missing.

Order: each call may name the call it depends on. A call's level is the number of
calls on its chain of dependencies, found by pointer doubling: rounds grow with the
logarithm of the longest chain, each is a join on identifiers, and no conversation
is ever gathered in one task. Sorting by level is a topological order; calls on a
cycle get no level.

Edge cases: a call without a result has result null; a result without a call links
with nothing; repeated identifiers keep the least row; null identifiers never link
and are dropped, since nothing could refer to them; malformed arguments give the
error ``malformed`` and null arguments; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session

#: (tool, field, type, required, least length of a string)
CHAT_SCHEMAS = (
    ("system", "text", "string", True, 1),
    ("user", "text", "string", True, 20),
    ("user", "turn", "integer", True, 0),
)


def _problem(field: str, kind: str, required: bool, least: int) -> Column:
    path = f"$.{field}"
    value = F.try_variant_get("v", path, "string")
    typed = {"string": F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", "integer": F.try_variant_get("v", path, "bigint").isNotNull(), "number": F.try_variant_get("v", path, "double").isNotNull(), "boolean": F.try_variant_get("v", path, "boolean").isNotNull()}[kind]
    out = F.when(value.isNull(), F.lit(f"missing:{field}")) if required else F.when(value.isNull(), F.lit(None))
    out = out.when(~typed, F.lit(f"type:{field}"))
    return out.when(F.length(value) < least, F.lit(f"short:{field}")) if kind == "string" and least else out


def validated(calls: DataFrame, schemas=CHAT_SCHEMAS) -> DataFrame:
    """Adds arguments as canonical JSON (null if malformed) and the sorted array ``errors``."""
    df = calls.withColumn("v", F.try_parse_json("arguments"))
    tools = sorted({s[0] for s in schemas})
    problems = F.array(F.when(~F.col("name").isin(tools) | F.col("name").isNull(), F.lit("unknown tool")), F.when(F.col("v").isNull(), F.lit("malformed")))
    for tool in tools:
        own = [s[1:] for s in schemas if s[0] == tool]
        named = F.array(*(F.lit(s[0]) for s in own))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), named), lambda k: F.concat(F.lit("unknown:"), k))
        some = F.concat(F.array(*(_problem(*s) for s in own)), extra)
        problems = F.concat(problems, F.when((F.col("name") == tool) & F.col("v").isNotNull(), some).otherwise(F.array().cast("array<string>")))
    return df.withColumns({"errors": F.array_sort(F.array_compact(problems)), "arguments": F.to_json("v")}).drop("v")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) from (call_id, needs): calls on the chain of dependencies before each call.

    A chain has fewer steps than there are calls, so pointers that are left after the
    logarithm of their number in rounds run around on a cycle.
    """
    ids = calls.select(F.col("call_id").alias("k")).hint("shuffle_hash")
    end, zero = F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("level")
    # Rows without a pointer never enter a join, where they would all meet under null.
    linked = calls.where("needs is not null").join(ids, F.col("needs") == F.col("k"), "left").select("call_id", F.col("k").alias("up"), F.when(F.col("k").isNotNull(), 1).otherwise(0).cast("long").alias("level"))
    at = session.kept_table(linked.unionByName(calls.where("needs is null").select("call_id", end, zero)))
    for _ in range(at.count().bit_length()):
        open_ = at.where("up is not null")
        if open_.isEmpty():
            break
        above = at.select(F.col("call_id").alias("k"), F.col("up").alias("up2"), F.col("level").alias("more")).hint("shuffle_hash")
        moved = open_.join(above, F.col("up") == F.col("k")).select("call_id", F.col("up2").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        after = session.kept_table(moved.unionByName(at.where("up is null")))
        session.drop(at)
        at = after
    return at.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def linked(calls: DataFrame, results: DataFrame, schemas=CHAT_SCHEMAS) -> DataFrame:
    """calls (call_id, name, arguments, needs) and results (call_id, content), linked and serialised.

    Gives call_id, name, arguments, errors, valid, level, result and ``canonical``.
    """
    calls = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "needs")).alias("c")).select("call_id", "c.*")
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"))
    df = validated(calls, schemas).join(results.hint("shuffle_hash"), "call_id", "left").join(levels(calls).hint("shuffle_hash"), "call_id")
    df = df.withColumn("valid", F.size("errors") == 0)
    line = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id"), F.col("errors"), F.col("level"), F.col("name"), F.col("needs"), F.col("result"), F.col("valid"))
    return df.withColumn("canonical", F.to_json(line, {"ignoreNullFields": "false"}))


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and system turns as calls, assistant turns as the results of the turn before.

    A call needs the call of the turn before, if there is one, else that of two turns before.
    """
    key = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("text", "turn")))
    turns = turns.where("conv_id is not null and turn is not null")
    calls = turns.where("role in ('user', 'system')").select(key(F.col("turn")).alias("call_id"), F.col("role").alias("name"), arguments.alias("arguments"), key(F.col("turn") - 1).alias("one"), key(F.col("turn") - 2).alias("two"))
    ids = calls.select(F.col("call_id").alias("k")).distinct().hint("shuffle_hash")
    calls = calls.join(ids, F.col("one") == F.col("k"), "left").withColumn("one", F.col("k")).drop("k").join(ids, F.col("two") == F.col("k"), "left")
    calls = calls.select("call_id", "name", "arguments", F.coalesce("one", "k").alias("needs"))
    return calls, turns.where("role = 'assistant'").select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked(calls, results).select("call_id", "name", "level", "valid", F.array_join("errors", ",").alias("errors"), "canonical")


OP4_SQL = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, role AS name, text FROM t WHERE role IN ('user', 'system')),
n AS (SELECT c.*, coalesce(a.call_id, b.call_id) AS needs FROM c LEFT JOIN c AS a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN c AS b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
l AS (SELECT call_id, 0 AS level FROM n WHERE needs IS NULL UNION ALL SELECT n.call_id, l.level + 1 FROM n JOIN l ON n.needs = l.call_id),
r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS result FROM t WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT n.*, l.level, r.result, CASE WHEN text IS NULL THEN 'missing:text' WHEN length(text) < CASE name WHEN 'user' THEN 20 ELSE 1 END THEN 'short:text' ELSE '' END AS errors
  FROM n JOIN l USING (call_id) LEFT JOIN r USING (call_id))
SELECT call_id, name, level, errors = '' AS valid, errors,
  CAST(json_object('arguments', CASE name WHEN 'system' THEN json_object('text', text) ELSE json_object('text', text, 'turn', turn) END, 'call_id', call_id,
    'errors', CASE WHEN errors = '' THEN json_array() ELSE json_array(errors) END, 'level', level, 'name', name, 'needs', needs, 'result', result, 'valid', errors = '') AS VARCHAR) AS canonical
FROM e
"""
