"""Files in and out: Parquet shards, HTML with sidecars, JSON lines, id lists, exports, shard merges and differences.

Everything is read and written by Spark's own sources, so a path may lie in any store
that Spark reaches; only an id list, which a user writes by hand, is parsed on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import views as v
from ..registry import register

#: What windows-1252 has in place of the control characters 0x80 to 0x9F; five codes have none.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
LEAST_CHARS = 50


def shards(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet shards below a path, with the union of their columns and ``shard``, the file of each row."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    return df.withColumn("shard", F.col("_metadata.file_path"))


def write_shards(df: DataFrame, path: str, rows: int | None = None) -> None:
    """Compressed Parquet, with at most ``rows`` rows a file if given."""
    writer = df.write.option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(path)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, or windows-1252 where they are no UTF-8."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.translate(F.decode(content, "ISO-8859-1"), CONTROLS, WINDOWS))


def html_files(spark: SparkSession, path: str, least: int = LEAST_CHARS) -> DataFrame:
    """(path, name, html) of the .htm and .html files below a path; those of fewer characters are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{htm,html}").load(path)
    df = df.select("path", F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("name"), decoded(F.col("content")).alias("html"))
    return df.where(F.length("html") >= least)


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The .meta.json file beside each page, with its ``name``; a broken one gives nulls."""
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").json(path)
    return df.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.meta\.json$", 1))


def pages_with_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return html_files(spark, path).join(sidecars(spark, path, schema), "name", "left")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema; a line that is no JSON keeps its text in ``_broken``."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows: hits and documents where nothing was found."""
    df = json_lines(spark, path, "doc_id string, section_number string, heading string, score double, status string")
    return df.where("_broken is null").withColumn("status", F.coalesce("status", F.when(F.col("section_number").isNull(), "not_found").otherwise("hit"))).drop("_broken")


def candidate_ids(text: str) -> list[str]:
    """Ids of a list that a user wrote: lines, a JSON list, or {"doc_ids" or "candidates": [...]}; first mentions in order."""
    try:
        found = json.loads(text)
    except ValueError:
        found = [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    if isinstance(found, dict):
        found = found.get("doc_ids", found.get("candidates", []))
    ids = [str(x.get("doc_id", "")) if isinstance(x, dict) else str(x) for x in (found if isinstance(found, list) else [])]
    return list(dict.fromkeys(i for i in ids if i))


def only_candidates(df: DataFrame, text: str) -> DataFrame:
    ids = df.sparkSession.createDataFrame([(i,) for i in candidate_ids(text)], "doc_id string")
    return df.join(ids, df["doc_id"].cast("string") == ids["doc_id"], "left_semi")


def export_labelled(df: DataFrame, path: str, kind: str = "json") -> None:
    """Reviewed rows as JSON lines or as CSV with a header, a file for each task."""
    writer = df.write.option("header", "true")
    writer.csv(path) if kind == "csv" else writer.json(path)


def merged(shards: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest ``newest`` columns, nulls last."""
    order = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in newest))
    return shards.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is there; a merge leaves no orphans."""
    return children.join(parents.select(key), key, "left_semi")


def recounted(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    return parents.drop(name).join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def difference(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by a digest of the content, which alone is shuffled."""
    side = lambda df, x: df.select(key, F.md5(F.coalesce(content, F.lit(""))).alias(x))
    both = side(old, "a").join(side(new, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select(key, change.alias("change"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, digest) of a run; the digest doesn't depend on the order of rows."""
    parts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns))), F.lit(0)).alias("digest")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two manifests, table by table."""
    side = lambda df, x: df.select("table", *(F.col(c).alias(f"{c}_{x}") for c in ("rows", "columns", "digest")))
    return side(a, "a").join(side(b, "b"), "table", "full").withColumn("same", F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("rows_a").eqNullSafe(F.col("rows_b")))


def schema_problems(spark: SparkSession, tables: dict[str, DataFrame], contract: dict[str, dict[str, str]]) -> DataFrame:
    """(table, column, problem): missing columns and other types than the contract's; reads no rows."""
    rows = []
    for name, columns in contract.items():
        have = {f.name: f.dataType.simpleString() for f in tables[name].schema.fields} if name in tables else {}
        rows += [(name, c, "missing" if c not in have else f"is {have[c]}") for c, t in columns.items() if have.get(c) != t]
    return spark.createDataFrame(rows, "table string, column string, problem string")


def _two_shards(spark, d) -> DataFrame:
    """Links as two shards that overlap: the second has the later version of every third."""
    o = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.withColumn("version", F.lit(1)).unionByName(o.where("o_orderkey % 3 = 0").withColumns({"version": F.lit(2), "o_totalprice": F.col("o_totalprice") * 2}))


register(
    "shard_merge",
    lambda spark, d: merged(_two_shards(spark, d), ["o_orderkey"], ["version"]).select("o_orderkey", "version", F.round("o_totalprice", 2).alias("price")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 2) AS price FROM orders",
)
register(
    "orphan_prune",
    lambda spark, d: with_parents(v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), v.table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")),
    "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1",
)
register(
    "source_difference",
    lambda spark, d: difference(v.table(spark, d, "documents").where("doc_id % 7 <> 1"), v.table(spark, d, "documents").where("doc_id % 5 <> 2").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))), "doc_id", "text"),
    "SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'added' WHEN doc_id % 5 = 2 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents WHERE doc_id % 7 <> 1 OR doc_id % 5 <> 2",
)
register(
    "run_manifest",
    lambda spark, d: manifest({t: v.table(spark, d, t) for t in ("orders", "customer", "part")}).select("table", "rows", "columns"),
    "SELECT 'orders' AS \"table\", count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'part', count(*), 6 FROM part",
)
register(
    "schema_contract",
    lambda spark, d: schema_problems(spark, {t: v.table(spark, d, t) for t in ("documents", "labels")}, {"documents": {"doc_id": "bigint", "text": "string", "title": "string", "n_chars": "int"}, "labels": {"doc_id": "bigint"}}),
    "SELECT 'documents' AS \"table\", 'title' AS \"column\", 'missing' AS problem UNION ALL SELECT 'documents', 'n_chars', 'is bigint'",
)
