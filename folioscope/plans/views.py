"""The document hierarchy over the provided tables, as DataFrames and as the same SQL.

documents -> articles -> sections -> clauses and definitions, plus rule links. Each
view is lazy; columns that a query does not use are pruned down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS_IN_ARTICLE = 5
HEADING_CHARS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id",
        "text",
        F.col("source").alias("template_family"),
        F.col("lang").alias("market_segment"),
        F.col("n_chars").alias("text_length"),
        F.size(F.split(F.trim("text"), "\\s+")).cast("long").alias("word_count"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("cohort"),
        "quality",
        "toxic",
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = docs.select("doc_id", F.col("source").alias("template_family"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    number = (F.col("p") + 1).cast("long")
    return df.select(
        "doc_id",
        "template_family",
        number.alias("section_number"),
        (F.floor(F.col("p") / SECTIONS_IN_ARTICLE) + 1).cast("long").alias("article_num"),
        F.left("text", F.lit(HEADING_CHARS)).alias("heading"),
        F.col("text"),
        F.length("text").cast("long").alias("chars"),
    )


def with_line_starts(df: DataFrame, lines: str, name: str, first: int = 0, step: int = 256) -> DataFrame:
    """``df`` with the first character of each line of the array ``lines``, one character lying between lines.

    Sums run within steps of lines and then over steps, so that the work grows hardly
    faster than the number of lines, and nothing is shuffled.
    """
    pushed = lambda s, n: F.array_append(s, F.element_at(s, -1) + n)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / step).cast("int")), lambda k: F.slice(F.col(lines), k * step + 1, step))
    df = df.withColumn("_sums", F.transform(chunks, lambda c: F.aggregate(c, F.array(F.lit(0)), lambda s, x: pushed(s, F.length(x) + 1))))
    df = df.withColumn("_offsets", F.aggregate("_sums", F.array(F.lit(first)), lambda s, b: pushed(s, F.element_at(b, -1))))
    starts = F.flatten(F.zip_with("_sums", F.slice("_offsets", F.lit(1), F.size("_sums")), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + o)))
    return df.withColumn(name, starts).drop("_sums", "_offsets")


def placed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with char_start, 1-based within the document."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("template_family"), F.split("text", "\n").alias("lines"))
    df = with_line_starts(docs, "lines", "starts", 1)
    df = df.select("doc_id", "template_family", F.posexplode(F.arrays_zip("lines", "starts")).alias("p", "x"))
    return df.select(
        "doc_id",
        "template_family",
        (F.col("p") + 1).cast("long").alias("section_number"),
        (F.floor(F.col("p") / SECTIONS_IN_ARTICLE) + 1).cast("long").alias("article_num"),
        F.left("x.lines", F.lit(HEADING_CHARS)).alias("heading"),
        F.col("x.lines").alias("text"),
        F.length("x.lines").cast("long").alias("chars"),
        F.col("x.starts").cast("long").alias("char_start"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article is titled by its first section; every third article has none recorded."""
    first = sections(spark, sf_dir).where((F.col("section_number") - 1) % SECTIONS_IN_ARTICLE == 0)
    return first.where("article_num % 3 <> 0").select("doc_id", "article_num", F.col("heading").alias("title"), F.left("heading", F.lit(8)).alias("concept"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand in for clauses of an order's document."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_suppkey") % 10).alias("section_number"),
        F.col("l_linenumber").cast("long").alias("clause_number"),
        F.concat(F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("clause_id"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.col("l_orderkey"), F.lit("."), F.col("l_linenumber") - 1 - F.col("l_partkey") % 2)).alias("parent_id"),
        (F.col("l_linenumber") % 4 + 1).cast("long").alias("depth"),
        (1 - F.col("l_discount")).alias("parse_confidence"),
        (F.col("l_returnflag") != "R").alias("is_structural"),
        F.col("l_linestatus").alias("label"),
        F.col("l_quantity").alias("quantity"),
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("p", "term"))
    engine = F.element_at(F.array(F.lit("quoted"), F.lit("colon"), F.lit("smart")), (F.length("term") % 3 + 1).cast("int"))
    return df.select("doc_id", F.col("p").cast("long").alias("ordinal"), "term", engine.alias("pattern_engine"), (F.length("term") / 20.0).alias("confidence"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("unlinked")
    return df.select(
        F.col("o_orderkey").alias("link_id"),
        F.col("o_orderpriority").alias("family_id"),
        F.col("o_custkey").alias("doc_id"),
        (F.col("o_orderkey") % 7).alias("section_number"),
        status.alias("status"),
        (F.col("o_totalprice") / 600000.0).alias("confidence"),
        F.col("o_orderdate").alias("created_at"),
    )


#: The same views in DuckDB's SQL, for ``WITH`` lists.
SQL = {
    "docs": """docs AS (SELECT d.doc_id, d.text, d.source AS template_family, d.lang AS market_segment, d.n_chars AS text_length,
  CAST(len(regexp_split_to_array(trim(d.text), '\\s+')) AS BIGINT) AS word_count, coalesce(l.quality = 1, false) AS cohort, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "sections": """sections AS (SELECT doc_id, template_family, section_number, (section_number - 1) // 5 + 1 AS article_num, left(text, 40) AS heading, text, length(text) AS chars
  FROM (SELECT doc_id, source AS template_family, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS section_number FROM documents))""",
    "placed": """placed AS (SELECT *, CAST(1 + coalesce(sum(chars + 1) OVER (PARTITION BY doc_id ORDER BY section_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM sections)""",
    "articles": """articles AS (SELECT doc_id, article_num, heading AS title, left(heading, 8) AS concept FROM sections WHERE (section_number - 1) % 5 = 0 AND article_num % 3 <> 0)""",
    "clauses": """clauses AS (SELECT l_orderkey AS doc_id, l_suppkey % 10 AS section_number, CAST(l_linenumber AS BIGINT) AS clause_number, l_orderkey || '.' || l_linenumber AS clause_id,
  CASE WHEN l_linenumber > 1 THEN l_orderkey || '.' || (l_linenumber - 1 - l_partkey % 2) END AS parent_id, CAST(l_linenumber % 4 + 1 AS BIGINT) AS depth, 1 - l_discount AS parse_confidence,
  l_returnflag <> 'R' AS is_structural, l_linestatus AS label, l_quantity AS quantity FROM lineitem)""",
    "definitions": """definitions AS (SELECT doc_id, ordinal, term, CASE length(term) % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN 'colon' ELSE 'smart' END AS pattern_engine, length(term) / 20.0::DOUBLE AS confidence
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS term, unnest(range(0, len(regexp_extract_all(text, '[A-Z][a-z]{3,}')))) AS ordinal FROM documents))""",
    "links": """links AS (SELECT o_orderkey AS link_id, o_orderpriority AS family_id, o_custkey AS doc_id, o_orderkey % 7 AS section_number,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'pending_review' ELSE 'unlinked' END AS status, o_totalprice / 600000.0::DOUBLE AS confidence, o_orderdate AS created_at FROM orders)""",
}


def with_views(*names: str) -> str:
    """``WITH`` list of the named views, in order."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
