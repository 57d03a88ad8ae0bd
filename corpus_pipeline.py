"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. Between stages the rows are written as Parquet to the shared folder and read
again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join, packing, quality_rules, session, source_mixing, substring_dedup
from folioscope.llm.sketches import split_by_ids


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but those of the table packed into one, so that no name clashes inside a stage."""
    rest = [c for c in docs.columns if c not in CORE]
    return docs.select(*(c for c in docs.columns if c in CORE), F.struct(*rest).alias("_rest")) if rest else docs


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in CORE else F.col("_rest").getField(c).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass every quality rule, as they came; null and empty texts don't, nor does an empty table have any."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of the Jaccard join; rows without a doc_id stay, and so do all rows of an id that stays."""
    found = jaccard_join.near_duplicates(docs)
    later = session.kept(found.where("component_id <> doc_id").select("doc_id").distinct())
    some, others = split_by_ids(docs.where("doc_id is not null"), later)
    return some.join(later, "doc_id", "left_anti").select(*docs.columns).unionByName(others).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier in the corpus; documents of which nothing is left go, those that had no word stay."""
    kept = substring_dedup.dedup_words(_aside(docs)).where("n_words = 0 or n_removed < n_words")
    return _restored(kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document; documents without a word are taken only in whole passes."""
    return _restored(source_mixing.mixed_copies(_aside(docs)), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row, with its sequence and offset; null and empty texts are one end token, repeated rows are packed as often as they come."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mixing", mixture),
    ("packing", sequences),
]

#: SQL cannot express the hashed mix and the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = session.kept_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
