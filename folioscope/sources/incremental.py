"""Incremental rebuilds: what changed in a source by its listing alone, and the partitions of the tables that depend on it.

A listing has path, time and size of each file; no content is read for it. Every table is
partitioned by ``bucket``, a hash of the file that a row comes from, so a change in one
file touches one partition of each table that is built from it, directly or over others.
Tables are rebuilt parents first, and only those partitions. The new manifest is to be
written last: a run that is lost halfway is repeated from the old one, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import views as v
from ..plans.stages import delete, shared_folder, written
from ..registry import register

SOURCE = "source"
BUCKET = "bucket"
#: Partitions of a table; to be chosen so that one is a task's work.
BUCKETS = 64


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of the files below a path, the paths relative to it; an empty folder has no row."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(root).toString()
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select(F.substring("path", len(root) + 2, 1 << 16).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changes(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): new, changed (other time or size), deleted or same. Keys are unique; null times or sizes are equal to each other."""
    side = lambda df, x: df.select(key, F.struct("modified", "size").alias(x))
    both = side(before, "a").join(side(now, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(key, change.alias("change"))


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Step:
    """A table: what it reads (``SOURCE`` or tables of earlier steps) and how to build it from these; rows keep ``bucket``."""

    name: str
    reads: tuple[str, ...]
    build: Callable[..., DataFrame]


def dependents(steps: Iterable[Step], wanted: Iterable[str]) -> list[str]:
    """The tables asked for and all that are built from them, parents first."""
    steps, found = list(steps), set(wanted)
    unknown = found - {s.name for s in steps}
    if unknown:
        raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
    for s in steps:
        if found.intersection(s.reads):
            found.add(s.name)
    return [s.name for s in steps if s.name in found]


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def build(source: DataFrame, folder: str, steps: Iterable[Step]) -> None:
    """All tables from all of the source, which has ``bucket``."""
    for s in steps:
        frames = [source if r == SOURCE else stored(source.sparkSession, folder, r) for r in s.reads]
        s.build(*frames).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/{s.name}")


def rebuild(source: DataFrame, folder: str, steps: Iterable[Step], touched: Iterable[int] | None = None, only: Iterable[str] | None = None) -> list[str]:
    """Rewrite the partitions ``touched`` (all, if not given) of the tables ``only`` (all) and of those built from them.

    Other partitions stay as they are, file by file. A partition that has no row any more
    is left with an empty file, so that the table keeps its schema. Returns the tables'
    names in the order in which they were rebuilt.
    """
    spark, steps = source.sparkSession, list(steps)
    names = dependents(steps, [s.name for s in steps] if only is None else only)
    touched = None if touched is None else sorted(set(touched))
    if touched == []:
        return []
    for s in steps:
        if s.name not in names:
            continue
        frames = [source if r == SOURCE else stored(spark, folder, r) for r in s.reads]
        had = touched
        if touched is None:
            had = [r[0] for r in stored(spark, folder, s.name).select(BUCKET).distinct().collect()]  # at most one for each partition
        else:
            frames = [f.where(F.col(BUCKET).isin(touched)) for f in frames]
        fresh = written(s.build(*frames))
        fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{folder}/{s.name}")
        has = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
        none = fresh.drop(BUCKET).limit(0)
        for b in sorted(set(had) - has):
            none.write.mode("overwrite").parquet(f"{folder}/{s.name}/{BUCKET}={b}")
        delete(fresh)
    return names


def touched_buckets(changed: DataFrame, key: str = "path", buckets: int = BUCKETS) -> list[int]:
    """The buckets of all rows of ``changes`` that aren't the same; at most ``buckets`` numbers."""
    return sorted(r[0] for r in changed.where("change <> 'same'").select(bucket_of(key, buckets)).distinct().collect())


# Registered: documents as files. Those labelled toxic are new, those labelled poor had another text, and the old state
# holds a second file, deleted since, for each that is new.


def _now(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = v.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_new"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("poor"))


def _before(now: DataFrame) -> DataFrame:
    """The earlier state of ``_now``."""
    kept = now.where("not is_new").withColumn("text", F.when(F.col("poor"), F.concat("text", F.lit("\nan older line"))).otherwise(F.col("text")))
    return kept.unionByName(now.where("is_new").withColumn("doc_id", -1 - F.col("doc_id")))


def _listed(docs: DataFrame, later: bool) -> DataFrame:
    return docs.select("doc_id", F.when(F.col("poor") & F.lit(later), 2).otherwise(1).alias("modified"), F.octet_length("text").alias("size"))


def _lines(source: DataFrame) -> DataFrame:
    lines = source.select(BUCKET, "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(BUCKET, "doc_id", "line_no", F.length("line").alias("chars"), F.size(F.array_remove(F.split("line", "[\\x20\\x09-\\x0D]+"), "")).alias("words"))


def _profiles(lines: DataFrame) -> DataFrame:
    return lines.groupBy(BUCKET, "doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("words").alias("words"), F.max("chars").alias("longest"))


def _compared(source: DataFrame, profiles: DataFrame) -> DataFrame:
    return source.select(BUCKET, "doc_id", F.length("text").alias("chars")).join(profiles, [BUCKET, "doc_id"])


STEPS = (Step("lines", (SOURCE,), _lines), Step("profiles", ("lines",), _profiles), Step("documents", (SOURCE, "profiles"), _compared))


def incremental_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Line profiles of all documents, after a build of the earlier state and a rebuild of the partitions that changed."""
    now = _now(spark, d)
    old = _before(now)
    folder = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    build(old.withColumn(BUCKET, bucket_of("doc_id")), folder, STEPS)
    touched = touched_buckets(changes(_listed(old, False), _listed(now, True), "doc_id"), "doc_id")
    rebuild(now.withColumn(BUCKET, bucket_of("doc_id")), folder, STEPS, touched)
    return stored(spark, folder, "documents").select("doc_id", "chars", "lines", "words", "longest")


_STATE = """now AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(toxic = 1, false) AS is_new, coalesce(quality = 0, false) AS poor FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"""
register(
    "listing_changes",
    lambda spark, d: (lambda now: changes(_listed(_before(now), False), _listed(now, True), "doc_id"))(_now(spark, d)),
    f"""WITH {_STATE} SELECT doc_id, CASE WHEN is_new THEN 'new' WHEN poor THEN 'changed' ELSE 'same' END AS change FROM now
UNION ALL SELECT -1 - doc_id, 'deleted' FROM now WHERE is_new""",
)
register(
    "incremental_profiles",
    incremental_profiles,
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id, chars, count(*) AS lines, sum(len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')))::BIGINT AS words, max(length(line)) AS longest
FROM l JOIN (SELECT doc_id, length(coalesce(text, '')) AS chars FROM documents) USING (doc_id) GROUP BY 1, 2""",
)
