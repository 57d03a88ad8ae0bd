"""Steps of many jobs: tables written in between, joins on hot keys, components of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 / HOT of all rows, so that fewer than HOT keys can be.
HOT = 10_000
#: Rows of a table that a task may hold beside its own.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: a temporary one in local mode, one in the warehouse on a cluster."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        local = re.fullmatch(r"local(\[.*\])?", context.master)
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="folioscope-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_folioscope"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once: a Parquet table in the shared folder that any executor can read again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def delete(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` as the small side of a join with exploded rows: broadcast if it has at most ``most`` rows, counted first, else merged.

    Spark takes the size of exploded rows for that of the compressed file they come from
    and would broadcast them; either hint forbids that.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def joined_by_size(rows: DataFrame, sides: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``sides``, which has one row for each key and in ``n`` the key's number of rows.

    The hot keys, fewer than HOT by their definition, are broadcast, so that no task gets
    all rows of one; the others are shuffled, since a side of arrays can be far larger than
    its compressed file. ``total`` is the number of rows.
    """
    most = max(1, total // HOT)
    hot, others = F.broadcast(sides.where(F.col("n") > most)), sides.where(F.col("n") <= most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others.hint("merge"), key))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of links (a, b): the least id that each id reaches. A written table.

    Each round gives an id the least component among its neighbours', then its
    component's component; ids without a link aren't listed. Both are grouped minima and
    joins by id, until no row changes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        hooked = written(labels.join(near, "id").select("id", F.least("component", "c").alias("component")))
        jumped = hooked.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = written(hooked.join(jumped, "component").select("id", F.col("further").alias("component")))
        same = after.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").isEmpty()
        delete(labels, hooked)
        labels = after
        if same:
            delete(both)
            return labels
