"""Session settings and small guards that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Word separators as a Java regular expression class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and one in the warehouse on a cluster."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        local = re.fullmatch(r"local(\[.*\])?", context.master)
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or (tempfile.mkdtemp(prefix="folioscope-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_folioscope"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def kept(df: DataFrame) -> DataFrame:
    """The frame's rows, computed once and written to the shared checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_small(big: DataFrame, small: DataFrame, key: str, salt_on: str, most: int = 20_000, salts: int = 64, how: str = "left") -> DataFrame:
    """Join by one key: broadcast where ``small`` is counted to hold at most ``most`` rows.

    Beyond that bound the hot keys of ``big`` are salted by a hash of ``salt_on``
    and ``small`` is repeated once for each salt. Null keys match null keys.
    """
    own, salt, s = (fresh(name, big, small) for name in ("_key", "_salt", "_s"))
    small = small.withColumnRenamed(key, own)
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), big[key].eqNullSafe(F.col(own)), how).drop(own)
    salted = small.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn(salt, F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    return big.join(salted, big[key].eqNullSafe(F.col(own)) & (F.col(salt) == F.col(s)), how).drop(own, s, salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_table(df: DataFrame) -> DataFrame:
    """Like ``kept``, as compressed Parquet in the same shared folder; for wide or long tables."""
    spark = df.sparkSession
    path = f"{shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete what ``kept_table`` wrote, once nothing reads it any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
