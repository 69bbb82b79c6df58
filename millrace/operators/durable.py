"""Intermediate results that outlive lost executors, and joins on keys that many rows share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in local mode gets a temporary one where none is named; on a cluster that raises RuntimeError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut a result's lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut a large result's lineage by Parquet in the shared folder, which is compressed; a checkpoint is not."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crowded_keys(rows: DataFrame, keys: Sequence[str], limit: int, slots: int = 1 << 14) -> DataFrame:
    """keys and __n, their rows, of keys that have more than `limit` rows.

    Rows are first counted by slots that many keys share, few enough to be combined before the shuffle. Keys are counted
    in slots beyond the limit only, so that a table without such keys isn't shuffled by them. The limit is twice a slot's mean at least.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")
    per = durable(rows.groupBy(slot.alias("__slot")).agg(F.count("*").alias("__n")))
    limit = max(limit, 2 * (per.agg(F.sum("__n")).first()[0] or 0) // slots)
    full = [r[0] for r in per.where(F.col("__n") > limit).select("__slot").collect()]  # half of the slots at most
    return durable(rows.where(slot.isin(full)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = 10_000, per: DataFrame | None = None) -> DataFrame:
    """left joined to right; rows of a key that has more than `limit` of them in left are dealt to several tasks, to each of which right's rows of that key are copied.

    left is read three times, twice if the keys beyond the limit are known (`per`: keys and __n, their rows in left). Of its keys a million at most are beyond the limit, which grows with it,
    so that their table can be broadcast.
    """
    keys = list(keys)
    per = crowded_keys(left, keys, limit) if per is None else per.where(F.col("__n") > limit)
    rows = per.agg(F.sum("__n")).first()[0]
    if not rows:
        return left.join(right, keys, how)
    limit = max(limit, rows // 1_000_000)
    hot = per.where(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__copies"))
    copies = F.coalesce("__copies", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), copies).cast("int")).drop("__copies")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")
