"""Incremental upkeep of keyed tables: upserts that rewrite touched partitions only, pulls from a stored cursor, work that is resumed item by item.

A kept table is a folder of buckets by hash of the key. A change writes new files for the buckets it
touches, and last of all a manifest, one small file that names each bucket's current version; readers
follow the newest manifest, so a change that was cut short is as if it had not begun, and may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.durable import durable
from millrace.operators.sets import upsert

_MANIFEST = "version long, bucket int, at long, cursor string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _manifest(spark: SparkSession, table: str, below: int | None = None) -> tuple[int, dict[int, int], str | None]:
    """(version, version of each bucket, cursor) of the newest manifest, or of the newest before version `below`; (-1, {}, None) if there is none."""
    if not _exists(spark, f"{table}/manifest"):
        return -1, {}, None
    rows = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{table}/manifest")
    rows = rows if below is None else rows.where(F.col("version") < below)
    last = rows.agg(F.max("version")).first()[0]
    if last is None:
        return -1, {}, None
    rows = rows.where(F.col("version") == last).collect()  # a row per bucket
    return last, {r.bucket: r.at for r in rows if r.bucket >= 0}, rows[0].cursor


def _read(spark: SparkSession, table: str, at: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/data/bucket={b}/at={v}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(spark: SparkSession, table: str, rows: DataFrame, key: list[str], order: list[str], version: int | None = None, cursor: str | None = None, buckets: int = 64) -> int:
    """Upsert rows into a kept table: of each key the last row in `order` stays. Returns the version committed.

    Only buckets that hold a key of rows are read and written. A version that is given and already there is
    made again from the one before it, with the same result; `buckets` must stay the same for a table.
    """
    last, at, was = _manifest(spark, table, version)
    version = last + 1 if version is None else version
    placed = durable(rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in placed.select("__bucket").distinct().collect())
    old = _read(spark, table, {b: v for b, v in at.items() if b in touched}, rows.schema)
    whole = upsert(old.unionByName(placed.drop("__bucket")), key, order)
    for b in touched:
        at[b] = version
    out = whole.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).withColumn("at", F.lit(version))
    if touched:
        out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "at").parquet(f"{table}/data")
    cursor = was if cursor is None else cursor
    lines = [(version, b, v, cursor) for b, v in at.items()] or [(version, -1, -1, cursor)]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{table}/manifest/v{version}")
    return version


def kept(spark: SparkSession, table: str, schema) -> DataFrame:
    """The kept table as of its newest manifest."""
    return _read(spark, table, _manifest(spark, table)[1], schema)


def keep_latest(stream: DataFrame, table: str, key: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge each micro-batch of a stream into a kept table; a repeated batch gives the same version again."""

    def batch(rows: DataFrame, n: int) -> None:
        merge(rows.sparkSession, table, rows, key, order, n, buckets=buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pull(spark: SparkSession, table: str, source: Callable[[str | None], DataFrame], key: list[str], order: list[str], stamp: str, overlap_days: int = 2, buckets: int = 64) -> int:
    """Fetch what is new and merge it; returns how many rows were fetched.

    source(since) gives rows whose `stamp` (date or timestamp) is at or after `since`, all rows for None. The table's
    cursor is the latest stamp seen; the next pull starts `overlap_days` before it, so that late rows and time zones lose
    nothing, and rows fetched twice are merged by key. Cursor and rows are committed together.
    """
    _, _, cursor = _manifest(spark, table)
    since = None if cursor is None else spark.range(1).select((F.lit(cursor).cast("timestamp") - F.make_interval(days=F.lit(overlap_days))).cast("string")).first()[0]
    rows = durable(source(since))
    n, latest = rows.agg(F.count("*"), F.max(F.col(stamp).cast("timestamp")).cast("string")).first()
    later = [c for c in (cursor, latest) if c is not None]
    if n:
        newest = spark.createDataFrame([(c,) for c in later], "c string").agg(F.max(F.col("c").cast("timestamp")).cast("string")).first()[0] if later else None
        merge(spark, table, rows, key, order, cursor=newest, buckets=buckets)
    return n


def resumed(items: DataFrame, cache: str, work: Callable[[DataFrame], DataFrame], key: str, schema: str, parts: int = 16, stop_after: int | None = None) -> DataFrame:
    """Results of `work` for all items, worked out only for those that the cache doesn't have.

    Items are dealt by hash of the key to `parts`; each part's results are committed to the cache before the next
    one starts. A run that fails or is stopped (stop_after: after so many parts) takes up where it was:
    committed items are not worked on again. An item without a result is kept with nulls, so that it isn't tried
    anew each time. schema: the columns of work's result, the key among them; repeated items count once.
    """
    spark = items.sparkSession
    empty = spark.createDataFrame([], schema)

    def stored() -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(cache) if _exists(spark, cache) else empty

    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    todo = durable(items.join(stored().select(key), key, "left_anti").withColumn("__part", part))
    for k in sorted(r[0] for r in todo.select("__part").distinct().collect())[:stop_after]:
        mine = todo.where(F.col("__part") == k).drop("__part")
        made = mine.select(key).distinct().join(work(mine), key, "left").select(empty.columns)
        made.write.mode("append").parquet(f"{cache}/part={k}")
    return items.select(key).distinct().join(stored(), key)
