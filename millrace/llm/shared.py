"""Small helpers that the training-data operators have in common."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session in local mode, whose driver is its one executor, gets a temporary folder where none
    is named; on a cluster that raises RuntimeError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate result; lost executors can't undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Words of digits, letters a-z and characters beyond ASCII, A-Z lower-cased; null text has none."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once.

    A lambda variable is out of the optimizer's reach, which would otherwise put the expression
    for `value` into every lambda that reads it and compute it anew for each element.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """For each value, all values up to it merged, from zero on.

    Chunk by chunk: appending to one array would copy it for every value.
    """
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / chunk), F.lit(0)).cast("int")), lambda c: F.slice(values, c * chunk + 1, chunk))

    def along(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))

    def made(cut: Column) -> Column:
        totals = F.transform(cut, lambda xs: F.aggregate(xs, zero, merge))
        return let(along(totals, zero), lambda before: F.flatten(F.transform(cut, lambda xs, i: F.slice(along(xs, F.element_at(before, i + 1)), 2, chunk))))

    return let(parts, made)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hash(hashes: Column, start: Column, n: int) -> Column:
    """Hash of the n words from `start` (from 0), out of the words' own hashes."""
    return F.xxhash64(F.slice(hashes, start + 1, n))


def gram_text(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def starts(words: Column, n: int) -> Column:
    """Positions, from 0, at which n words begin."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.expr("cast(array() as array<int>)"))


def bitmap_longs(grams: int) -> int:
    """Longs of the bitmap that goes before a broadcast join of so many windows: 16 bits a window, 1 MB at most; a power of two."""
    return min(max(1 << 14, 1 << (grams // 4).bit_length()), 1 << 17)


def _bitmap(part: DataFrame, longs: int) -> Column:
    cells = [0] * longs
    for c in part.groupBy(_cell(F.col("hash"), longs).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("v")).collect():  # `longs` rows at most
        cells[c.cell] = c.v
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")


def bitmap(table: DataFrame) -> tuple[int, Column]:
    """Of the hashes of a stored table (hash): longs and the bitmap, for in_bitmap."""
    longs = bitmap_longs(table.count())
    return longs, _bitmap(table, longs)


def in_bitmap(bits: Column, longs: int, h: Column) -> Column:
    """False for hashes that the bitmap's table lacks; true for those it has and, the fuller it is, some others."""
    return F.getbit(F.element_at(bits, _cell(h, longs) + 1), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _cell(h: Column, longs: int) -> Column:
    return F.shiftrightunsigned(h, 65 - longs.bit_length()).cast("int")


def window_hits(docs: DataFrame, keys: list[Column], text: Column, table: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Windows of words that stand in a table: the keys, n_words, start, and the columns of table.

    table: hash (gram_hash of the words), n (how many they are), gram (the words, joined by
    blanks), and more columns of a fixed width, 64 bytes at most. Every row of docs also gives one row with start -1 and nulls beyond n_words.
    Windows are made inside their row. Those that miss a bitmap of the table's hashes go at once; the rest
    meet the table in a broadcast hash join, and what meets is held against the words themselves.
    A table over max_bytes is cut by hash, and its parts, each with its bitmap, are sent one after the other, so that bitmaps
    grow with the table and none fills up. Texts are then cut into words once a part.
    """
    size = table.agg(F.sum(F.length("gram") + 64).alias("b")).first().b or 0
    parts = max(1, -(-size // max_bytes))
    names = [f"__k{i}" for i in range(len(keys))]
    named = docs.select(*[k.alias(n) for k, n in zip(keys, names)], alnum_words(text).alias("w"))

    def rows(part: DataFrame) -> DataFrame:
        sizes = {r.n: bitmap_longs(r.k) for r in part.groupBy("n").agg(F.count("*").alias("k")).collect()}
        bits = {n: _bitmap(part.where(F.col("n") == n), longs) for n, longs in sorted(sizes.items())}

        def of(n: int, w: Column, h: Column) -> Column:
            hashes = F.transform(starts(w, n), lambda i: gram_hash(h, i, n))
            may = lambda x, i: F.when(in_bitmap(bits[n], sizes[n], x), i)
            passed = F.filter(F.transform(hashes, may), lambda i: i.isNotNull())
            return F.transform(passed, lambda i: F.struct(i.alias("start"), gram_hash(h, i, n).alias("hash"), gram_text(w, i, n).alias("gram")))

        def found(w: Column) -> Column:
            none = F.expr("array(named_struct('start', -1, 'hash', cast(null as bigint), 'gram', cast(null as string)))")
            return F.struct(F.size(w).cast("long").alias("n_words"), let(word_hashes(w), lambda h: F.concat(none, *[of(n, w, h) for n in bits])).alias("hits"))

        hit = named.select(*names, let(F.col("w"), found).alias("x")).select(*names, "x.n_words", F.explode("x.hits").alias("hit"))
        return hit.select(*names, "n_words", "hit.start", F.col("hit.hash").alias("__hash"), F.col("hit.gram").alias("__gram"))

    joined = None
    for p in range(parts):
        part = table if parts == 1 else table.where(F.pmod("hash", F.lit(parts)) == p)
        met = rows(part).join(F.broadcast(part), (F.col("__hash") == F.col("hash")) & (F.col("__gram") == F.col("gram")), "left")
        met = met.where(F.col("hash").isNotNull() | ((F.col("start") == -1) if p == 0 else F.lit(False))).drop("__hash", "__gram")
        met = met if parts == 1 else stored(met, "hits")
        joined = met if joined is None else joined.unionByName(met)
    return joined.select(*[F.col(n).alias(k) for n, k in zip(names, _names(docs, keys))], *[c for c in joined.columns if c not in names])


def _names(docs: DataFrame, keys: list[Column]) -> list[str]:
    return docs.select(*keys).columns
