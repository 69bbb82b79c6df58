"""Benchmark decontamination: a broadcast hash set of test n-grams against the windows of training texts.

Benchmark texts become word windows, with a 64-bit hash each. A document's windows are made
inside its own row and meet the set in a broadcast hash join; hits are verified against the
windows' words, and only hits go on. Which items have a window stays out of the broadcast, however
many these are; it is joined to the hits. A set beyond a stated number of bytes is cut by hash and
its parts are broadcast one after the other: one method at every size. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import alnum_words, durable, stored, window_hits, word_hashes
from millrace.operators.durable import salted_join

#: What tells rows of one id apart.
_KEY = "text_key"


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(gram, n, hash, items): each distinct window with the sorted ids of the items that have it.

    A window is n consecutive words; an item of fewer, but not none, is one window. Items
    without an id mark words like others but are not listed.
    """
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array(F.lit(0)))
    grams = words.select("item", F.explode(F.transform(at, lambda i: F.slice("w", i + 1, n))).alias("g"))
    named = grams.select("item", F.array_join("g", " ").alias("gram"), F.size("g").alias("n"), F.xxhash64(word_hashes(F.col("g"))).alias("hash"))
    return named.groupBy("gram", "n", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _covered(spans: Column) -> Column:
    """How many words lie inside spans (array of start, n), sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated.

    n_hit counts words inside any occurrence of a window, items those with occurring windows.
    Null and empty texts have no words and no hits. Rows without an id are scanned too, repeated rows
    come back as often as they came, and an empty benchmark marks nothing.
    """
    grams = durable(windows(benchmark, item_col, item_text_col, n))
    keys = [F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias(_KEY)]
    hits = stored(window_hits(docs, keys, F.col(text_col), grams.drop("items"), max_bytes).withColumn("gram", F.md5("gram")), "benchmark-hits")
    owned = grams.select(F.md5("gram").alias("gram"), F.explode("items").alias("item"))
    listed = salted_join(hits.where("start >= 0").select("doc_id", _KEY, "gram").distinct(), owned, ["gram"]).select("doc_id", _KEY, "item").distinct()
    span = F.when(F.col("start") >= 0, F.struct("start", "n"))
    whole = [F.max("n_words").alias("n_words"), F.count(F.when(F.col("start") < 0, 1)).cast("int").alias("copies")]
    rows = hits.select("doc_id", _KEY, "n_words", "start", "n").unionByName(listed, allowMissingColumns=True)
    out = rows.groupBy("doc_id", _KEY).agg(*whole, F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    out = out.select("doc_id", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__copy"))
    return out.drop("__copy").withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", n: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """docs without the rows that hold a benchmark window; columns as they came, clean rows untouched.

    Rows of null or empty texts stay, and repeated rows stay or go together. Which texts go is told by
    their MD5; the list of these is broadcast up to max_bytes, and joined by shuffle beyond.
    """
    grams = durable(windows(benchmark.withColumn("__item", F.lit(0)), "__item", item_text_col, n).drop("items"))
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    hit = stored(window_hits(docs, [key.alias("__gone")], F.col(text_col), grams, max_bytes).where("start >= 0").select("__gone").distinct(), "contaminated")
    gone = F.broadcast(hit) if hit.count() * 64 <= max_bytes else hit
    return docs.join(gone, key == F.col("__gone"), "left_anti")
