"""License scan by diagonal voting.

All rolling word k-grams of a text meet the k-grams of license templates in a hash join, and
each match votes for the diagonal `position in the text - position in the template`. Votes on one
diagonal are words that stand in the template's order at one place; diagonals that lie close to
each other and follow each other in the text are one copy with insertions or omissions, and are
merged. A merged run is then verified: along the text, a vote counts only if it stands further on
in the template than every vote before it, so that no template position counts twice and
repeated or shuffled parts of a template don't add up. A run holds if what counts reaches the
template's share. DataFrame functions only.

Before the join a window inside its row must pass a bitmap of the templates' hashes, which
misses no window of a template (shared.window_hits).

Title phrases are scanned with k = 2 and must be complete; texts with k = 4.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.license_texts import PHRASES, TEXTS
from millrace.llm.shared import durable, stored, window_hits, word_hashes


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    k: int
    #: Share of the template's k-grams that a run must hold.
    share: float
    base: bool


def templates(phrases: Mapping[str, str] = PHRASES, texts: Mapping[str, str] = TEXTS, share: float = 0.6) -> list[Template]:
    """The templates, in a fixed order. phrases: phrase -> label; texts: label -> text. Texts without words give none."""
    cut = lambda t: tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)))
    made = [Template(label, w, min(2, len(w)), 1.0, True) for p, label in phrases.items() for w in [cut(p)]]
    return [t for t in made + [Template(label, w, min(4, len(w)), share, False) for label, t in texts.items() for w in [cut(t)]] if t.words]


def _grams(spark: SparkSession, known: list[Template]) -> DataFrame:
    """A row per k-gram of a template: gram, n, template, t_at, and what there is to know of the template."""
    rows = [(" ".join(t.words[i : i + t.k]), t.k, n, i, t.label, len(t.words) - t.k + 1, t.share, t.base) for n, t in enumerate(known) for i in range(len(t.words) - t.k + 1)]
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v).lower()
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + " AS t(gram, n, template, t_at, label, grams, share, base)")
    return durable(listed.withColumn("hash", F.xxhash64(word_hashes(F.split("gram", " ")))))


def runs(docs: DataFrame, text_col: str, keys: list[Column], known: list[Template] | None = None, slack: int = 4) -> DataFrame:
    """The keys of docs' rows beside n_words and, for each run, template, label, base, start, stop and score; and a row of nulls, with own = 1, for each row of docs."""
    hits = stored(window_hits(docs, keys, F.col(text_col), _grams(docs.sparkSession, known or templates())), "license-hits")
    key = docs.select(*keys).columns
    band = W.partitionBy(*key, "template").orderBy("diagonal", "start")
    hits = hits.withColumn("diagonal", F.col("start") - F.col("t_at"))
    # Votes whose diagonals follow each other within the slack are one band, a phrase's only if they are equal; a band is cut at gaps in the text.
    far = F.col("diagonal") - F.lag("diagonal").over(band) > F.when(F.col("base"), 0).otherwise(slack)
    votes = hits.where("start >= 0").distinct()  # rows that repeat an id and a text vote once
    banded = votes.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("band", F.sum("far").over(band))
    order = W.partitionBy(*key, "template", "band").orderBy("start", "t_at")
    apart = F.col("start") - F.max("start").over(order.rowsBetween(W.unboundedPreceding, -1)) > slack + F.col("n")
    cut = banded.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(order))
    along = W.partitionBy(*key, "template", "band", "run").orderBy("start", "t_at").rowsBetween(W.unboundedPreceding, -1)
    counts = F.coalesce(F.col("t_at") > F.max("t_at").over(along), F.lit(True))
    verified = cut.withColumn("counts", counts).groupBy(*key, "n_words", "template", "label", "grams", "share", "base", "band", "run")
    made = verified.agg(F.count(F.when(F.col("counts"), 1)).alias("votes"), F.min("start").alias("start"), (F.max("start") + F.first("n")).alias("stop"))
    made = made.withColumn("score", F.col("votes") / F.col("grams")).where("score >= share")
    cols = [*key, "n_words", "template", "label", "base", "start", "stop", "score"]
    return made.select(*cols).unionByName(hits.where("start < 0").select(*key, "n_words", F.lit(1).alias("own")), allowMissingColumns=True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a title phrase stands; first_word and last_word are their smallest
    and largest start in words from 0, null without any. labels are those of phrases and of
    license texts that are there in good part; score is the best run's share of its template, 0 without one.
    Null and empty texts have no words. Repeated rows come back as often as they came, rows without an id too.
    """
    keys = [F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")]
    found = runs(docs, text_col, keys, known)
    base = F.col("base")
    out = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count("own").cast("int").alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("text_key", "copies", "__copy")
