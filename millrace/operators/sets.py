"""Set operations keyed by id."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.durable import crowded_keys, salted_join
from millrace.operators.durable import stored as durable


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order. An aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return last.select(*key, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def window_replace(old: DataFrame, new: DataFrame, key: str, month: Column, since: str) -> DataFrame:
    """old before `since` without the ids that new has, and all of new, older rows of it too."""
    return old.where(month < since).join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def full_overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both; where both have one, right's row."""
    return right.unionByName(left.join(right.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


class Classes(NamedTuple):
    """owners (id, rep): the least owner of the set that each owner has. sets (rep, copies, s, n): different sets and how many owners have them."""

    owners: DataFrame
    sets: DataFrame


def set_classes(members: DataFrame, owner: str, element: str) -> Classes:
    """Owners by equal sets of elements; null owners and elements and repeated rows are left out. Elements stand from rare to frequent."""
    pairs = members.select(F.col(owner).alias("o"), F.col(element).alias("e")).where("o is not null and e is not null")
    lists = pairs.groupBy(F.col("o").alias("id")).agg(F.collect_set("e").alias("s"))
    owners = durable(_rare_first(lists, pairs))
    different = durable(owners.groupBy("s").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    several = different.where("copies > 1")
    named = salted_join(owners, several.select("s", "rep"), ["s"], per=several.select("s", F.col("copies").alias("__n"))).select("id", "rep")
    alone = different.where("copies = 1").select(F.col("rep").alias("id"), "rep")
    return Classes(durable(named.unionByName(alone)), different.select("rep", "copies", "s", F.size("s").alias("n")))


def _rare_first(lists: DataFrame, pairs: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """lists (id, s) with elements from rare to frequent, by the rows that their slot has in pairs; any order of all elements would do, this one makes the least candidates."""
    slot = lambda e: F.pmod(F.xxhash64(e), F.lit(slots)).cast("int")
    got = pairs.groupBy(slot("e").alias("slot")).agg(F.count("*").alias("n")).toArrow()  # `slots` rows at most
    counts = np.zeros(slots, np.int64)
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    sent = lists.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cuts = b.column(2).flatten().to_numpy(), np.cumsum([0, *b.column(2).value_lengths().to_pylist()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(sent.value[at]))], ["id", "s", "f"])

    kinds = dict(lists.dtypes)
    counted = lists.select("id", "s", F.transform("s", slot).alias("at")).mapInArrow(run, f"id {kinds['id']}, s {kinds['s']}, f array<long>")
    return counted.select("id", F.transform(F.array_sort(F.arrays_zip("f", "s")), lambda x: x["s"]).alias("s"))


def similar_classes(classes: Classes, threshold: float, few: int = 12) -> DataFrame:
    """(x, y, similarity) of different sets, by least owner, that overlap by at least the threshold (over 0); the smaller set is x.

    Prefix filter: the smaller of two sets that similar has at least 2t / (1 + t) of its elements in the other, so
    one of its rarest must be among the other's rarest. Sets of `few` elements at most are filed under two elements at once, the
    first two that a pair shares: what has one frequent element in common is no candidate then. Single elements
    stay for larger sets, of which there would be too many twos, and for pairs of which one shared element is enough. The place of the
    last of these bounds what two sets can still share. Keys are shuffled once for both sides, and meet inside their group; those under which
    many sets are filed are joined instead, dealt to several tasks.
    """
    t, n, less = float(threshold), F.col("n"), 1e-9  # rounding must not lengthen what is required

    def keyed(keys: int, asks: Column, files: Column) -> DataFrame:
        """(k, rep, n, rest, asks, files) per key of one or two elements: its hash, even for two, the set, its size, what it can share from the key on, the key included, and the sides it is on."""
        length = lambda least, on: F.when(on, F.greatest(n - F.greatest(F.ceil(n * least - less).cast("int"), F.lit(keys)) + keys, F.lit(0))).otherwise(0)
        sets = classes.sets.select("rep", "n", "s", length(t, asks).alias("la"), length(2 * t / (1 + t), files).alias("lf"))
        at = sets.select("rep", "n", "s", "la", "lf", F.posexplode(F.slice("s", F.lit(1), F.greatest("la", "lf"))).alias("i", "e"))
        if keys == 1:
            at = at.withColumn("k", F.xxhash64("e").bitwiseOR(F.lit(1)))
        else:
            at = at.where("i > 0").withColumn("k", F.explode(F.transform(F.slice("s", F.lit(1), F.col("i")), lambda d: F.xxhash64(d, "e").bitwiseAND(F.lit(-2)))))
        return at.select("k", "rep", "n", (n - F.col("i") + keys - 1).alias("rest"), (F.col("i") < F.col("la")).alias("asks"), (F.col("i") < F.col("lf")).alias("files"))

    few_needed = lambda least: F.ceil(n * least - less) <= 1
    rows = keyed(1, (n > few) | few_needed(t), (n >= t * (few + 1) - less) | few_needed(2 * t / (1 + t)))
    rows = rows.unionByName(keyed(2, n.between(2, few), n.between(2, few)))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    need = t / (1 + t) * (F.col("nx") + F.col("ny")) - less
    may = smaller & (F.col("ny") * t <= F.col("nx") + less) & (F.least("restx", "resty") >= need) & ((F.col("k") % 2 == 0) | (need <= 1) | (F.col("ny") > few))
    packed = F.shiftleft(F.shiftleft(n.cast("long"), 30) + F.col("rest"), 2) + F.col("asks").cast("int") * 2 + F.col("files").cast("int")  # one column, since a row of each key is shuffled
    opened = lambda v, own: [v["rep"].alias(own), F.shiftright(v["m"], 32).cast("int").alias(f"n{own}"), F.shiftright(v["m"], 2).bitwiseAND(F.lit((1 << 30) - 1)).cast("int").alias(f"rest{own}")]
    rows, y, x = rows.select("k", "rep", packed.alias("m")), F.col("m").bitwiseAND(F.lit(2)) != 0, F.col("m").bitwiseAND(F.lit(1)) != 0
    hot = crowded_keys(rows, ["k"], 1_000)
    crowded = not hot.isEmpty()
    held = (rows.join(F.broadcast(hot), "k", "left_anti") if crowded else rows).repartition("k").groupBy("k").agg(F.collect_list(F.struct("rep", "m")).alias("g")).where(F.size("g") > 1)
    on = lambda bit: F.filter("g", lambda v: v["m"].bitwiseAND(F.lit(bit)) != 0)
    each = held.select("k", on(1).alias("f"), F.explode(on(2)).alias("a")).select("k", "a", F.explode("f").alias("f"))
    met = each.select("k", *opened(F.col("a"), "y"), *opened(F.col("f"), "x")).where(may).select("x", "y")
    if crowded:
        side = lambda on, own: rows.where(on).join(F.broadcast(hot.select("k")), "k", "left_semi").select("k", *opened(F.struct("rep", "m"), own))
        met = met.unionByName(salted_join(side(y, "y"), side(x, "x"), ["k"], per=hot).where(may).select("x", "y"))
    cand = durable(met.distinct())  # at their first common key they pass
    left, right = classes.sets.select(F.col("rep").alias("x"), F.col("s").alias("sx")), classes.sets.select(F.col("rep").alias("y"), F.col("s").alias("sy"))
    shared = F.size(F.array_intersect("sx", "sy"))
    both = salted_join(cand, left, ["x"]).join(right, "y").withColumn("similarity", shared / (F.size("sx") + F.size("sy") - shared))
    return both.where(F.col("similarity") >= threshold).select("x", "y", "similarity")


def jaccard_links(members: DataFrame, owner: str, element: str, threshold: float) -> DataFrame:
    """(id, class_id, copies, links): each owner, the least owner of an equal set, how many have it, and how many other owners' sets overlap by at least the threshold, equal ones among them.

    Sets are compared once, whatever the number of their copies; these are only counted.
    """
    classes = set_classes(members, owner, element)
    near = durable(similar_classes(classes, threshold))
    size = classes.sets.select(F.col("rep").alias("other"), "copies")
    ends = near.select(F.col("x").alias("rep"), F.col("y").alias("other")).unionByName(near.select(F.col("y").alias("rep"), F.col("x").alias("other")))
    found = salted_join(ends, size, ["other"]).groupBy("rep").agg(F.sum("copies").alias("linked"))
    about = classes.sets.select("rep", "copies").join(found, "rep", "left")
    links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    return salted_join(classes.owners, about, ["rep"]).select("id", F.col("rep").alias("class_id"), "copies", links.alias("links"))


def jaccard_pairs(members: DataFrame, owner: str, element: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of owners whose element sets overlap by at least the threshold, a < b. Different sets are compared, then owners put in their place: where many are equal, `jaccard_links` says as much in a row each."""
    classes = set_classes(members, owner, element)
    equal = classes.sets.where("copies > 1").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("similarity"))
    near = similar_classes(classes, threshold).unionByName(equal)
    named = lambda c, a: classes.owners.select(F.col("rep").alias(c), F.col("id").alias(a))
    met = near.join(named("x", "p"), "x").join(named("y", "q"), "y").where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
