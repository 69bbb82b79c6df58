"""Rings out of unordered, reversible ways: ends are paired where they meet, then ways are ranked along the lists they form.

A way can be walked in two directions, and each walk leads on to at most one other: that of the way whose
end is paired with the walk's last point. So every ring or chain is two lists of walks, one the reverse
of the other. Pointer doubling finds each walk's last one and its distance in points; for rings, which
have no last walk, it first finds the least way and the lists are cut there. Rounds grow with the logarithm
of an owner's number of ways; no owner, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.durable import durable

_KEY = ["owner", "way", "back"]


def _walks(ways: DataFrame) -> DataFrame:
    """(owner, way, back, next_way, next_back, span): each walk of a way and the one it leads to, with that one's length in points less one.

    Of the ends that meet in a point the first pairs with the second, the third with the fourth, and so
    on, in order of the ways; an end left over leads nowhere. A way that is closed by itself leads to itself.
    """
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    tips = F.array(F.struct(F.lit(0).alias("tip"), first.alias("at")), F.struct(F.lit(1).alias("tip"), last.alias("at")))
    ends = ways.where(first != last).select("owner", "way", "span", F.inline(tips))
    meet = W.partitionBy("owner", "at").orderBy("way", "tip")
    odd = F.row_number().over(meet) % 2 == 1
    other = {c: F.when(odd, F.lead(c).over(meet)).otherwise(F.lag(c).over(meet)) for c in ("way", "tip", "span")}
    paired = ends.select("owner", "way", (1 - F.col("tip")).alias("back"), other["way"].alias("next_way"), other["tip"].alias("next_back"), other["span"].alias("next_span"))
    alone = ways.where(first == last).select("owner", "way", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), F.col("way").alias("next_way"), "span")
    return paired.unionByName(alone.select("owner", "way", "back", "next_way", F.col("back").alias("next_back"), F.col("span").alias("next_span")))


def _ranked(walks: DataFrame, rounds: int) -> DataFrame:
    """(owner, way, back, to_way, to_back, steps, span, least, done): the last walk of each walk's list, how many walks and points lie between, the least way met; done is false in a ring."""
    ends = F.col("next_way").isNull()
    state = walks.select(
        *_KEY,
        F.coalesce("next_way", "way").alias("to_way"),
        F.coalesce("next_back", "back").alias("to_back"),
        F.when(ends, 0).otherwise(1).cast("long").alias("steps"),
        F.when(ends, 0).otherwise(F.col("next_span")).cast("long").alias("span"),
        F.least("way", "next_way").alias("least"),
        ends.alias("done"),
    )
    state = durable(state)
    for _ in range(rounds):
        ahead = state.select("owner", *[F.col(c).alias(f"__{c}") for c in state.columns if c != "owner"])
        met = state.where(~F.col("done")).alias("s").join(ahead.alias("t"), (F.col("s.owner") == F.col("t.owner")) & (F.col("to_way") == F.col("__way")) & (F.col("to_back") == F.col("__back")))
        moved = met.select(
            *[F.col(f"s.{c}").alias(c) for c in _KEY],
            F.col("__to_way").alias("to_way"),
            F.col("__to_back").alias("to_back"),
            (F.col("steps") + F.col("__steps")).alias("steps"),
            (F.col("span") + F.col("__span")).alias("span"),
            F.least("least", "__least").alias("least"),
            F.col("__done").alias("done"),
        )
        state = durable(state.where("done").unionByName(moved))
        if state.where(~F.col("done")).isEmpty():
            break
    return state


def assembled(ways: DataFrame, owner: str, way: str, points: str) -> DataFrame:
    """(owner, ring, closed, position, point) of ways joined end to end.

    ways: a row per way, points an array of two or more (shorter ones are left out), way unique within its
    owner. ring is the least way of a closed ring, which starts with that way as it is given and ends in
    its first point again. Chains that don't close are kept: ring is then the lesser of the ways at their
    ends, and they start there.
    """
    rows = ways.where(F.size(points) > 1).select(F.col(owner).alias("owner"), F.col(way).alias("way"), F.col(points).alias("points"))
    sized = rows.withColumn("span", (F.size("points") - 1).cast("long"))
    walks = durable(_walks(sized))
    most = walks.groupBy("owner").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = (most // 2).bit_length() + 1
    state = _ranked(walks, rounds)
    open_ = state.where("done").groupBy("owner", "way").agg(*[F.max(F.when(F.col("back") == b, F.struct("to_way", "steps", "span"))).alias(f"w{b}") for b in (0, 1)])
    ahead = F.col("w1.to_way") <= F.col("w0.to_way")  # the reverse walk ends where this one starts
    start = F.when(ahead, F.col("w1")).otherwise(F.col("w0"))
    chains = open_.select("owner", "way", start["to_way"].alias("ring"), F.lit(False).alias("closed"), (~ahead).alias("flipped"), start["steps"].alias("rank"), start["span"].alias("offset"))
    around = state.where(~F.col("done")).select(*_KEY, "least")
    cut = walks.join(around, _KEY).withColumn("stop", (F.col("way") == F.col("least")) & (F.col("back") == 1))
    cut = cut.select(*_KEY, *[F.when(~F.col("stop"), F.col(c)).alias(c) for c in ("next_way", "next_back", "next_span")])
    loops = _ranked(cut, rounds).where("done").select("owner", "way", F.col("to_way").alias("ring"), F.lit(True).alias("closed"), (F.col("back") == 0).alias("flipped"), F.col("steps").alias("rank"), F.col("span").alias("offset"))
    placed = chains.unionByName(loops).join(rows, ["owner", "way"])
    laid = placed.select("owner", "ring", "closed", "rank", "offset", F.posexplode(F.when(F.col("flipped"), F.reverse("points")).otherwise(F.col("points"))).alias("i", "point"))
    return laid.where("rank = 0 OR i > 0").select(F.col("owner").alias(owner), "ring", "closed", (F.col("offset") + F.col("i")).alias("position"), "point")
