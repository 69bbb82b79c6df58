import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, ordering, sets


def alike(a, b):
    return len(a & b) / len(a | b)


def held(spark, groups):
    return spark.createDataFrame([(o, e) for o, s in groups.items() for e in s], "o long, e string")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 1.0])
def test_links_and_pairs_agree_with_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    groups = {o: frozenset(rng.sample("abcdefghijklmnopqrst", rng.randint(1, 9))) for o in range(60)}
    groups |= {100 + i: frozenset(groups[i % 7]) for i in range(20)} | {200 + i: groups[i] | {"a"} for i in range(20)} | {300: frozenset("abcdefghij"), 301: frozenset("abcdefg"), 302: frozenset("abcdefgh")}
    want = {(a, b): alike(groups[a], groups[b]) for a, b in itertools.combinations(sorted(groups), 2) if alike(groups[a], groups[b]) >= threshold}
    rows = held(spark, groups)
    got = sets.jaccard_pairs(rows.unionByName(rows.limit(9)), "o", "e", threshold).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == pytest.approx(want)
    links = {r.id: (r.class_id, r.copies, r.links) for r in sets.jaccard_links(rows, "o", "e", threshold).collect()}
    equal = {o: [x for x in groups if groups[x] == groups[o]] for o in groups}
    assert links == {o: (min(equal[o]), len(equal[o]), sum(1 for p in want if o in p)) for o in groups}


def test_copies_and_frequent_elements_make_no_pairs(spark):
    """1,000 copies of one set are compared as one; 500 sets that share their most frequent element only never meet."""
    groups = {i: frozenset("xyz") for i in range(1000)} | {1000 + i: frozenset({"x", f"own{i}"}) for i in range(500)}
    classes = sets.set_classes(held(spark, groups), "o", "e")
    assert classes.sets.count() == 501 and sets.similar_classes(classes, 0.5).count() == 0
    links = sets.jaccard_links(held(spark, groups), "o", "e", 0.5)
    assert {tuple(r) for r in links.groupBy("class_id", "copies", "links").count().where("copies > 1").collect()} == {(0, 1000, 999, 1000)}


def test_empty_and_null_sets(spark):
    none = spark.createDataFrame([], "o long, e string")
    assert sets.jaccard_links(none, "o", "e", 0.5).count() == 0 and sets.jaccard_pairs(none, "o", "e", 0.5).count() == 0
    rows = spark.createDataFrame([(None, "a"), (1, None), (2, "a"), (2, "a")], "o long, e string")
    assert [tuple(r) for r in sets.jaccard_links(rows, "o", "e", 0.5).collect()] == [(2, 2, 1, 0)]


def test_a_frequent_group_is_numbered_in_several_tasks(spark):
    rng = random.Random(4)
    rows = [("hot", i) for i in range(3000)] + [(g, i) for g in ("a", "z", None) for i in range(40)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, i long")
    got = ordering.placed_within(table, "g", "i").collect()
    assert {(r.g, r.i): (r.nth, r.n) for r in got} == {(g, i): (i + 1, 3000 if g == "hot" else 40) for g, i in rows}
    assert ordering.placed_within(table.limit(0), "g", "i").count() == 0
    lists = spark.createDataFrame([(1, ["b", "a", "b", "", None]), (2, ["b"]), (3, None)], "id long, t array<string>")
    assert {tuple(r) for r in aggregates.group_by_element(lists, F.col("t"), "id").select("element", "member", "nth", "n").collect()} == {("a", 1, 1, 1), ("b", 1, 1, 2), ("b", 2, 2, 2)}


@pytest.mark.parametrize(("threshold", "few"), [(0.2, 2), (0.5, 2), (0.5, 4), (0.6, 4), (0.6, 12), (0.9, 6)])
def test_sets_on_both_sides_of_the_bound_meet(spark, threshold, few):
    rng = random.Random(few)
    groups = {o: frozenset(rng.sample("abcdefghijkl", rng.randint(1, 8))) for o in range(90)}
    found = sets.similar_classes(sets.set_classes(held(spark, groups), "o", "e"), threshold, few).collect()
    first = {s: min(o for o in groups if groups[o] == s) for s in groups.values()}
    want = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if alike(a, b) >= threshold}
    assert len(found) == len(want) and {tuple(sorted((r.x, r.y))) for r in found} == want


def test_one_frequent_element_makes_no_candidates(spark, tmp_path):
    """1,500 sets of four from forty elements: what is written on the way to links was over a hundred thousand candidates."""
    rng = random.Random(1)
    groups = {o: frozenset(rng.sample(range(40), 4)) for o in range(1500)}
    table = spark.createDataFrame([(o, e) for o, s in groups.items() for e in s], "o long, e long")
    classes, cut, rows = sets.set_classes(table, "o", "e"), sets.durable, []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    sets.durable = counted
    try:
        links = sets.similar_classes(classes, 0.6).count()
    finally:
        sets.durable = cut
    assert links <= rows[0] < 15 * links


def test_what_is_kept_on_the_way_is_compressed(spark):
    """20,000 sets of four: checkpoints of their rows and classes took 3.5 MB."""
    import os

    from millrace.operators.durable import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    rng = random.Random(4)
    table = spark.createDataFrame([(o, rng.randrange(30_000)) for o in range(20_000) for _ in range(4)], "o long, e long")
    before = size()
    classes = sets.set_classes(table, "o", "e")
    assert classes.owners.count() == 20_000 and 0 < size() - before < 2_500_000


def test_crowded_keys(spark):
    from millrace.operators.durable import crowded_keys

    rows = spark.range(3000).selectExpr("if(id < 500, -1, if(id < 560, null, id)) as k")
    assert {(r.k, r["__n"]) for r in crowded_keys(rows, ["k"], 40, 16).collect()} == {(-1, 500)}  # the limit is twice the mean of 188 rows a slot
    assert {(r.k, r["__n"]) for r in crowded_keys(rows, ["k"], 40, 1 << 14).collect()} == {(-1, 500), (None, 60)}
    assert crowded_keys(rows, ["k"], 600).isEmpty() and crowded_keys(rows.limit(0), ["k"], 1).isEmpty()
