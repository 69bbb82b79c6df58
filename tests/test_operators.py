"""Operators against plain versions on small tables, with nulls, ties, repeats and empty input."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, geometry, numeric, text
from millrace.operators import aggregates, clusters, evaluation, quadtree, sequences, series, sets, spatial
from millrace.plans import catalog
from millrace.sources import readers, writers
from millrace.streaming import incremental


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def greedy(nodes, edges):
    near = {n: {b for e in edges for a, b in (e, e[::-1]) if a == n and b != n} for n in nodes}
    free, out = set(nodes), {}
    while free:
        seed = min(free, key=lambda n: (-len(near[n] & free), n))
        for n in {seed} | near[seed] & free:
            out[n] = seed
        free -= out.keys()
    return out


@pytest.mark.parametrize("links", [0, 12, 60])
def test_medoid_clusters_take_the_one_by_one_order(spark, links):
    rng = random.Random(links)
    nodes = list(range(30))
    edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(links)})
    got = clusters.medoid_clusters(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.seed for r in got.collect()} == greedy(nodes, edges)


def test_jaccard_pairs(spark):
    rng = random.Random(1)
    groups = {o: set(rng.sample(range(12), rng.randint(1, 6))) for o in range(40)}
    rows = [(o, e) for o, s in groups.items() for e in s]
    got = sets.jaccard_pairs(spark.createDataFrame([*rows, *rows[:9], (None, 1), (3, None)], "o long, e long"), "o", "e", 0.4)
    want = {(a, b): len(groups[a] & groups[b]) / len(groups[a] | groups[b]) for a, b in itertools.combinations(groups, 2)}
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items() if v >= 0.4}


def test_upsert_and_merges(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b"), (2, 1, "b")], "id long, v int, s string")
    assert sorted(map(tuple, sets.upsert(rows, ["id"], ["v"]).collect())) == [(1, 2, None), (2, 1, "b")]
    old = spark.createDataFrame([(1, "2024-01"), (2, "2024-02"), (3, "2024-03")], "id long, m string")
    new = spark.createDataFrame([(1, "2024-04"), (9, "2024-03")], "id long, m string")
    assert sorted(map(tuple, sets.window_replace(old, new, "id", F.col("m"), "2024-03").collect())) == [(1, "2024-04"), (2, "2024-02"), (9, "2024-03")]
    assert sorted(map(tuple, sets.full_overlay(old, new, "id").collect())) == [(1, "2024-04"), (2, "2024-02"), (3, "2024-03"), (9, "2024-03")]
    assert sets.missing(old, new, "id").count() == 2
    assert sets.upsert(rows.limit(0), ["id"], ["v"]).count() == 0


def test_sequences(spark):
    rows = spark.createDataFrame([("t", i, v) for i, v in enumerate("aabbbca")] + [("u", 0, None), ("u", 1, None)], "k string, i int, v string")
    got = sequences.islands(rows, "v", ["k"], ["i"]).orderBy("k", "island").collect()
    assert [(r.k, r.v, r.n) for r in got] == [("t", "a", 2), ("t", "b", 3), ("t", "c", 1), ("t", "a", 1), ("u", None, 2)]
    even = rows.where("k = 't'").select(sequences.trailing_mean("i", [F.lit(0)], ["i"]).alias("m"), "i").orderBy("i").collect()
    assert [r.m for r in even] == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0]
    track = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 4.0, 0.0), ("a", 2, 4.0, 4.0), ("b", 0, 7.0, 7.0), ("b", 1, 7.0, 7.0)], "t string, s int, x double, y double")
    at = {(r.t, r.i): (r.x, r.y) for r in sequences.resampled(track, "t", "s", "x", "y", 4).collect()}
    assert at == {("a", 0): (0, 0), ("a", 1): (2, 0), ("a", 2): (4, 0), ("a", 3): (4, 2), **{("b", i): (7, 7) for i in range(4)}}


def test_aggregates(spark):
    rows = spark.createDataFrame([("x", "Skipper"), ("x", None), ("y", "PENDING later"), ("z", "Cancelled"), ("w", None)], "k string, s string")
    role, status = aggregates.status_precedence(F.col("s"))
    assert {r.k: (r.a, r.b) for r in rows.groupBy("k").agg(role.alias("a"), status.alias("b")).collect()} == {"x": ("s", "c"), "y": ("c", "p"), "z": ("c", "x"), "w": ("c", "u")}
    shares = spark.createDataFrame([(6.0, ["a", "b"]), (1.0, ["a"]), (2.0, [])], "v double, r array<string>")
    assert {r.target: r.allocated for r in aggregates.fractional_allocation(shares, F.col("v"), "r").collect()} == {"a": 4.0, "b": 3.0, None: 2.0}
    assert aggregates.page_links(9, 1) == [1, 2, 3] and aggregates.page_links(9, 9) == [7, 8, 9]


def test_spatial_joins(spark):
    rng = random.Random(5)
    pts, tgt = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(80)], [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(40)]
    p, t = spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(tgt, "tid long, x double, y double")
    want = {(a, b): math.dist((x, y), (u, v)) for a, x, y in pts for b, u, v in tgt if math.dist((x, y), (u, v)) <= 2}
    assert {(r.pid, r.tid) for r in spatial.near_points(p, t, 2.0).collect()} == set(want)
    best = {a: min((d, -b) for (c, b), d in want.items() if c == a)[1] * -1 for a in {a for a, _ in want}}
    assert {r.pid: r.tid for r in quadtree.nearest_within(p, t, 2.0).collect()} == best
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    test = spatial.in_region(F.col("x"), F.col("y"), [square], [hole])
    got = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (5.0, 1.0)], "x double, y double").select(test.alias("t")).collect()
    assert [r.t for r in got] == [True, False, False]


def test_tracks(spark):
    # the published example of the format
    points, coded = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    df = spark.createDataFrame([([dict(lat=a, lon=b) for a, b in points],), ([],), (None,)], f"t {geometry.POINTS}")
    assert [r[0] for r in df.select(geometry.polyline_encode("t")).collect()] == [coded, "", None]
    back = spark.createDataFrame([(coded,)], "s string").select(geometry.polyline_decode("s")).first()[0]
    assert [(p.lat, p.lon) for p in back] == points
    bent = [(44.0, -71.0), (44.0, -71.001), (44.00001, -71.002), (44.01, -71.002), (44.01, -71.003)]
    simple = spark.createDataFrame([([dict(lat=a, lon=b) for a, b in bent],)], f"t {geometry.POINTS}").select(geometry.simplifier(20.0)("t").alias("s")).first().s
    assert [(p.lat, p.lon) for p in simple] == [bent[0], bent[2], bent[3], bent[4]]
    dense = spark.createDataFrame([([dict(lat=44.0, lon=-71.0), dict(lat=44.001, lon=-71.0)],)], f"t {geometry.POINTS}").select(geometry.densified(F.col("t"), 30.0).alias("s")).first().s
    assert len(dense) == 5 and dense[-1].lat == 44.001
    assert one(spark, geometry.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] == pytest.approx(math.pi * geometry.EARTH_M)
    assert one(spark, geometry.cell_truncated(F.lit(-0.5), 1.0), geometry.cell_floor(F.lit(-0.5), 1.0)) == (0, -1)


def test_tracks_of_the_catalog(spark, sf):
    rows = catalog.queries()["polyline_roundtrip"](spark, sf).collect()
    assert rows and all(r.points == 31 for r in rows)
    assert all(2 <= r.kept <= 31 <= r.dense for r in catalog.queries()["simplify_track"](spark, sf).collect())
    assert all(r.points == 16 for r in catalog.queries()["resampled_tracks"](spark, sf).collect())


def test_evaluation(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0.1, 0.3, 0.5, 0.7, 0.9]), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s double, y int")
    pairs = [(p > n) + 0.5 * (p == n) for p, a in rows for n, b in rows if a == 1 and b == 0]
    assert evaluation.auc(df, "s", "y").first().roc_auc == pytest.approx(sum(pairs) / len(pairs))
    swept = {round(r.threshold, 6): (r.tp, r.fp, r.fn, r.tn) for r in evaluation.sweep(df, "s", "y", 0.1, 0.9, 5).collect()}
    for t in swept:
        n = lambda f: sum(map(f, rows))  # noqa: E731, B023
        assert swept[t] == (n(lambda r: r[0] >= t and r[1]), n(lambda r: r[0] >= t and not r[1]), n(lambda r: r[0] < t and r[1]), n(lambda r: r[0] < t and not r[1]))  # noqa: B023
    none = evaluation.confusion(df.limit(0), "s", "y", 0.5).first()
    assert (none.tp, none.precision, none.recall, none.f1) == (0, 0, 0, 0)
    floor = evaluation.best_recall(evaluation.sweep(df, "s", "y", 0.1, 0.9, 5), 0.0).first()
    assert floor.threshold == pytest.approx(0.1) and floor.recall == 1


def test_out_of_fold_never_splits_a_group(spark):
    rng = random.Random(2)
    rows = [(i, f"g{i % 11}", float(i % 2 + rng.random()), None if i % 9 == 0 else rng.random(), float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, grp string, a double, b double, y double")
    got = evaluation.out_of_fold(df, ["a", "b"], "y", "grp", folds=3, trees=3).collect()
    assert sorted(r.id for r in got) == list(range(120))
    assert all(len({r.fold for r in got if r.grp == g}) == 1 for g in {r.grp for r in got})
    assert sum((r.score > 0.5) == (r.y == 1) for r in got) > 100


def test_scalar_functions(spark):
    assert one(spark, text.pace(F.lit(599.7)), text.duration(F.lit(3599.0)), text.pace(F.lit(None).cast("double"))) == ("10:00/mi", "1:00", "—")
    assert one(spark, text.slugify(F.lit(" A b--C! ")), text.padded_date(F.lit("w_2024-3-7.csv")), text.truthy(F.lit(None).cast("string"))) == ("a-b-c", "2024-03-07", False)
    assert one(spark, text.display_name(F.lit(" ann mary "), F.lit("lee")), text.display_name(F.lit(None).cast("string"), F.lit(""))) == ("Ann Mary L.", "")
    assert one(spark, numeric.significant(F.lit(1234.0)), numeric.significant(F.lit(0.0)), numeric.finite(F.lit(float("nan"))), numeric.clamp(F.lit(200.0), 0, 168)) == (1200.0, 0.0, None, 168.0)
    assert one(spark, numeric.elevation_feet(F.lit("100 m")), numeric.elevation_feet(F.lit("high")), numeric.ratio(F.lit(1.0), F.lit(0.0))) == (328, None, None)
    assert one(spark, dates.add_months(F.lit("2024-11"), 3), dates.bib_month(F.lit("sept")), dates.bib_month(F.lit("?")), dates.bib_month(F.lit("7"))) == ("2025-02", "09", "01", "07")
    assert one(spark, dates.in_season(F.lit("2024-01-05").cast("date")), dates.in_season(F.lit("2024-07-05").cast("date"))) == (True, False)
    assert one(spark, text.escape_html(F.lit("<a & 'b'>")), text.strip_html(F.lit("<p>x<script>y</script></p>")), text.read_time(F.lit(500))) == ("&lt;a &amp; &#39;b&#39;&gt;", "x", "3")


def test_series(spark):
    rows = spark.createDataFrame([("a", 2, 5.0), ("a", 1, None), ("b", 1, 0.0)], "k string, x int, y double")
    arrays = series.to_arrays(rows, ["k"], "x", "y")
    assert {r.k: (r.x, r.y) for r in arrays.collect()} == {"a": ([1, 2], [None, 5.0]), "b": ([1], [0.0])}
    assert sorted(map(str, series.to_rows(arrays, ["k"]).collect())) == sorted(map(str, rows.collect()))
    assert {r.k for r in arrays.where(series.not_all_zero(F.col("y"))).collect()} == {"a"}
    maps = spark.createDataFrame([({"t": [1.0]}, {"t": [9.0], "u": [None], "v": [2.0, None]})], "m map<string,array<double>>, n map<string,array<double>>")
    got = maps.select(series.merged_series(F.col("m"), F.col("n")).alias("a"), series.merged_series(F.col("m"), F.col("n"), True).alias("b")).first()
    assert got.a == {"t": [1.0], "v": [2.0, None]} and got.b == {"t": [9.0], "v": [2.0, None]}


def test_readers(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "2024-3-07.csv").write_text("a,b\n1,nan\n2,3.5\n")
    got = readers.dated_csv(spark, str(tmp_path / "w"), "a int, b double").orderBy("a").collect()
    assert [(r.a, r.b, str(r.date), r.month, r.day) for r in got] == [(1, None, "2024-03-07", 3, 7), (2, 3.5, "2024-03-07", 3, 7)]
    (tmp_path / "t.tsv").write_text("x\ty\nq\t1\n")
    assert tuple(readers.tsv(spark, str(tmp_path / "t.tsv")).first()) == ("q", 1)
    (tmp_path / "k.json").write_text(json.dumps({"acts": {"7": {"d": 1.5}, "8": {"d": None}}}))
    assert sorted(map(tuple, readers.keyed_json(spark, str(tmp_path / "k.json"), "struct<d:double>", "acts").collect())) == [("7", 1.5), ("8", None)]
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "p.md").write_text("---\ntitle: \"T: x\"\ndate: 2024-01-02\n---\nBody\n")
    row = readers.front_matter(spark, str(tmp_path / "p.md"), ["title", "date", "venue"]).first()
    assert (row.title, row.date, row.venue, row.body.strip()) == ("T: x", "2024-01-02", None, "Body")
    (tmp_path / "r.bib").write_text("@article{k1, title = {A {B} c}, author = {Doe, Ann and Bo Roe}, journal = \"J\", year = 2020}\n")
    row = readers.bibtex(spark, str(tmp_path / "r.bib")).first()
    assert (row.key, row.title, row.venue, row.year, [(a.first, a.last) for a in row.authors]) == ("k1", "A {B} c", "J", "2020", [("Ann", "Doe"), ("Bo", "Roe")])
    with pytest.raises(RuntimeError):
        readers.secret("MILLRACE_NOT_SET", must=True)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "d1"), (2, None, "d1")], "id long, v string, updated string")
    path = str(tmp_path / "out")
    assert writers.write_if_changed(df, path)
    assert not writers.write_if_changed(df.withColumn("updated", F.lit("d2")), path)
    assert writers.write_if_changed(df.withColumn("v", F.lit("z")), path)
    writers.write_json_lines(df, str(tmp_path / "j"), "id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_dated_csv(df.withColumn("n", F.lit(1)), str(tmp_path / "c"), "updated", "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_stream_upkeep_equals_batch(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "table"
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    frames = [spark.createDataFrame(rows[k : k + 20], "id long, n long, s string") for k in (0, 20)]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = incremental.keep_latest(stream, str(table), ["id"], ["n"], str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = sorted(map(tuple, incremental.kept(spark, str(table), frames[0].schema).select("id", "n", "s").collect()))
    assert got == sorted(map(tuple, sets.upsert(frames[0].union(frames[1]), ["id"], ["n"]).collect()))


def test_exact_medians(spark):
    import statistics

    rng, inf = random.Random(1), float("inf")
    sets = ([5.0], [1.0, 2.0], [rng.gauss(0, 1) for _ in range(501)], [3.0] * 40 + [7.0] * 40, [10.0 ** rng.randrange(9) for _ in range(400)], [inf] * 30 + [1.0, 2.0] * 9, [-inf] * 30 + [float(i) for i in range(31)], [inf] * 25 + [-inf] * 25 + [0.5], [1e-300 * i for i in range(77)] + [inf], list(map(float, range(20))), [])
    data = [(i, v) for i, vs in enumerate(sets) for v in vs] + [(0, None), (2, float("nan")), (99, None)]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "g int, v double")
    want = {i: statistics.median(vs) for i, vs in enumerate(sets) if vs}
    for few, cuts, small in ((10, 4, 10**6), (10, 4, 0), (10_000, 64, 10**6)):
        assert {r.g: r.median for r in aggregates.group_medians(rows, ["g"], "v", few, cuts, small).collect()} == want
    for i in (2, 5, 7):
        assert aggregates.exact_median(rows.where(F.col("g") == i), "v", few=10, cuts=4) == want[i]
    assert aggregates.exact_median(rows.limit(0), "v") is None


def test_regression_learns_a_step(spark):
    rows = spark.createDataFrame([(i, float(i % 20), 100.0 if i % 20 > 9 else 0.0) for i in range(600)], "g long, x double, y double")
    got = evaluation.regression(rows, ["x"], "y", "g", trees=3).first()
    assert got.n == 600 and got.r2 > 0.95 and got.mae < 10


def test_auc_of_continuous_scores(spark):
    import random

    rng = random.Random(2)
    data = [(rng.random() ** 3, int(rng.random() < 0.3)) for _ in range(400)] + [(0.5, 1), (0.5, 0)]
    pairs = [(a > b) + (a == b) / 2 for a, x in data if x for b, y in data if not y]
    got = evaluation.auc(spark.createDataFrame(data, "s double, y int"), "s", "y", cells=7).first()
    assert abs(got.roc_auc - sum(pairs) / len(pairs)) < 1e-9


def test_two_digit_years(spark):
    rows = spark.createDataFrame([("1/2/98",), ("12/31/05",), ("x",), (None,)], "s string")
    assert [str(r.d) for r in rows.select(dates.short_date(F.col("s")).alias("d")).collect()] == ["1998-01-02", "2005-12-31", "None", "None"]


def test_clusters_of_equal_sets_are_those_of_single_ones(spark):
    """Equal sets go as one weighted node; every order's seed is that of the one-by-one order over all pairs. Before, all pairs of copies were made."""
    rng = random.Random(9)
    groups = {o: frozenset(rng.sample(range(12), rng.randint(1, 4))) for o in range(40)}
    groups |= {100 + i: groups[i % 9] for i in range(30)}
    table = spark.createDataFrame([(o, e) for o, s in groups.items() for e in s] + [(999, 1)], "o long, e long")  # 999 is no node
    nodes = [*groups, 500]
    edges = [(a, b) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= 0.5 * len(groups[a] | groups[b])]
    got = clusters.clustered_sets(spark.createDataFrame([(n,) for n in nodes], "id long"), table, "o", "e", 0.5)
    assert {r.id: r.seed for r in got.collect()} == greedy(nodes, edges)


def test_tracks_are_dealt_to_all_tasks(spark, sf):
    """The customers' keys are one small file, so all tracks were made and coded in one task."""
    assert catalog._tracks(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_track_codecs_of_null_and_empty_tracks(spark):
    tracks = [(0, None), (1, []), (2, [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]), (3, [(1.0, 2.0)]), (4, [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)])]
    df = spark.createDataFrame(tracks, "id int, t array<struct<lat:double,lon:double>>").coalesce(1)
    got = {r.id: r for r in df.select("id", geometry.polyline_encode("t").alias("p"), geometry.simplifier(40.0)("t").alias("s")).withColumn("d", geometry.polyline_decode("p")).collect()}
    assert [got[i].p for i in range(3)] == [None, "", "_p~iF~ps|U_ulLnnqC_mqNvxq`@"]
    plain = lambda v: v and [tuple(p) for p in v]
    assert {i: plain(r.d) for i, r in got.items()} == dict(tracks)
    assert {i: plain(r.s) for i, r in got.items()} == dict(tracks) | {4: [(0.0, 0.0), (0.0, 2.0)]}
