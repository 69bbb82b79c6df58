import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bayes_minhash as bm
from millrace.llm.neardup import shingles
from millrace.llm.shared import stored


def plain_sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def plain(rows, width=2, percent=80):
    """(id, set size, component) of each row, all pairs of different sets being compared."""
    sets = plain_sets(rows, width)
    kinds = sorted({s for s in sets if s}, key=len)
    root = {k: k for k in kinds}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(kinds):
        for y in kinds[i + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            k = len(x & y)
            if 100 * k >= percent * (len(x) + len(y) - k):
                root[find(x)] = find(y)
    least = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    return [(d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets)]


def check(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, component_id string, n int")
    got = bm.groups(docs, width=2, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for width in (2, 5):
        got = bm.groups(docs, width=width).collect()
        assert sorted(map(tuple, got)) == sorted(plain(rows, width))


def test_awkward_rows_and_the_threshold(spark):
    words = [f"w{i}" for i in range(100)]
    long = random.Random(1).choices([f"v{i}" for i in range(500)], k=60_000)
    data = [(1, None), (2, ""), (3, " \t"), (3, None), (None, ""), (4, "one"), (5, "ONE "), (None, "one"), (None, "alone here"), (None, "alone here"), (6, "a b"), (6, "a b"), (7, "é É"), (8, "é é")]
    data += [(10, " ".join(words)), (11, " ".join(words[:80])), (12, " ".join(words[:81])), (13, " ".join(words[20:])), (14, " ".join(words) + " " + " ".join(words))]
    data += [(20, " ".join(long)), (21, " ".join(long[:-1])), (22, " ".join(long[::-1]))]
    check(spark, data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert bm.groups(docs.limit(0)).collect() == []
    assert len(bm.groups(docs.where("trim(text) = ''")).collect()) == 2


def near_copies(rng, copies, size=60, edits=4, start=0):
    base = [f"b{start}_{i}" for i in range(size)]
    out = []
    for _ in range(copies):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A group of near copies, many of them too far from each other, with hot keys split and in tiles of a few rows."""
    keys = bm.hot_keys
    monkeypatch.setattr(bm, "hot_keys", lambda left, key: keys(left, key, 5))
    rng = random.Random(2)
    data = [t for g in range(3) for t in near_copies(rng, 120, start=g)] + ["same words again"] * 100
    data = list(enumerate(data))
    rng.shuffle(data)
    check(spark, data, tile=16)


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    met, sets = bm._met, bm._sets
    monkeypatch.setattr(bm, "_met", lambda nodes: met(nodes, limit=3, max_bytes=0))
    monkeypatch.setattr(bm, "_sets", lambda *a: sets(*a, max_bytes=0))
    check(spark, list(enumerate(near_copies(random.Random(3), 60) + near_copies(random.Random(4), 3, start=1))))


def test_templated_texts_send_few_pairs(spark):
    """Texts that share a template below the threshold: what leaves tiles grows with their rows, not with their pairs."""
    shared = [f"s{i}" for i in range(200)]
    texts = [" ".join(shared + [f"o{k}_{i}" for i in range(44)]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({r.component_id for r in bm.groups(docs, width=2).collect()}) == 300
    nodes, dealt = tiles_of(docs)
    needed = bm.least_matches(0.8, 1e-6)
    assert bm._likely_forest(dealt, nodes, 80, needed).count() <= bm._suspects(dealt, nodes, 80, needed).count() <= dealt.count()


def tiles_of(docs, tile=1024):
    nodes = stored(bm._nodes(stored(bm._signed(docs, "doc_id", "text", 2), "t")), "t")
    left = bm._met(nodes).select("bucket", "node", F.col("node").alias("part"), "m", "load")
    return nodes, bm._tiled(left, tile)


def test_looks_and_estimates():
    needed = bm.least_matches(0.8, 1e-6)
    assert [k for k, _ in needed] == list(bm.LOOKS)
    assert all(0 < m < 0.8 * k for k, m in needed)
    rng = np.random.default_rng(1)
    lost = {}
    for similarity in (0.3, 0.6, 0.8, 0.9):
        kept, off = 0, []
        for _ in range(150):
            both = round(400 * similarity)
            x = rng.integers(-(1 << 63), 1 << 63, 400)
            own = rng.integers(-(1 << 63), 1 << 63, 400 - both)
            half = (400 - both) // 2
            s, t = bm.signature(x[: both + half]), bm.signature(np.r_[x[:both], own[half:]])
            exact = both / (400 - (400 - both) % 2 + (400 - both) % 2)
            off.append((s == t).mean() - exact)
            kept += len(bm.alive(np.stack([s, t]).astype(np.uint8), np.array([0]), np.array([1]), needed)[0])
        assert abs(np.mean(off)) < 0.01
        lost[similarity] = 150 - kept
    assert lost[0.3] == lost[0.6] == 150
    assert lost[0.8] == lost[0.9] == 0


def test_similar_sets_share_a_bucket():
    rng = random.Random(6)
    for t in near_copies(rng, 40, size=100, edits=4):
        x, y = (bm.buckets(bm.signature(shingles(v, 2))) for v in (t, " ".join(f"b0_{i}" for i in range(100))))
        assert (x == y).any()


def test_spread_join(spark):
    left = stored(spark.range(100).select((F.col("id") % 3).alias("k"), "id").union(spark.range(3).select(F.lit(9), "id")), "t")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "z"), (10, "y")], "k long, v string")
    hot = bm.hot_keys(left, "k", 10)
    assert {r.k: r["__copies"] for r in hot.collect()} == {0: 4, 1: 4, 2: 4}
    for how in ("inner", "left", "left_semi"):
        got = bm.spread_join(left, right, "k", hot, F.xxhash64("id"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).select(got.columns).collect()))


@pytest.mark.parametrize("size", [1, 5, 700])
def test_tiles_come_whole(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    tile = np.sort(rng.integers(0, 9, 2000))
    sig = [bytes(rng.integers(0, 256, bm.HASHES, np.uint8)) for _ in tile]
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 4001, 2), pa.int32()), pa.array(np.arange(4000)))
    whole = pa.RecordBatch.from_arrays([pa.array(tile), pa.array(np.arange(2000)), pairs, pa.array(sig)], ["tile", "node", "bands", "sig"])
    got = list(bm._whole_tiles(whole.slice(i, size) for i in range(0, 2000, size)))
    assert [int(t[0]) for t, *_ in got] == sorted(set(tile.tolist()))
    assert np.concatenate([b for *_, b, _ in got]).tolist() == np.arange(4000).reshape(-1, 2).tolist()
    assert np.concatenate([n for _, n, *_ in got]).tolist() == list(range(2000))
    assert b"".join(s.tobytes() for *_, s in got) == b"".join(sig)


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(8)
    for _ in range(30):
        part = rng.integers(0, 12, 40)
        i, j = rng.integers(0, 40, (2, 60))
        m = rng.integers(0, 100, 60)
        on = bm._forest(part, i, j, m)
        assert len(on) < len(set(part.tolist())) * 2
        join = lambda at: bm.roots(12, part[i[at]], part[j[at]]).tolist()
        assert join(on) == join(np.arange(60))
        cut = list(bm._spanning(part, ((i[k : k + 7], j[k : k + 7], m[k : k + 7]) for k in range(0, 60, 7)), 20))
        assert bm.roots(12, part[cut[0][0]], part[cut[0][1]]).tolist() == join(on)


def test_links_in_tiles_join_what_brute_force_joins(spark):
    """Without star and forest before: tiles alone find all components."""
    texts = near_copies(random.Random(9), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, dealt = tiles_of(docs, 8)
    needed = bm.least_matches(0.8, 1e-6)
    suspects = stored(bm._suspects(dealt, nodes, 80, needed), "t")
    assert suspects.count() == suspects.distinct().count() <= dealt.count()
    sets = bm._sets(docs, "text", stored(bm._signed(docs, "doc_id", "text", 2), "t"), nodes.select("node", "key", "text_key"), 2)
    root = {r.node: r.root for r in bm.components(bm._links_in_tiles(suspects, nodes, sets, 80, needed)).collect()}
    ours = {}
    for r in nodes.collect():
        ours.setdefault(root.get(r.node, r.node), set()).add(r.doc_id)
    want = {}
    for d, _, c in plain(list(enumerate(texts))):
        want.setdefault(c, set()).add(d)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    firsts = set(first.values())
    assert sorted(map(sorted, ours.values())) == sorted(sorted(v & firsts) for v in want.values())
