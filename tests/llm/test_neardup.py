import numpy as np

import corpus_pipeline
from millrace.llm import neardup


def plain_kept(rows, least=0.8):
    """Ids that stay: the smallest of each group joined by 5-word Jaccard, by comparing all pairs of like sizes."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        key = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets[key] = min(d, sets.get(key, d))
    keys = sorted(sets, key=len)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if len(x) < least * len(y) - 1e-9:
                break
            k = len(x & y)
            if k and k >= least * (len(x) + len(y) - k) - 1e-9:
                root[find(x)] = find(y)
    kept = {}
    for k in keys:
        kept[find(k)] = min(sets[k], kept.get(find(k), sets[k]))
    return sorted(kept.values())


def test_stage_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_at_the_threshold_and_awkward_rows(spark):
    words = [f"w{i}" for i in range(200)]
    data = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, " ".join(words)), (6, " ".join(words[:161])), (7, " ".join(words[:160])), (8, " ".join(words[30:])), (9, "a b c d e f"), (9, "a b c d e f")]
    data += [(100 + k, " ".join([*words[:k], "new", *words[k + 1 :]])) for k in range(0, 200, 9)]
    docs = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, n int")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == plain_kept(data)
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_crowded_items_by_tiles(spark):
    """Many sets that share one common passage, in tiles of a few rows each."""
    import random

    rng = random.Random(5)
    shared = [f"s{i}" for i in range(30)]
    data = []
    for k in range(60):
        own = [f"o{k}_{i}" for i in range(20)]
        base = shared + own
        data.append((3 * k, " ".join(base)))
        for c in (1, 2):
            copy = base[:]
            for _ in range(c):
                copy[rng.randrange(len(copy) - 1)] = f"x{k}_{c}"
            data.append((3 * k + c, " ".join(copy)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = neardup.groups(docs, tile=8).groupBy("group").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in got) == plain_kept(data)


def templated(n, own, seed=7):
    """Texts of 200 common words and as many own ones as named, spread among them."""
    import random

    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"t{i}" for i in range(200)] + [f"o{k}_{i}" for i in range(own)]
        out.append((k, " ".join(words)))
    rng.shuffle(out)
    return out


def test_texts_that_share_a_template_leave_no_pairs(spark, monkeypatch):
    """Similarity 0.69: all pairs lie within the radius, none is a link; what goes on grows with the texts, not with their pairs."""
    sent = []
    for name in ("_forests", "_suspects", "_links_in_tiles"):
        whole = getattr(neardup, name)
        monkeypatch.setattr(neardup, name, lambda *a, whole=whole: sent.append(whole(*a)) or sent[-1])
    data = templated(300, 44)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert neardup.keep_one(docs).count() == len(data) == len(plain_kept(data))
    assert [df.count() for df in sent] == [0, 0, 0]


def test_large_sets_that_share_a_template_are_told_apart_by_wide_marks(spark, monkeypatch):
    """Sets of 6,000 fill a mark of 2,048 bits, so that all of them went on with their whole sets; wide marks put them out of reach. Links are still found."""
    sent = {}
    for name in ("_forests", "_suspects"):
        whole = getattr(neardup, name)
        monkeypatch.setattr(neardup, name, lambda *a, whole=whole, name=name: sent.setdefault(name, whole(*a)))
    words = [f"t{i}" for i in range(4900)]
    data = [(k, " ".join([*words, *(f"o{k}_{i}" for i in range(1100))])) for k in range(24)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == list(range(24))
    assert {name: df.count() for name, df in sent.items()} == {"_forests": 0, "_suspects": 0}
    data += [(100 + k, t.replace("t2000 ", f"n{k} ")) for k, t in data[:12]]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == list(range(24))


def test_wide_marks_fold_to_each_other():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for n in (5, 1024, 1025, 1500, 4000, 4100, 9000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(-(1 << 63), 1 << 63, len(s) // 5)]) for s in sets]
    wide = np.empty(len(sets), object)
    wide[:] = [neardup.wide_mark(s) for s in sets]
    i, j = np.triu_indices(len(sets))
    apart = neardup._wide_apart(wide, i, j)
    for x, y, d in zip(i, j, apart):
        assert d <= len(np.setxor1d(sets[x], sets[y]))
        assert d > 0 or x == y or min(len(sets[x]), len(sets[y])) <= 1024


def test_templated_texts_with_copies(spark):
    """Links across a crowd that shares a template, over several tiles."""
    data = templated(120, 30, 3)
    data += [(1000 + d, t.replace("t150 ", f"n{d} ")) for d, t in data[:40]]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = neardup.groups(docs, tile=16).groupBy("group").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in got) == plain_kept(data)


def test_marks_never_rule_out_a_link():
    """Marks differ in no more bits than sets in elements, and `compared` finds every pair at the threshold."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 300, 5000):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        for share in (0.0, 0.1, 0.5, 1.0):
            y = np.unique(np.r_[x[rng.random(len(x)) >= share], rng.integers(-(1 << 63), 1 << 63, int(n * share))])
            assert np.bitwise_count(neardup.mark(x) ^ neardup.mark(y)).sum() <= len(np.setxor1d(x, y))
    base = rng.integers(-(1 << 63), 1 << 63, 400)
    sets = [np.unique(np.r_[base[: 400 - k], rng.integers(-(1 << 63), 1 << 63, k)]) for k in (0, 10, 44, 45, 80, 200) for _ in range(5)]
    n, part = np.array([*map(len, sets)]), np.arange(len(sets))
    fp = np.array([neardup.set_fingerprint(s)[0] for s in sets])
    marks = np.stack([neardup.mark(s) for s in sets])
    like = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    for side in (np.zeros(len(sets), int), part % 2):
        met = {(min(i, j), max(i, j)) for a, b, _ in neardup.compared(side, n, part, fp, marks, 80, neardup.reach(0.8), block=4) for i, j in zip(a.tolist(), b.tolist())}
        links = {(i, j) for i in part.tolist() for j in range(i + 1, len(sets)) if like(i, j) and (side[i] != side[j] or not side.any())}
        assert links <= met
        assert all(100 * len(np.intersect1d(sets[i], sets[j])) > 75 * len(np.union1d(sets[i], sets[j])) for i, j in met)


def test_shingles_against_plain_words():
    import random

    rng, seen = random.Random(3), {}
    for width in (1, 3, 5):
        for _ in range(500):
            t = "".join(rng.choice(["a", "B", "é", " ", "\t", "\n\n", "\x1c", "b c", "zz"]) for _ in range(rng.randrange(40)))
            w = t.encode().lower().split()
            plain = {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
            alone = {seen.setdefault(s, neardup.shingles(s.decode(), width)[0]) for s in plain}
            assert sorted(alone) == sorted(neardup.shingles(t, width))
    assert len(set(seen.values())) == len(seen)


def test_second_tiles_hold_only_what_was_in_a_likely_pair(spark, monkeypatch):
    """All tiles were sent twice, and whole texts were shuffled to drop a few of them."""
    dealt, whole = [], neardup._suspects
    monkeypatch.setattr(neardup, "_suspects", lambda *a: dealt.append(a[0].count()) or whole(*a))
    data = templated(120, 44)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert neardup.keep_one(docs).count() == 120
    assert dealt == [0]


def test_kept_rows_are_not_shuffled(spark):
    words = [f"w{i}" for i in range(40)]
    data = [(k, f"k{k} " + " ".join(words[k % 7 :])) for k in range(60)] + [(100 + k, f"k{k} " + " ".join(words[k % 7 :])) for k in range(5)] + [(3, "k3 " + " ".join(words[3:]))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = neardup.keep_one(docs)
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(data)
    stay, unsure = got._jdf.queryExecution().optimizedPlan().children().apply(0), got._jdf.queryExecution().optimizedPlan().children().apply(1)
    assert "Join" not in stay.toString() and "Aggregate" not in stay.toString() and "Join" in unsure.toString()


def test_common_elements_meet_as_others_do(spark, monkeypatch):
    from functools import partial

    rows = [(k, 10 + k, [k % 3, k % 5 + 10, 100 + k // 4], [1000, 1001 + k % 2]) for k in range(40)]
    nodes = spark.createDataFrame(rows, "node long, n long, bands array<long>, common array<long>")
    both = neardup.bayes._met(nodes.selectExpr("node", "n", "concat(bands, common) as bands"))
    cols = ["bucket", "node", "m", "load", "lo", "hi"]
    assert sorted(map(tuple, neardup._met(nodes).select(cols).collect())) == sorted(map(tuple, both.select(cols).collect()))
    monkeypatch.setattr(neardup, "_rows", partial(neardup._rows, common=2))
    data = templated(60, 30, 3)
    data += [(1000 + d, t.replace("t150 ", f"n{d} ")) for d, t in data[:20]]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == plain_kept(data)
