import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f, c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps))}
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_awkward_rows(spark):
    long = " ".join(random.Random(1).choices("abcdefgh", k=200_000))
    data = [(1, ""), (2, None), (3, "one two"), (3, "one two"), (None, "One  TWO"), (5, long), (6, " \t\n"), (None, "alone in the world"), (7, "éÉ x")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in data], "doc_id long, text string, fp int, component_id string")
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [plain_fingerprint(t) for _, t in data]
    assert got == sorted((str(d), f, c) for (d, _), f, c in zip(data, fps, plain_components([d for d, _ in data], fps)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "5", "None", "7"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(s) for s in seeds}
    for s in seeds[:20]:  # chains and clusters of neighbours
        x = int(s)
        for _ in range(30):
            x ^= 1 << int(rng.integers(0, 63))
            fps.add(x)
    fps = sorted(fps)
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=16))
    root = {r.node: r.root for r in got.collect()}
    want = plain_components(fps, [f % 2**64 for f in fps])
    assert [root.get(f, f) for f in fps] == want


def test_large_groups_by_tile_pairs():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**16, 700, dtype=np.uint64)
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    i, j = simhash._compare(np.zeros(700, np.int64), fp, 3)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 64).all()
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert (simhash._roots(700, i, j) == simhash._roots(700, a, b)).all()


def test_components_of_a_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(edges.unionByName(edges))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(300)}
    assert components(edges.limit(0)).count() == 0
