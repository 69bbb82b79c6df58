import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import whitening


def plain(rows, top=32):
    """(ids, deviations, components, variances, trace) of (id, vector) rows, in whole numbers and numpy's own decomposition."""
    kept = [(d, v) for d, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = [[n * a - s for a, s in zip(v, sums)] for v in x]
    deviations = [sum(a * a for a in v) for v in off]
    c = np.array([[float(Fraction(a, n)) for a in v] for v in off])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:top]
    white = c @ vectors[:, order] / np.sqrt(values[order])
    return [d for d, _ in kept], deviations, white, values[order], float(Fraction(sum(deviations), n**3))


def check(spark, rows, got, top=32):
    ids, deviations, white, values, trace = plain(rows, top)
    k = white.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault((r.vec_id, r.deviation), []).append(r.whitened)
        assert r.n == len(ids)
        assert r.identity_error <= 1e-9
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9
    assert sorted(by) == list(range(1, k + 1))
    for j in range(1, k + 1):
        keys = {}
        for d, v, w in zip(ids, deviations, white[:, j - 1]):
            keys.setdefault((d, v), []).append(w)
        flat = [(sorted(by[j][key]), sorted(ws), sorted(-w for w in ws)) for key, ws in keys.items()]
        same = np.concatenate([np.subtract(a, b) for a, b, _ in flat])
        other = np.concatenate([np.subtract(a, c) for a, _, c in flat])
        assert min(np.abs(same).max(), np.abs(other).max()) < 1e-7


def test_whole_table_against_plain(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in table.collect()], whitening.report(table).collect())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in rng.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(200)]
    hot = data[0][1]
    data += [(1000 + i, hot) for i in range(100)]  # a third are one vector
    data += [(None, hot), (7, data[7][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [1.0, float("nan"), 0.0, 0.0, 0.0]), (503, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, deviation string, component int"
    table = spark.createDataFrame([(d, v, "old", 9) for d, v in data], schema)
    check(spark, data, whitening.report(table).collect())
    check(spark, data, whitening.report(table, top=2).collect(), top=2)
    more = spark.createDataFrame([(504, [1.0], "", 0), (505, [], "", 0)], schema)  # other lengths than the usual one
    check(spark, data, whitening.report(table.union(more)).collect())
    model = whitening.fit(table)
    kept = whitening.transform(table, model)
    assert kept.columns == ["vec_id", "embedding", "component", "deviation", "whitened"]
    assert kept.count() == 302


def test_nothing_to_whiten(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<float>")
    want = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in (table, table.limit(0), table.where("embedding is null"), table.limit(1)):
        got = whitening.report(rows)
        assert got.columns == want
        assert got.collect() == []


def test_rank_below_dims(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-300, 300, (50, 2)) / 64
    table = spark.createDataFrame([(i, [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate(base)], "vec_id long, embedding array<double>")
    got = whitening.report(table).collect()
    assert {r.component for r in got} == {1, 2}
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    assert got[0].identity_error < 1e-6


def test_deviations_beyond_64_bits():
    off = np.array([[1 << 40, 3], [-(1 << 41), 1 << 40]])
    assert whitening._deviations(off) == [(1 << 80) + 9, (1 << 82) + (1 << 80)]
    x = np.array([[1 << 50, 5]])
    assert whitening._off(x, 1 << 20, (7, 9)).tolist() == [[(1 << 70) - 7, (5 << 20) - 9]]


def test_model_on_other_rows(spark):
    rng = np.random.default_rng(5)
    make = lambda lo, m: spark.createDataFrame([(lo + i, [float(v) for v in rng.normal(size=4) * [9, 6, 4, 2]]) for i in range(m)], "vec_id long, embedding array<double>")
    model = whitening.fit(make(0, 4000))
    held = whitening.transform(make(9000, 4000), model)
    assert whitening.identity_error(held) < 0.2
    assert held.select(F.size("whitened").alias("k")).distinct().collect()[0].k == 4
