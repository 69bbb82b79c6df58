import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from millrace.llm import attention_lm


def plain(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    return sorted((str(d), held(d), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for d, t in rows)


def shown(got):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = attention_lm.score(docs, hot=50).collect()
    assert shown(got) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 for r in got)


def test_held_out_text_against_subword_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id: r.score for r in attention_lm.score(docs).collect() if r.held_out}
    coder = attention_lm.subwords(attention_lm.default_path())
    size, end = coder.size, coder.end
    ids = {r.doc_id: np.r_[coder.ids(r.text), end] for r in docs.collect()}
    freq = sum(np.bincount(v, minlength=size) for d, v in ids.items() if d not in held)
    unigram = np.log10((freq + 1) / (freq.sum() + size))
    tokens = sum(len(ids[d]) for d in held)
    assert sum(held.values()) / tokens > sum(unigram[ids[d]].sum() for d in held) / tokens + 0.1


def test_awkward_rows(spark):
    data = [(1, None), (1, None), (2, ""), (None, "a B"), (3, "x " * 30_000), (4, "y" * 50_000), (5, "É é \x0b\x1c z"), (10, "zz"), (10, "zz"), (10, "zz")]
    docs = spark.createDataFrame([(*d, 0, "k") for d in data], "doc_id long, text string, held int, word string")
    assert shown(attention_lm.score(docs, hot=2).collect()) == plain(data)
    assert attention_lm.score(docs.limit(0)).count() == 0


def test_each_token_is_scored_once():
    net = attention_lm.AttentionLm(4, 8)
    model = attention_lm.SubwordModel(net, np.arange(40) % 4, np.zeros(40), 39, "")
    for n in range(0, 40):
        x, y, counts = model.windows(np.arange(n))
        assert y[counts].tolist() == [*range(n), 39]
    a, b = np.arange(30), np.arange(7)
    assert np.allclose(model.score([a, b, a]), [model.score([a])[0], model.score([b])[0], model.score([a])[0]])


def test_scoring_agrees_with_the_trained_form():
    rng = np.random.default_rng(3)
    net = attention_lm.AttentionLm(8, 16)
    for w in net.p.values():
        w += rng.normal(0, 0.4, w.shape).astype(np.float32)
    model = attention_lm.SubwordModel(net, np.arange(60) % 8, rng.normal(-1, 0.1, 60), 59, "")
    texts = [rng.integers(0, 60, n) for n in (0, 1, 15, 16, 17, 40, 200)]
    for ids, got in zip(texts, model.score(texts)):
        x, y, c = model.windows(ids)
        lp = net.log_probs(model.cls[x], x, model.cls[y]) / math.log(10) + model.inside[y]
        assert abs(got - lp[c].sum()) < 1e-3


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (64, 8)), rng.integers(0, 4, (64, 8))
    y[:, 1:] = x[:, :-1]  # to be had by looking back one place
    net = attention_lm.AttentionLm(4, 8)
    before = net.log_probs(x, x, y)[:, 1:].mean()
    net.fit(x, x, y, steps=400)
    assert net.log_probs(x, x, y)[:, 1:].mean() > 0.3 * before


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = attention_lm.AttentionLm(5, 6, dim=4)
    for n in net.p:
        net.p[n] = rng.normal(0, 0.5, net.p[n].shape)
    net.mask, net.seen = net.mask.astype(float), net.seen.astype(float)
    c, i, y, real = rng.integers(0, 5, (3, 6)), rng.integers(0, 40, (3, 6)), rng.integers(0, 5, (3, 6)), rng.random((3, 6)) < 0.7
    loss = lambda: -net.log_probs(c, i, y)[real].mean()
    for n, g in net.gradients(c, i, y, real).items():
        for at in rng.permutation([k for k in np.ndindex(net.p[n].shape) if n != "ids" or k[0] < 40])[:12]:
            at, was = tuple(at), net.p[n][tuple(at)]
            net.p[n][at] = was + 1e-5
            up = loss()
            net.p[n][at] = was - 1e-5
            down = loss()
            net.p[n][at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_score_against_a_plain_walk(spark, sf):
    """The query's score of every document from the fitted weights, window by window, without batches, tables or the stored ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.select("doc_id", "text", attention_lm.held_out(F.col("doc_id")).alias("held"), F.xxhash64("text").alias("text_key"))
    *_, model, _ = attention_lm.learn(base, attention_lm.default_path(), 1000, 64, 32, 6_000)
    coder, got = attention_lm.subwords(attention_lm.default_path()), {r.doc_id: r.score for r in attention_lm.score(docs).collect()}
    for r in docs.collect():
        seq = np.r_[model.end, coder.ids(r.text), model.end]
        total, n = 0.0, len(seq) - 1
        for at in range(0, max(1, n - 16), 16):
            x, y = seq[at : at + 32][: n - at], seq[at + 1 : at + 33]
            pad = lambda v: np.r_[v, np.zeros(32 - len(v), int)][None, :]
            lp = model.net.log_probs(model.cls[pad(x)], pad(x), model.cls[pad(y)])[0, : len(y)] / math.log(10) + model.inside[y]
            total += lp[0 if at == 0 else 16 :].sum()
        assert abs(got[r.doc_id] - total) < 1e-3 * max(1, abs(total)) ** 0.5


def test_causality():
    net = attention_lm.AttentionLm(4, 8)
    x = np.zeros((1, 8), int)
    z = x.copy()
    z[0, 5:] = 3
    assert np.allclose(net.log_probs(x, x, x)[0, :5], net.log_probs(z, z, x)[0, :5])


def test_subwords_lose_nothing():
    coder = attention_lm.subwords(attention_lm.default_path())
    for t in ("Hello, world's!", "", "a \u3000\x85 é\n\n  b" * 9, "y" * 100_000, "12.5%\t漢字🙂"):
        assert coder.coder.decode(coder.ids(t).tolist()) == t
    assert coder.ids(None).tolist() == []


def test_weights_come_from_all_training_texts(spark):
    """Without a sample to start from, what the weights know comes from the rounds over all windows."""
    docs = spark.createDataFrame([(d, " ".join(f"w{(d + k) % 9} and" for k in range(60 + d % 50))) for d in range(3000)], "doc_id long, text string").coalesce(1)
    held = {r.doc_id: r.score for r in attention_lm.score(docs, max_windows=0).collect() if r.held_out}
    coder = attention_lm.subwords(attention_lm.default_path())
    ids = {r.doc_id: np.r_[coder.ids(r.text), coder.end] for r in docs.collect()}
    freq = sum(np.bincount(v, minlength=coder.size) for d, v in ids.items() if d not in held)
    unigram = np.log10((freq + 1) / (freq.sum() + coder.size))
    assert sum(held.values()) > sum(unigram[ids[d]].sum() for d in held)


def test_windows_hold_each_target_once():
    for n in (2, 3, 8, 9, 10, 17, 40):
        rows = attention_lm._cut(np.arange(n), 8)
        y = rows[:, 1:]
        assert y[y >= 0].tolist() == list(range(1, n))
    share = np.mean([attention_lm._drawn(d * 7919, 200, (1 << 30) // 10).mean() for d in range(200)])
    assert 0.09 < share < 0.11
