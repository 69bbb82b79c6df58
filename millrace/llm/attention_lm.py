"""Language-model scoring with a small causal self-attention model, trained in numpy.

Two scores come out for each text. The base one is a smoothed unigram over words: the corpus
counts are a Spark aggregation, the `hot` most frequent words travel with the tasks, and the
remaining words of each text are joined to their counts by shuffle. The model's one runs over
subword ids: attention over the last `window` ids predicts the next id's class, and corpus
counts of all training texts give the id within its class. Windows overlap by half, and each
id is scored once, in the window that shows it most context; windows of many texts go through
masked attention as one batch.

Attention weights are learnt from every window of all training texts, as classes, in-class
probabilities and word counts are: a start is fitted on about `max_windows` windows, drawn
evenly from all, then in each of `rounds` rounds every task goes on from the same weights
over its share of the windows, and the tasks' weights are averaged by their windows.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import durable, stored

END = ""  # no word is empty, so the end token can be


#: White space to Python's split, but not to the words here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    raw = text.encode("utf-8", "replace").lower() if text else b""
    return [*(raw.decode("utf-8").split() if text and not _ODD.search(text) else (w.decode("utf-8") for w in raw.split())), END]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Byte-level BPE of a rank file; the id after the last rank ends a text. The file's path is a parameter."""

    #: Runs of letters, digits, marks (each with the blank before it) and white space.
    PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.coder = tiktoken.Encoding("subwords", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text or ""), np.int64)


@cache
def subwords(path: str) -> Subwords:
    """One per worker process and file."""
    return Subwords(path)


def held_out(id_col: Column) -> Column:
    """Texts that take no part in learning: crc32(id as text) mod 7 is 2. A missing id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


class AttentionLm:
    """One causal attention head over class and hashed-id embeddings, with a residual and a class softmax."""

    HASHED = 2048

    def __init__(self, classes: int, window: int = 32, dim: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.window, self.dim = window, dim
        self.p = {"cls": w(classes, dim), "ids": w(self.HASHED, dim), "pos": w(window, dim), "q": w(dim, dim), "k": w(dim, dim), "v": w(dim, dim), "out": w(dim, classes), "bias": np.zeros(classes, np.float32)}
        self.mask = np.triu(np.full((window, window), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((window, window), np.float32))

    def _forward(self, cls: np.ndarray, ids: np.ndarray) -> tuple:
        p = self.p
        x = p["cls"][cls] + p["ids"][ids % self.HASHED] + p["pos"]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1) / math.sqrt(self.dim) + self.mask
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        h = x + a @ v
        return x, q, k, v, a, h

    def log_probs(self, cls: np.ndarray, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log of each target class (windows, window)."""
        h = self._forward(cls, ids)[-1]
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=2, keepdims=True)
        return np.take_along_axis(z, target[:, :, None], axis=2)[:, :, 0] - np.log(np.exp(z).sum(axis=2))

    def gradients(self, c: np.ndarray, i: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the targets that `real` marks."""
        p, w, d, n = self.p, self.window, self.dim, len(c)
        scale, hashed = np.float32(1 / math.sqrt(d)), i % self.HASHED
        x = (p["cls"].take(c.ravel(), 0) + p["ids"].take(hashed.ravel(), 0)).reshape(n, w, d)
        x += p["pos"]
        x = x.reshape(-1, d)
        weights = np.hstack([p["q"] * scale, p["k"], p["v"]])
        qkv = (x @ weights).reshape(n, w, 3 * d)
        q, k, v = (qkv[:, :, d * j : d * (j + 1)] for j in range(3))
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -60, 60, out=a)  # far beyond what is fitted; the exponentials stay finite
        np.exp(a, out=a)
        a *= self.seen
        a /= a @ np.ones((w, 1), np.float32)
        found = (a @ v).reshape(-1, d)
        h = x + found
        z = h @ p["out"]
        z += p["bias"]
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        counted = real.reshape(-1, 1) / np.float32(max(1, real.sum()))
        z *= counted / (z @ np.ones((z.shape[1], 1), np.float32))
        z[np.arange(len(z)), y.ravel()] -= counted.ravel()
        g = {"out": h.T @ z, "bias": np.ones(len(z), np.float32) @ z}
        dx = z @ p["out"].T
        dh = dx.reshape(n, w, d)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= ((dx * found) @ np.ones((d, 1), np.float32)).reshape(n, w, 1)
        ds *= a
        back = np.empty((n, w, 3 * d), np.float32)
        np.matmul(ds, k, out=back[:, :, :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dh, out=back[:, :, 2 * d :])
        back = back.reshape(-1, 3 * d)
        gw = x.T @ back
        g |= {"q": gw[:, :d] * scale, "k": gw[:, d : 2 * d], "v": gw[:, 2 * d :]}
        dx += back @ weights.T
        g["pos"] = dx.reshape(n, w, d).sum(axis=0)
        for name, rows in (("cls", c), ("ids", hashed)):
            at = (rows.reshape(-1, 1) * d + np.arange(d)).ravel()
            g[name] = np.bincount(at, dx.ravel(), p[name].size).reshape(p[name].shape).astype(np.float32)
        return g

    def fit(self, cls: np.ndarray, ids: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 48, rate: float = 0.01, seed: int = 7, real: np.ndarray | None = None) -> AttentionLm:
        """Adam on windows (n, window) of input classes and ids and target classes, and which targets count (all by default)."""
        rng, adam = np.random.default_rng(seed), Adam(self)
        real = np.ones(target.shape, bool) if real is None else real
        for t in range(1, steps + 1 if len(cls) else 1):
            rows = rng.integers(0, len(cls), min(batch, len(cls)))
            adam.step(self.gradients(cls[rows], ids[rows], target[rows], real[rows]), rate * min(1.0, 2 * (1 - t / (steps + 1))))
        return self


class Adam:
    """Running moments of a net's gradients."""

    def __init__(self, net: AttentionLm):
        self.p, self.t = net.p, 0
        self.m, self.v = {n: np.zeros_like(w) for n, w in net.p.items()}, {n: np.zeros_like(w) for n, w in net.p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        root = math.sqrt(1 - 0.99**self.t)
        rate *= root / (1 - 0.9**self.t)
        for n, w in self.p.items():
            m, v, x = self.m[n], self.v[n], g[n]
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            v *= np.float32(0.99)
            x = x * x
            x *= np.float32(0.01)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8 * root)
            np.divide(m, x, out=x)
            x *= np.float32(rate)
            w -= x


class SubwordModel(NamedTuple):
    net: AttentionLm
    cls: np.ndarray  # of each subword id
    inside: np.ndarray  # log10 of each id's share of its class
    end: int
    path: str

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, window), targets and which of them count, for one text's ids followed by the end."""
        w, half = self.net.window, self.net.window // 2
        seq = np.r_[self.end, ids, self.end]
        n = len(seq) - 1
        starts = np.arange(0, max(1, n - half), half)
        at = starts[:, None] + np.arange(w)
        inside = at < n
        counts = inside & ((starts == 0)[:, None] | (np.arange(w) >= w - half))
        return seq[np.minimum(at, n)], seq[np.minimum(at + 1, n)], counts

    def score(self, texts: list[np.ndarray], most: int = 256) -> list[float]:
        """log10 probability of each text's ids and its end."""
        out, half = np.zeros(len(texts)), self.net.window // 2
        scorer = _scorer(self)
        held: list[tuple] = []
        size = 0

        def run() -> None:
            nonlocal held, size, out
            x, y, c = (np.concatenate([h[1][k] for h in held]) for k in range(3))
            sizes = [len(h[1][0]) for h in held]
            owner = np.repeat([h[0] for h in held], sizes)
            first = np.zeros(len(x), bool)
            first[np.cumsum([0, *sizes[:-1]])] = True
            for rows, lo in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), self.net.window - half)):  # what comes before `lo` is context only
                for k in range(0, len(rows), most):
                    r = rows[k : k + most]
                    lp = scorer.log10_probs(x[r], y[r, lo:], lo)
                    out += np.bincount(owner[r], np.where(c[r, lo:], lp, 0).sum(axis=1), len(out))
            held, size = [], 0

        for i, ids in enumerate(texts):
            held.append((i, self.windows(ids)))
            size += len(held[-1][1][0])
            if size >= most:
                run()
        if held:
            run()
        return out.tolist()


class _Scorer:
    """The fitted model with what depends on one id alone worked out beforehand for the whole vocabulary."""

    def __init__(self, model: SubwordModel):
        p, net = model.net.p, model.net
        self.cls, self.inside, self.p = model.cls, model.inside, p
        self.x = p["cls"][model.cls] + p["ids"][np.arange(len(model.cls)) % net.HASHED]
        scale = np.float32(1 / math.sqrt(net.dim))
        self.q, self.k, self.v = self.x @ p["q"] * scale, self.x @ p["k"], self.x @ p["v"]
        self.pos_q, self.pos_k, self.pos_v = p["pos"] @ p["q"] * scale, p["pos"] @ p["k"], p["pos"] @ p["v"]
        self.seen = np.tril(np.ones((net.window, net.window), np.float32))

    def log10_probs(self, ids: np.ndarray, target: np.ndarray, lo: int) -> np.ndarray:
        """Of the targets of the positions from `lo` on of each window (windows, window)."""
        tail = ids[:, lo:]
        q, k, v, x = self.q.take(tail, 0), self.k.take(ids, 0), self.v.take(ids, 0), self.x.take(tail, 0)
        q += self.pos_q[lo:]
        k += self.pos_k
        v += self.pos_v
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -60, 60, out=a)  # far beyond what is fitted; the exponentials stay finite
        np.exp(a, out=a)
        a *= self.seen[lo:]
        h = a @ v
        h /= (a @ np.ones((a.shape[2], 1), np.float32))
        h += x
        h += self.p["pos"][lo:]
        z = h.reshape(-1, h.shape[2]) @ self.p["out"]
        z += self.p["bias"]
        np.clip(z, -60, 60, out=z)
        flat = target.ravel()
        got = z[np.arange(len(z)), self.cls[flat]]
        np.exp(z, out=z)
        return ((got - np.log(z @ np.ones(z.shape[1], np.float32))) / math.log(10) + self.inside[flat]).reshape(target.shape)


_SCORERS: dict[int, tuple] = {}


def _scorer(model: SubwordModel) -> _Scorer:
    """The last model's scorer stays with the worker process."""
    if id(model.net) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model.net)] = model, _Scorer(model)
    return _SCORERS[id(model.net)][1]


def _classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Ids in order of frequency, cut into classes of about equal mass; the most frequent have one to themselves."""
    order = np.argsort(-counts, kind="stable")
    mass, out, left, k, held = counts[order] + 1.0, np.zeros(len(counts), np.int64), counts.sum() + float(len(counts)), 0, 0.0
    for n, i in enumerate(order):
        if held and held + mass[n] / 2 > left / (classes - k) and k < classes - 1:
            left, k, held = left - held, k + 1, 0.0
        out[i] = k
        held += mass[n]
    return out


def _cut(seq: np.ndarray, window: int) -> np.ndarray:
    """A text's ids between two ends as windows (n, window + 1) that share only their edge ids, so that each id is a target once; -1 fills the last."""
    n = len(seq) - 1
    at = np.arange(-(-n // window))[:, None] * window + np.arange(window + 1)
    return np.where(at <= n, seq[np.minimum(at, n)], -1)


def _lesson(rows: np.ndarray, cls: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input classes and ids, target classes, and which targets are real, of windows from _cut."""
    ids = np.where(rows < 0, end, rows)
    return cls[ids[:, :-1]], ids[:, :-1], cls[ids[:, 1:]], rows[:, 1:] >= 0


def _drawn(draw: int, n: int, rate: int) -> np.ndarray:
    """Which of a text's n windows are in a sample of rate / 2^30 of all windows."""
    z = (np.uint64(draw << 32) + np.arange(n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(34)) < np.uint64(rate)


def _windows(batches: Iterator[pa.RecordBatch], window: int, pick) -> Iterator[np.ndarray]:
    """Windows of each text of (ids, draw) that pick(draw, their number) marks."""
    for b in batches:
        ids, draws = b.column(0), b.column(1).to_pylist()
        values, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()
        for lo, hi, draw in zip(cuts[:-1], cuts[1:], draws):
            rows = _cut(values[lo:hi].astype(np.int64), window)
            yield rows[pick(draw, len(rows))]


def _round(texts: DataFrame, model: SubwordModel, window: int, turn: int, rounds: int, rate: float, batch: int) -> None:
    """One round of learning: the windows of this turn in all partitions; model.net gets the mean of the tasks' weights.

    Weights are summed as whole numbers, so that the order of the sum doesn't matter. What a task
    sends, and what the driver gets, is of fixed size.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)
    unit = float(1 << 20)
    slots = {n: w.shape for n, w in model.net.p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        net = AttentionLm(1, window)
        net.dim, net.p = known.net.dim, {n: w.copy() for n, w in known.net.p.items()}
        adam, held, size, seen = Adam(net), [], 0, 0

        def learnt(least: int) -> None:
            nonlocal held, size
            rows = np.concatenate(held)
            lo = 0
            while len(rows) - lo >= least:
                adam.step(net.gradients(*_lesson(rows[lo : lo + batch], known.cls, known.end)), rate)
                lo += batch
            held, size = [rows[lo:]], max(0, len(rows) - lo)

        for rows in _windows(batches, window, lambda draw, n: (draw + np.arange(n)) % rounds == turn):
            held.append(rows)
            size += len(rows)
            seen += len(rows)
            if size >= 4 * batch:
                learnt(batch)
        if size:
            learnt(1)
        if seen:
            flat = np.concatenate([net.p[n].ravel() for n in slots]).astype(np.float64)
            values = np.r_[seen, np.rint(flat * unit).astype(np.int64) * seen]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["slot", "v"])

    got = texts.mapInArrow(run, "slot int, v long").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()  # one row per weight
    sent.unpersist()
    if not got.num_rows:
        return
    values = got.column(1).to_numpy()[np.argsort(got.column(0).to_numpy())]
    flat, lo = (values[1:] / values[0] / unit).astype(np.float32), 0
    for n, shape in slots.items():
        model.net.p[n] = flat[lo : lo + math.prod(shape)].reshape(shape)
        lo += math.prod(shape)


def learn(docs: DataFrame, path: str, hot: int, classes: int, window: int, max_windows: int, rounds: int = 2, rate: float = 0.004, batch: int = 128) -> tuple:
    """Word counts (a stored table), N, V, the hot words, the fitted subword model, and all texts' ids between two ends (doc_id, held, text_key, ids). docs: doc_id, text, held, text_key."""
    grain = 1 << 30
    flagged = docs.select("text", "doc_id", "held", "text_key", F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(grain)).alias("draw"))
    size, end = subwords(path).size, subwords(path).end
    names = ["word", "n", "ids", "doc_id", "held", "text_key", "draw", "windows"]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, words, subs = subwords(path), Counter(), np.zeros(size, np.int64)

        def rows(size: int, **cols: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(size, t)) for c, t in zip(names, kinds)], names)

        def flush() -> pa.RecordBatch:
            out = rows(len(words), word=pa.array(list(words), pa.string()), n=pa.array(list(words.values()), pa.int64()))
            words.clear()
            return out

        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                seqs = []
                for t, held in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    ids = np.array([end, *coder.coder.encode_ordinary(t or ""), end], np.int32)
                    if not held:
                        words.update(words_of(t))
                        np.add.at(subs, ids[1:], 1)
                    seqs.append(ids)
                sizes = np.array([len(q) for q in seqs])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(seqs)))
                yield rows(len(seqs), ids=lists, doc_id=b.column(1), held=b.column(2), text_key=b.column(3), draw=b.column(4), windows=pa.array(-(-(sizes - 1) // window), pa.int64()))
                if len(words) > 300_000:
                    yield flush()
        yield flush()
        used = np.flatnonzero(subs)
        yield rows(len(used), n=pa.array(subs[used]), draw=pa.array(used, pa.int64()))

    seen = stored(flagged.mapInArrow(count, "word string, n long, ids array<int>, doc_id long, held boolean, text_key long, draw long, windows long"), "lm-counts")
    counts = durable(seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(hot).toArrow()
    hot_words = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))

    freq = np.zeros(size, np.int64)
    subs = seen.where("word is null and n is not null").groupBy(F.col("draw").alias("id")).agg(F.sum("n").alias("n")).toArrow()  # at most one row per id of the vocabulary
    freq[subs.column(0).to_numpy()] = subs.column(1).to_numpy()
    cls = _classes(freq, classes)
    mass = np.bincount(cls, weights=freq + 1.0, minlength=classes)

    texts = seen.where("not held").select("ids", "draw")
    n_windows = seen.where("not held").agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    share = min(grain, max_windows * grain // max(1, n_windows))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _windows(batches, window, lambda d, n: _drawn(d, n, share)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.int64()))], ["ids"])

    first = texts.mapInArrow(draw, "ids array<long>").toArrow().column(0).to_pylist() if share else []  # about max_windows
    x, i, y, real = _lesson(np.array(sorted(first), np.int64).reshape(-1, window + 1), cls, end)
    model = SubwordModel(AttentionLm(classes, window).fit(x, i, y, real=real), cls, np.log10((freq + 1.0) / mass[cls]), end, path)
    for turn in range(rounds):
        _round(texts, model, window, turn, rounds, rate / (turn + 1), batch)
    return counts, total, distinct, hot_words, model, seen.where("held is not null").select("doc_id", "held", "text_key", "ids")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, hot: int = 200_000, classes: int = 64, window: int = 32, max_windows: int = 6_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Null and empty texts hold the end token only. Repeated rows come back as often as they came.
    Texts without an id are scored, and learnt from unless the rule on their empty name holds them out.
    Without any training text all counts are 0 and probabilities uniform.
    """
    path = path or default_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held"), F.xxhash64(text_col).alias("text_key"))
    counts, total, distinct, hot_words, model, coded = learn(base, path, hot, classes, window, max_windows)
    sent = docs.sparkSession.sparkContext.broadcast((hot_words, model))  # at most `hot` words, and a model of fixed size

    def attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = sent.value[1]
        for b in batches:
            values, cuts = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            scores = lm.score([values[x + 1 : y - 1].astype(np.int64) for x, y in zip(cuts[:-1], cuts[1:])])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(scores, pa.float64())], ["doc_id", "held_out", "text_key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {w: math.log10(c + 1) for w, c in sent.value[0].items()}
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                cols: list[list] = [[] for _ in range(8)]
                for i, h, key, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(1).to_pylist()):
                    n, total_log, n_known = 0, 0.0, 0
                    for w, tf in Counter(words_of(t)).items():
                        n += tf
                        got = logs.get(w)
                        if got is not None:
                            total_log += tf * got
                            n_known += tf
                        else:  # its count is joined to it
                            for c, v in zip(cols, (i, h, key, w, tf, None, None, None)):
                                c.append(v)
                    for c, v in zip(cols, (i, h, key, None, None, n, n_known, total_log)):
                        c.append(v)
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = ["doc_id", "held_out", "text_key", "word", "tf", "n_tokens", "n_known", "logs"]
    rows = stored(base.select("doc_id", "text", "held", "text_key").mapInArrow(run, "doc_id long, held_out boolean, text_key long, word string, tf long, n_tokens long, n_known long, logs double"), "lm-rows")
    scored = coded.mapInArrow(attended, "doc_id long, held_out boolean, text_key long, score double")
    joined = rows.where("word is not null").join(counts, "word", "left")
    tail = joined.select("doc_id", "held_out", "text_key", F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"))
    main = rows.where("word is null").select("doc_id", "held_out", "text_key", "n_tokens", "n_known", "logs")
    # Rows of one id and text are equal: they travel as one, and their sums are divided by their number.
    both = main.unionByName(tail, allowMissingColumns=True).unionByName(scored, allowMissingColumns=True).groupBy("doc_id", "held_out", "text_key")
    summed = both.agg(F.count("n_tokens").cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("known"), F.sum("logs").alias("logs"), F.max("score").alias("score"))
    floor = math.log10(total + distinct + 1)
    out = summed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") / F.col("copies") - F.col("n_tokens") * floor).alias("base_score"), "score")
