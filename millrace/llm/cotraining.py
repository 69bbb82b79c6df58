"""Quality classifier by co-training of two views.

One view sees what a text says (its symbols and words), the other what is known of the page
(language, source, size, layout). Both start from the labelled rows. In each round each view
labels the unlabelled rows that it is surest of, in the proportion of the classes, and hands
them to the other view. Afterwards each view is calibrated on labelled rows that no round has
seen, and a stacked logistic model on the two calibrated logits scores every document.

Fitting uses samples of at most about `max_labelled` and `max_unlabelled` rows, taken by a
hash of the id; only their features come to the driver. Scoring covers all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_HASHED = 32


def text_view(text: str | None) -> np.ndarray:
    """Symbol shares and word statistics of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    groups = [seen[97:123].sum(), seen[65:91].sum(), seen[48:58].sum(), seen[32], seen[128:].sum(), seen[:32].sum(), *seen[_PUNCT]]
    words = raw.split()
    counts = Counter(words)
    k = max(1, len(words))
    top = counts.most_common(1)[0][1] if counts else 0
    lead = math.log1p(k)
    stats = [sum(map(len, words)) / k, len(counts) / k * lead, top / k * lead, lead, sum(w[-1] in b"!$%&*#|" for w in words) / k]
    return np.array([math.log1p(1000 * int(g) / n) for g in groups] + stats)


def page_view(text: str | None, meta: tuple) -> np.ndarray:
    """Metadata columns (text ones hashed to buckets, numbers as logarithms) and the page's layout."""
    out: list[float] = []
    for v in meta:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(math.log1p(abs(v)) if math.isfinite(v) else 0.0)
        elif isinstance(v, _Missing):
            out.append(0.0)
        else:
            one = np.zeros(_HASHED)
            if v is not None:
                one[zlib.crc32(str(v).encode()) % _HASHED] = 1
            out += one.tolist()
    lines = (text or "").split("\n")
    sizes = [len(x) for x in lines]
    return np.array([*out, math.log1p(len(lines)), math.log1p(max(sizes)), math.log1p(sum(sizes) / len(sizes)), len(set(lines)) / len(lines)])


class _Missing:
    """A number that isn't there."""


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[1:] + self.w[0], -30, 30)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps. With one class only it gives that class."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (weight * (p - y)) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


class Model(NamedTuple):
    views: tuple[Logistic, Logistic] | None
    calibration: tuple[Logistic, Logistic] | None
    stack: Logistic | None
    meta_cols: tuple[str, ...]
    numeric: tuple[bool, ...]
    #: Pseudo-labels that either view has received, for reports.
    handed: tuple[int, int] = (0, 0)

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by page, and of both together. Without labels all are 1."""
        if self.views is None:
            return (np.ones(len(a)),) * 3
        prob = lambda v: 1 / (1 + np.exp(-v))
        logits = np.stack([c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (a, b))], axis=1)
        return prob(logits[:, 0]), prob(logits[:, 1]), prob(self.stack.logit(logits))


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, ua: np.ndarray, ub: np.ndarray, meta_cols: tuple = (), numeric: tuple = (), rounds: int = 5, share: float = 0.1, sure: float = 0.95) -> Model:
    """Views a and b of labelled rows, y their labels (0 or 1), ua and ub the views of unlabelled rows."""
    if len(set(y.tolist())) < 2:
        return Model(None, None, None, meta_cols, numeric)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    fit_on = lambda x, y, w: train(x, y, w * np.where(y > 0, 0.5 / max(1e-9, (w * y).sum()), 0.5 / max(1e-9, (w * (1 - y)).sum())) * w.sum())
    own = [(x[~held], y[~held].astype(float), np.ones((~held).sum())) for x in (a, b)]
    free, given = [np.ones(len(ua), bool), np.ones(len(ub), bool)], [0, 0]
    for _ in range(rounds):
        views = [fit_on(*t) for t in own]
        for v, (x, other) in enumerate(((ua, ub), (ub, ua))):
            if not len(x):
                continue
            p = 1 / (1 + np.exp(-views[v].logit(x)))
            for label, rate in ((1, y.mean()), (0, 1 - y.mean())):
                conf = np.where(free[1 - v], p if label else 1 - p, -1)
                most = max(1, int(share * rate * len(x)))
                take = np.argsort(-conf, kind="stable")[:most]
                take = take[conf[take] >= sure]
                free[1 - v][take] = False
                given[1 - v] += len(take)
                tx, ty, tw = own[1 - v]
                own[1 - v] = (np.vstack([tx, other[take]]), np.r_[ty, np.full(len(take), float(label))], np.r_[tw, np.full(len(take), 0.5)])
    views = tuple(fit_on(*t) for t in own)
    test = held if held.any() else np.ones(len(y), bool)
    calibration = tuple(train(v.logit(x[test])[:, None], y[test].astype(float)) for v, x in zip(views, (a, b)))
    logits = np.stack([c.logit(v.logit(x[test])[:, None]) for v, c, x in zip(views, calibration, (a, b))], axis=1)
    return Model(views, calibration, train(logits, y[test].astype(float)), meta_cols, numeric, tuple(given))


def _views(batch: pa.RecordBatch, numeric: tuple[bool, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose first column is the text and whose next ones are the metadata."""
    texts = batch.column(0).to_pylist()
    cols = [[_Missing() if v is None and n else float(v) if n else v for v in batch.column(1 + i).to_pylist()] for i, n in enumerate(numeric)]
    rows = list(zip(*cols)) if cols else [()] * len(texts)
    return np.array([text_view(t) for t in texts]), np.array([page_view(t, m) for t, m in zip(texts, rows)])


def _select(docs: DataFrame, text_col: str, meta_cols: tuple[str, ...], numeric: tuple[bool, ...]) -> list:
    return [F.col(text_col).alias("__t"), *[F.col(c).cast("double" if n else "string").alias(f"__m{i}") for i, (c, n) in enumerate(zip(meta_cols, numeric))]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 12_000, max_unlabelled: int = 12_000) -> Model:
    """Co-train on samples of the labelled and of the other documents.

    Several labels of one id count by their mean, a tie as good; null labels and ids are left out.
    Metadata columns that docs lacks are left out too.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    meta_cols = tuple(c for c in meta_cols if c in kinds)
    numeric = tuple(isinstance(kinds[c], T.NumericType) for c in meta_cols)
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    grain = 1 << 20
    n_known, n_docs = labels.count(), docs.count()
    pick = lambda c, most, n: F.pmod(F.xxhash64(c, F.lit("fit")), F.lit(grain)) < min(grain, most * grain // max(1, n))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), *_select(docs, text_col, meta_cols, numeric))
    some = F.broadcast(known.where(pick("__id", max_labelled, n_known)))  # bounded by max_labelled
    rows = base.where(pick("__id", max_labelled, n_known) | pick("__id", max_unlabelled, n_docs)).join(some, "__id", "left").where(F.col("__y").isNotNull() | pick("__id", max_unlabelled, n_docs))
    rows = rows.select("__id", "__y", "__t", *[f"__m{i}" for i in range(len(meta_cols))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, z = _views(b.select(range(2, b.num_columns)), numeric)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(z.tolist(), pa.list_(pa.float64()))], ["id", "y", "a", "b"])

    got = rows.mapInArrow(run, "id long, y int, a array<double>, b array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["a"]))
    lab, free = [r for r in got if r["y"] is not None], [r for r in got if r["y"] is None]
    grid = lambda rs, k: np.array([r[k] for r in rs]) if rs else np.empty((0, len(got[0][k]) if got else 0))
    return cotrain(grid(lab, "a"), grid(lab, "b"), np.array([r["y"] for r in lab], int), grid(free, "a"), grid(free, "b"), meta_cols, numeric)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with p_text, p_page, score (probabilities of good quality) and keep (score >= threshold).

    The four names replace columns of the same name; all rows and other columns stay. Null and empty
    texts are scored by what they are: no symbols, no words.
    """
    kept = [c for c in docs.columns if c not in ("p_text", "p_page", "score", "keep")]
    base = docs.select(*kept, *_select(docs, text_col, model.meta_cols, model.numeric))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, z = _views(b.select(range(len(kept), b.num_columns)), model.numeric)
                p = model.scores(x, z)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, p), pa.array(p[2] >= threshold)], [*kept, "p_text", "p_page", "score", "keep"])

    added = [T.StructField(c, T.DoubleType()) for c in ("p_text", "p_page", "score")] + [T.StructField("keep", T.BooleanType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields[: len(kept)], *added]))


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The docs that score keeps, with all their columns as they came."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col), *[c for c in model.meta_cols if c != text_col])
    return score(packed, model, text_col, threshold).where("keep").select("__row.*")
