"""Fill-in-middle transformation: texts cut at two word boundaries and dealt anew around sentinels.

Each text becomes an array of code points (UTF-32). Code points fall into two classes, blank and not;
a token ends wherever a blank follows a word, and at the end of the text, so comparing neighbouring
classes yields all boundaries at once. Two ranks, drawn by hash of the document's id, are looked up
among them; the pieces between are slices of the array, encoded again. Work and memory are those of
one text at a time, and a row's result depends on that row alone, whichever executor makes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)
_ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Ends, in code points, of a text's tokens: blanks with the word after them, and blanks at the end. The first entry is 0, no tokens."""
    if not len(codes):
        return np.zeros(1, np.int64)
    blank = np.isin(codes, _BLANK)
    return np.r_[0, np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(codes)]


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2^32 out of the id; rows without an id draw those of an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(text: str | None, doc_id: int | None, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = boundaries(codes)
    n = len(ends) - 1
    a, b, whether, which = draws(doc_id, seed)
    if not n or whether % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    lo, hi = sorted((int(ends[a % (n + 1)]), int(ends[b % (n + 1)])))
    prefix, middle, suffix = (codes[s].tobytes().decode("utf-32-le") for s in (slice(lo), slice(lo, hi), slice(hi, None)))
    p, s, m = marks
    if which % 100 < spm_rate:
        return n, "spm", lo, hi - lo, s + suffix + p + prefix + m + middle
    return n, "psm", lo, hi - lo, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Docs with n, form, prefix_chars, middle_chars and output; columns of these names are replaced, all rows and other columns stay.

    rate and spm_rate are percentages: of texts that are dealt anew, and of those, with the suffix first. Null
    texts count as empty and stay plain, as do texts that hold a mark. Repeated rows give repeated results; an
    empty table gives an empty one.
    """
    base = docs.select(*[c for c in docs.columns if c not in _ADDED.names])
    ids, texts = base.columns.index(id_col), base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                made = [transformed(t.as_py(), d.as_py(), seed, rate, spm_rate, marks) for t, d in zip(b.column(texts), b.column(ids))]
                added = [pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *_ADDED.names])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *_ADDED.fields]))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of.

    A dealt text holds no mark of its own, and no mark ends as another begins, so each is found at its first place.
    """
    p, s, m = marks

    def after(x: Column, mark: str) -> Column:
        return F.substring(x, F.instr(x, mark) + len(mark), F.length(x))

    def before(x: Column, mark: str) -> Column:
        return F.substring(x, F.lit(1), F.instr(x, mark) - 1)

    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
