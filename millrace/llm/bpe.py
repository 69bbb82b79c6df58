"""BPE encoding and decoding by tree concatenation.

A text beyond `leaf` characters is halved, wherever that falls, until its parts are leaves. Leaves
are encoded on their own; neighbouring results then join in a tree. A join re-encodes a window of
k runs on each side of the seam (a run is what stands between white space) and doubles k until
the window begins and ends with runs that the two sides already had. That is exact: no piece
spans white space, so a run that is whole in a part is coded there as in the whole text.

A piece that nothing splits and that is beyond `leaf` symbols goes the same way one level down:
its leaves are encoded by the library in parallel, and windows of tokens grow at the joins until
their first and last tokens are those of the two sides. A token sequence is the encoding of its
text if and only if every two neighbours in it are the encoding of theirs, and after agreement
every neighbouring pair has been seen inside one encoding.

Runs repeat, so their ids are kept in a bounded table. Texts are dealt over tasks by Spark; the
parts of one text stay in its task, as its ids do in its row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Only such texts take the short way: composed Latin letters, ASCII and its four blanks. Unicode
#: normalisation leaves them alone, and Python and the library agree on their case and classes.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ž]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceBpe:
    """A `tokenizers` file of the kind normalise, split by a pattern, map bytes, merge with word ends."""

    def __init__(self, path: str, leaf: int = 1024, keep: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.tok = Tokenizer.from_file(path)
        self.cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.end = spec["model"].get("end_of_word_suffix") or ""
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.unmarked = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))  # lower-casing may spell a special token, which is then text
        self.last = Tokenizer.from_str(json.dumps(bare))
        self.inner = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.leaf, self.keep, self.seen, self.older = leaf, keep, {}, {}
        self.seams = self.windows = 0  # joined so far, and windows that it took

    def piece_ids(self, piece: str) -> list[int]:
        mapped = "".join(p for p, _ in self.to_bytes.pre_tokenize_str(piece))
        return self._tree(mapped) if len(mapped) > self.leaf else self._plain(self.last, mapped)

    @staticmethod
    def _plain(tok: Tokenizer, mapped: str) -> list[int]:
        return tok.encode(mapped, add_special_tokens=False).ids if mapped else []

    def _tree(self, mapped: str) -> list[int]:
        cuts = list(range(0, len(mapped), self.leaf))
        leaves = [mapped[c : c + self.leaf] for c in cuts]
        ids = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self._plain(self.last, leaves[-1])]
        while len(ids) > 1:
            joined = [self._join(mapped, cuts[i + 1], ids[i], ids[i + 1]) for i in range(0, len(ids) - 1, 2)]
            ids, cuts = joined + ids[len(joined) * 2 :], cuts[::2]
        return ids[0]

    def _length(self, ids: list[int], at_end: bool) -> int:
        return sum(len(self.tok.id_to_token(i)) for i in ids) - (len(self.end) if at_end and ids else 0)

    def _join(self, mapped: str, seam: int, left: list[int], right: list[int]) -> list[int]:
        k = 2
        at_end = seam + self._length(right, False) - len(self.end) == len(mapped)
        while True:
            l, r = left[-k:], right[:k]
            all_l, all_r = len(l) == len(left), len(r) == len(right)
            lo, hi = seam - self._length(l, False), seam + self._length(r, at_end and all_r)
            ids = self._plain(self.last if at_end and all_r else self.inner, mapped[lo:hi])
            if (all_l or ids[0] == l[0]) and (all_r or ids[-1] == r[-1]):
                return left[: len(left) - len(l)] + ids + right[len(r) :]
            k *= 2

    def _kept(self, run: str, whole: bool) -> tuple[str, str, int]:
        """What a run (white space around it, or one piece) becomes. Recent runs are remembered, in two generations of `keep`."""
        got = self.older.get(run)
        if got is None:
            if whole and len(run) <= 64:
                got = self._named(self.unmarked.encode(run, add_special_tokens=False).ids)
            else:
                got = self._of(self.pattern.findall(run) if whole else [run])
        if len(run) <= 64:
            if len(self.seen) >= self.keep:
                self.seen, self.older = {}, self.seen
            self.seen[run] = got
        return got

    def _of(self, pieces: list[str]) -> tuple[str, str, int]:
        return self._named([i for p in pieces for i in self.piece_ids(p)])

    def _named(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join(map(self.tok.id_to_token, ids)), len(ids)

    def _plain_runs(self, text: str) -> list[tuple]:
        """(run, its codes) of lower-cased plain text."""
        return [(run, (self.seen.get(run) or self._kept(run, True),)) for run in text.split()]

    def _other_runs(self, text: str) -> list[tuple]:
        """(run, codes of its pieces) of normalised text. Pieces that touch are one run."""
        runs: list[tuple] = []
        held, codes, end = [], [], -1
        for piece, (lo, hi) in self.cut.pre_tokenize_str(text):
            if held and lo != end:
                runs.append(("".join(held), tuple(codes)))
                held, codes = [], []
            held.append(piece)
            codes.append(self.seen.get(piece) or self._kept(piece, False))
            end = hi
        return runs + [("".join(held), tuple(codes))] if held else runs

    def _text_tree(self, text: str, runs: Callable[[str], list[tuple]]) -> list[tuple]:
        cuts = list(range(0, len(text), self.leaf))
        nodes = [runs(text[c : c + self.leaf]) for c in cuts]
        while len(nodes) > 1:
            joined = [self._seam(text, cuts[i + 1], nodes[i], nodes[i + 1], runs) for i in range(0, len(nodes) - 1, 2)]
            nodes, cuts = joined + nodes[len(joined) * 2 :], cuts[::2]
        return nodes[0] if nodes else []

    def _seam(self, text: str, seam: int, left: list[tuple], right: list[tuple], runs: Callable[[str], list[tuple]]) -> list[tuple]:
        self.seams += 1
        k = 1
        while True:
            l, r = left[-k:], right[:k]
            lo = hi = seam
            for run, _ in reversed(l):  # between runs there is white space only
                lo = text.rindex(run, 0, lo)
            for run, _ in r:
                hi = text.index(run, hi) + len(run)
            window = runs(text[lo:hi])
            self.windows += 1
            if (len(l) == len(left) or window[:1] == l[:1]) and (len(r) == len(right) or window[-1:] == r[-1:]):
                return left[: len(left) - len(l)] + window + right[len(r) :]
            k *= 2

    def coded(self, text: str | None) -> tuple[list[str], list[str], int]:
        """Runs of decimal ids, the same runs decoded, and how many tokens they are."""
        out: list[tuple[str, str, int]] = []
        for part in (self.special.split(text) if self.special and text else [text or ""]):
            if self.special and self.special.fullmatch(part):
                out.append((str(self.tok.token_to_id(part)), part, 1))
                continue
            if _PLAIN.fullmatch(part):
                whole, runs = part.lower(), self._plain_runs
            else:
                whole, runs = self.tok.normalizer.normalize_str(part), self._other_runs
            out += [code for _, codes in self._text_tree(whole, runs) for code in codes]
        out = [x for x in out if x[2]]
        return [x[0] for x in out], [x[1] for x in out], sum(x[2] for x in out)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for run in self.coded(text)[0] for i in run.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode of a file without a decoder: tokens joined by spaces; unknown ids are left out."""
        return " ".join(t for t in map(self.tok.id_to_token, ids) if t is not None)


_LOADED: dict[tuple, PieceBpe] = {}


def loaded(path: str, leaf: int = 1024) -> PieceBpe:
    """One tokenizer per worker process and file."""
    if (path, leaf) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _LOADED[path, leaf] = PieceBpe(path, leaf)
    return _LOADED[path, leaf]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, leaf: int = 1024) -> DataFrame:
    """docs with `ids` (array of int) and `decoded` (string). Null text counts as empty: no ids, empty string.

    The two names replace columns of the same name; all other columns and all rows stay.
    """
    path = path or default_path()
    base = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")])
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, leaf)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                ids, decoded = [], []
                for t in part.column(at):
                    runs, texts, _ = bpe.coded(t.as_py())
                    ids.append([int(i) for run in runs for i in run.split(" ")])
                    decoded.append(" ".join(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*part.schema.names, "ids", "decoded"])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """rows with `decoded`, the text of ids_col (null ids: null)."""
    path = path or default_path()
    base = rows.select(*[c for c in rows.columns if c != "decoded"])
    at = base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            texts = [None if x.as_py() is None else bpe.decode([i for i in x.as_py() if i is not None]) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = 1024) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, by the same encoder, without carrying the ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, leaf)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                runs, texts, count = bpe.coded(t.as_py())
                n.append(count)
                of_ids.append(hashlib.sha256(" ".join(runs).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join(texts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
