"""URL filter: a trie over reversed host labels, then path segments, with longest match.

A rule is (verdict, host, path): it fits its host and all subdomains of it when the URL's
path starts with the rule's path. Of the rules that fit, the one with the most host labels
wins, then the one with the longest path, then block over allow. The trie holds the whole
rule list, which the caller passes as a bounded Python sequence; `max_rules` holds it to a
size that every task may carry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import ascii_lower

def split_url(url: str) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end.

    Null URLs and those without :// have both empty.
    """
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    has = F.col(url).contains("://")
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


class RuleTrie:
    """Labels from the top of the host down; at each host a trie of path segments, whose last may be cut short."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            at = node["paths"] = node["paths"] or {"next": {}, "tails": {}}
            *whole, tail = path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "tails": {}})
            had = at["tails"].get(tail)
            if had is None or verdict == "block":
                at["tails"][tail] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._path(node["paths"], path) or best
        return best

    @staticmethod
    def _path(at: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            fits = [t for t in at["tails"] if segment.startswith(t)]
            if fits:
                best = at["tails"][max(fits, key=len)]
            at = at["next"].get(segment) if i + 1 < len(segments) else None
            if at is None:
                break
        return best


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (allow or block, host, path) each.

    rule is host + path of the winning rule, null where none fits; verdict is then `default`.
    The four names replace columns of the same name; all other columns and all rows stay.
    Raises ValueError for more than max_rules rules: such a list belongs in a table.
    """
    rules = [(v, h.lower(), p) for v, h, p in rules]
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are sent to every task")
    if bad := [v for v, _, _ in rules if v not in ("allow", "block")]:
        raise ValueError(f"verdicts must be allow or block: {bad[:3]}")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(url_col)
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            hosts, paths = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            found = [match(h, p) if h else None for h, p in zip(hosts, paths)]
            rule = pa.array([f and f[1] for f in found], pa.string())
            verdict = pa.array([f[0] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages that are not blocked, with all their columns as they came."""
    packed = pages.select(F.struct(*pages.columns).alias("__row"), F.col(url_col).alias("__link"))
    return judge(packed, rules, "__link", default).where("verdict = 'allow'").select("__row.*")
