"""SimHash near-duplicates: exact search within a Hamming radius, by tiles.

Fingerprints become candidates through blocks of bits: split into radius + 1 blocks, two
fingerprints within the radius agree in at least one block, so every link lies inside some
(block, value) bucket. In a crowded bucket the same holds of the other bits, which name smaller
buckets. Buckets are compared exhaustively, tile against tile, with numpy exclusive-or and bit
counts. A bucket over `tile` rows is cut into tiles by population count; two tiles meet only if
their counts differ by no more than the radius, and no row is copied for tile pairs that are
skipped. So no task holds an unbounded bucket and no pair of a bucket is missed.

Equal fingerprints are one row throughout; copies come back by a join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.components import roots as _roots
from millrace.llm.shared import stored

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_COLUMNS = (np.arange(8) * 256).astype(np.int64)
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; 0 for a text without words.

    Words are runs of bytes that aren't ASCII white space, A-Z lower-cased; a text of fewer
    than `width` words is one shingle. A bit is set if over half of the shingle hashes have it.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    total, counts = len(words) - width + 1, np.zeros((8, 8))
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        hashes = np.fromiter((h(line[s : e - 1], seed) for s, e in zip(starts[lo:hi], ends[lo + width - 1 : hi + width - 1])), np.uint64, hi - lo)
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMNS).ravel(), minlength=2048)
        counts += seen.reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of each row. text_key is a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _compare(tile: np.ndarray, fp: np.ndarray, radius: int, small: int = 64, side: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of each tile group, as a spanning forest. Rows come sorted by tile and population count."""
    n = len(fp)
    bits = np.bitwise_count(fp).astype(np.int16)
    cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
    left, right = [], []
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    rows = np.flatnonzero((size > 1) & (size <= small))
    for lag in range(1, small):  # small groups of the whole batch at once, by distance in the order
        rows = rows[rows + lag < n]
        rows = rows[(tile[rows + lag] == tile[rows]) & (bits[rows + lag] - bits[rows] <= radius)]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + lag]) <= radius]
        left.append(near)
        right.append(near + lag)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a <= small:
            continue
        for x in range(a, b, side):
            xs = slice(x, min(b, x + side))
            for y in range(x, b, side):
                ys = slice(y, min(b, y + side))
                if bits[ys.start] - bits[xs.stop - 1] > radius:  # sorted: all later tiles differ by more
                    break
                i, j = np.nonzero(np.bitwise_count(fp[xs, None] ^ fp[None, ys]) <= radius)
                off = i + xs.start < j + ys.start
                i, j = i[off], j[off]
                if len(i):  # a dense tile pair is many links; keep what spans it
                    both = np.unique(np.r_[i + xs.start, j + ys.start])
                    root = _roots(len(both), np.searchsorted(both, i + xs.start), np.searchsorted(both, j + ys.start))
                    linked = np.flatnonzero(root != np.arange(len(both)))
                    left.append(both[root[linked]])
                    right.append(both[linked])
    if not left:
        return np.empty(0, int), np.empty(0, int)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return i, j
    both = np.unique(np.r_[i, j])
    root = _roots(len(both), np.searchsorted(both, i), np.searchsorted(both, j))
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[root[linked]], both[linked]


def tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """(bucket, key, fp, ...) -> the same with `tile` and `bits`, each row once for every tile pair of its bucket that it takes part in, a tile's rows together and in order of population count.

    A bucket of at most `tile` rows is one tile. A larger one is cut by population count, and where one
    count has too many rows, by the key's hash; tiles whose counts differ by more than the radius don't meet.
    """
    counted = rows.withColumn("bits", F.bit_count("fp"))
    crowded = rows.groupBy("bucket").count().where(F.col("count") > tile).select("bucket")
    cells = counted.join(crowded, "bucket", "left_semi").groupBy("bucket", "bits").count()
    cuts = cells.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("bits", F.ceil(F.col("count") / tile).cast("int").alias("n")))).alias("cuts"))  # 65 entries at most
    met = counted.join(cuts, "bucket", "left")
    place = lambda b, n: F.struct(b.alias("b"), n.alias("n"))
    own = place(F.col("bits"), F.pmod(F.xxhash64("key"), F.element_at("cuts", F.col("bits"))).cast("int"))
    there = F.filter(F.sequence(F.col("bits") - radius, F.col("bits") + radius), lambda b: F.map_contains_key("cuts", b))
    others = F.flatten(F.transform(there, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("cuts", b) - 1), lambda n: place(b, n))))
    alone = F.expr("array(cast(null as struct<b:int,n:int>))")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("cuts").isNull(), alone).otherwise(others)))
    name = F.when(F.col("cuts").isNull(), F.xxhash64("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.withColumn("tile", name).drop("cuts", "own", "other", "bucket").repartition("tile").sortWithinPartitions("tile", "bits", "key")


def _blocks(fp: Column, width: int, blocks: int) -> list[Column]:
    """The lowest `width` bits of fp cut into blocks."""
    edges = [width * k // blocks for k in range(blocks + 1)]
    return [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(edges, edges[1:])]


def buckets(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """(bucket, key, fp): every two fingerprints within the radius share a bucket. fps: (fp)."""
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    value, rest = F.array(*_blocks(F.col("fp"), 64, blocks)), []
    for lo, hi in zip(edges, edges[1:]):  # the bits beyond a block, brought to the low end
        turned = F.shiftrightunsigned("fp", hi).bitwiseOR(F.shiftleft("fp", 64 - hi)) if hi < 64 else F.col("fp")
        rest.append(F.array(*_blocks(turned, 64 - (hi - lo), blocks)))
    keyed = fps.select("fp", F.posexplode(F.arrays_zip(value.alias("value"), F.array(*rest).alias("rest"))).alias("block", "x")).select("fp", F.xxhash64("block", "x.value").alias("outer"), "x.rest")
    # At most blocks * 2^(64/blocks) rows whatever the input (262,144 for radius 3), of which only the crowded ones are kept.
    crowded = keyed.groupBy("outer").count().where(F.col("count") > tile).select("outer", F.lit(True).alias("crowded"))
    met = keyed.join(F.broadcast(crowded) if radius <= 3 else crowded, "outer", "left")
    inner = F.when(F.col("crowded"), F.transform("rest", lambda v, i: F.xxhash64(F.col("outer"), i, v))).otherwise(F.array("outer"))
    return met.select(F.explode(inner).alias("bucket"), F.col("fp").alias("key"), "fp")


def links(distinct_fps: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b): links that span every group of fingerprints within the radius. distinct_fps: (fp), no repeats, no nulls."""
    dealt = tiles(buckets(distinct_fps, radius, tile), radius, tile).select("tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, (fps,) in whole_tiles(batches):
            f = fps.view(np.uint64)
            i, j = _compare(t, f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sorted batches of (tile, columns of longs) cut so that no tile is split; at most two tiles of rows are held over."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        held = cols if held is None else [np.r_[h, c] for h, c in zip(held, cols)]
        if not len(held[0]):
            continue
        open_at = np.searchsorted(held[0], held[0][-1])  # the last tile may go on in the next batch
        if open_at:
            yield held[0][:open_at], [c[:open_at] for c in held[1:]]
            held = [c[open_at:] for c in held]
    if held is not None and len(held[0]):
        yield held[0], held[1:]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, tile: int = 2048) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of each row of docs.

    component_id is the smallest id that links of at most `radius` differing bits reach, the
    row's own included. Null and empty texts have fingerprint 0 and link like any other.
    A row without an id takes part; if no row of its component has an id, component_id is
    null. Repeated rows come back as often as they came. Other columns are not looked at.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    joined = components(links(distinct.select("fp"), radius, tile))
    labelled = stored(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = labelled.select("fp", "root", "n").join(smallest, "root")
    # At most 1,000 fingerprints can have a thousandth of the rows each; these are broadcast, and no copies pile up in one task.
    most = F.lit(max(1, rows.count() // 1000))
    hot = F.broadcast(found.where(F.col("n") > most).select("fp", F.col("component_id").alias("hot"), F.lit(True).alias("is_hot")))
    marked = rows.join(hot, "fp", "left")
    rest = marked.where("is_hot is null").select("doc_id", "text_key", "fp").join(found.where(F.col("n") <= most).select("fp", "component_id"), "fp")
    return marked.where("is_hot").select("doc_id", "text_key", "fp", F.col("hot").alias("component_id")).unionByName(rest.select("doc_id", "text_key", "fp", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """Docs with one row of each near-duplicate group: that of the smallest id (rows without an id last), all columns kept."""
    groups = near_duplicates(docs, id_col, text_col, radius, width).withColumn("group", F.coalesce("component_id", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = groups.groupBy("group", F.col("component_id").isNull()).agg(first).select(F.col("first.doc_id").alias("__kept_id"), F.col("first.text_key").alias("__kept_key"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(docs[text_col]) == F.col("__kept_key"))
    rows = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    return rows.withColumn("__key", F.xxhash64(text_col)).dropDuplicates([id_col, "__key"]).drop("__key")
