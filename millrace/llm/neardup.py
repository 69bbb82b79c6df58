"""SimHash near-duplicates at a stated similarity of word shingles: the SimHash search with other buckets.

For similar rather than all but equal texts the radius is wide (26 of 64 bits for a similarity of
0.8), and blocks of bits would be too short to name buckets. Here a set's rarest shingles name
them: two sets of similarity t or more share an element among the first n - ceil(t n) + 1 of each,
in any one order of all elements, so no such pair is missed. The order puts elements first whose
count (in a table by hash, which grows with the number of rows up to a bound) is small, so that
common lines name few candidates.

Each different set is one node. A bucket's nodes first meet its least and greatest one. Buckets that
still hold several components are compared exactly in tiles of bounded size: fingerprints by exclusive-or
and bit counts, blocks whose population counts differ beyond the radius being skipped, then marks,
of 2,048 bits each. A mark has the parity of how many elements fall on each bit, so that two marks never
differ in more bits than their sets differ in elements: what they put out of reach is no link, and
nothing is left to chance. Sets of more than 1,024 elements would fill such a mark; they have a wide one besides, of two
to four bits an element, and of two wide marks the longer is folded to the other's length. Texts that merely share a template
end here and leave no pair.

Of its likely pairs a tile sends a spanning forest only, and the nodes that are in any. What the forests don't join is confirmed
inside tiles of those nodes only that are in likely pairs still, cut anew by the size of their sets, which are sent there. All links are confirmed on whole
sets, made again from one text of each node that needs it. A pair of similarity 0.8 differs
in 9.7 of 64 bits on average with a deviation of 2.9, so that fewer than one in 10^7 lies beyond
the radius of 26, six deviations off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import bayes_minhash as bayes
from millrace.llm.components import components
from millrace.llm.shared import bitmap, in_bitmap, stored
from millrace.llm.shingles import mixed, shingles

#: Bits of a mark.
MARK = 2048
#: Shingles in a piece of a bucket that is compared by marks, at most about so many; a wide mark has half a byte of each at most.
_MARKED = 1 << 25


def set_fingerprint(items: np.ndarray, words: int = 1) -> list[int]:
    """SimHash of a set of hashes in 64-bit words, each from the hashes mixed anew: a bit is 1 if over half of them have it."""
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(items), 1 << 12):
        h = [items[lo : lo + (1 << 12)].view(np.uint64)]
        for _ in range(words - 1):
            h.append(mixed(h[-1]))
        ones += np.unpackbits(np.stack(h, axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(items), bitorder="little").view(np.int64).tolist()


def mark(items: np.ndarray, bits: int = MARK) -> np.ndarray:
    """A bit is 1 if an odd number of elements falls on it; an element differing flips one bit at most."""
    at = (items.view(np.uint64) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little")


def wide_mark(items: np.ndarray) -> np.ndarray:
    """The mark of a large set, at two bits an element or more, in 64-bit words; empty for sets to which `mark` gives as much."""
    if 2 * len(items) <= MARK:
        return np.empty(0, np.int64)
    return mark(items, min(1 << 24, 1 << (2 * len(items) - 1).bit_length())).view(np.int64)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """The wide mark that the set would have at so many words."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _wide_apart(wide: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the wide marks of the pairs (i, j) differ; 0 where one has none."""
    size, out = np.fromiter(map(len, wide), np.int64, len(wide)), np.zeros(len(i), np.int64)
    words = np.minimum(size[i], size[j])
    for w in np.unique(words[words > 0]).tolist():
        at = np.flatnonzero(words == w)
        rows, place = np.unique(np.r_[i[at], j[at]], return_inverse=True)
        held = np.stack([_folded(wide[r], w) for r in rows.tolist()]).view(np.uint64)
        x, y, step = place[: len(at)], place[len(at) :], max(1, (1 << 20) // w)
        for lo in range(0, len(at), step):
            out[at[lo : lo + step]] = np.bitwise_count(held[x[lo : lo + step]] ^ held[y[lo : lo + step]]).sum(axis=1, dtype=np.int64)
    return out


def reach(least: float, bits: int = 64) -> int:
    """The radius within which sets of this similarity lie, six deviations beyond the mean number of differing bits."""
    p = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    return min(bits, math.floor(bits * p + 6 * math.sqrt(bits * p * (1 - p))))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))


def _counts(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How often elements of each slot occur. The table has a slot for every few rows, 65,536 at least and four million at most."""
    slots = 1 << min(22, max(16, math.ceil(math.log2(docs.count() / 4 + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(seen, shingles(t.as_py(), width) & (slots - 1), 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used])], ["slot", "n"])

    got = docs.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _rows(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, percent: int, width: int, common: int = 10_000) -> DataFrame:
    """(doc_id, text_key, key, n, fp, mark, wide, first, common) of each row: its set's size, fingerprint, marks and the elements through which it meets sets like it.

    Of equal sets in a task one has the last five; an empty set has no key. Elements of `first` occur `common` times at most,
    or eight times as often as the mean slot's; those that may occur more often stand apart.
    """
    sent, slots, most = docs.sparkSession.sparkContext.broadcast(counts), len(counts), max(common, 8 * int(counts.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in bayes._batches(batches):
            keys, n, fps, marks, wide, first, often = [], [], [], [], [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), width)
                key = xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None
                keys.append(key)
                n.append(len(x))
                if key is None or key in seen:
                    fps.append(None)
                    marks.append(None)
                    wide.append(None)
                    first.append(None)
                    often.append(None)
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(key)
                fps.append(set_fingerprint(x)[0])
                marks.append(mark(x).tobytes())
                wide.append(wide_mark(x))
                need = -(-len(x) * percent // 100)
                count = sent.value[x & (slots - 1)]
                on = np.lexsort((x, count))[: len(x) - need + 1]
                first.append(x[on[count[on] <= most]])
                often.append(x[on[count[on] > most]])
            cols = [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(marks, pa.binary()), pa.array(wide, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "key", "n", "fp", "mark", "wide", "first", "common"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, key binary, n long, fp long, mark binary, wide array<long>, first array<long>, common array<long>")


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, key, n, text_key, fp, mark, wide, bands, common): one row per different set."""
    first = rows.where("mark is not null").groupBy("key").agg(F.min_by(F.struct("n", "text_key", "fp", "mark", "wide", F.col("first").alias("bands"), "common"), "text_key").alias("x"))
    return first.select(F.monotonically_increasing_id().alias("node"), "key", "x.*")


def _met(nodes: DataFrame) -> DataFrame:
    """(bucket, node, m, load, lo, hi) of nodes that aren't alone in a bucket, as bayes._met gives them: in one shuffle, but for common elements, which may crowd a bucket."""
    of = Window.partitionBy("bucket")
    dealt = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    met = dealt.select("bucket", "node", F.count("*").over(of).alias("m"), F.sum("n").over(of).alias("load"), F.min("node").over(of).alias("lo"), F.max("node").over(of).alias("hi"))
    common = bayes._met(nodes.where(F.size("common") > 0).select("node", "n", F.col("common").alias("bands")))
    return stored(met.where("m > 1").unionByName(common), "near-met")


def _only(right: DataFrame, rows: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """right without nodes that stored rows don't have, so that these aren't shuffled to the join; right itself if those are too many to be sent."""
    few = rows.select("node").distinct()
    return right.join(F.broadcast(few), "node", "left_semi") if few.count() * 16 <= max_bytes else right


def _within(n: Column, apart: Column, percent: int) -> Column:
    """Sets of n elements together that differ in `apart` of them are so similar."""
    return (100 + percent) * apart <= (100 - percent) * n


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, radius: int) -> DataFrame:
    """The stored pairs (a, b) that neither sizes nor fingerprints nor marks rule out, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bayes._batches(batches, 4096):
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (3, 4))
            on = np.flatnonzero((100 + percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - percent) * b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), b.column(1).take(pa.array(on))], ["a", "b"])

    both = bayes._with_both(pairs, nodes.select("node", "n", "fp", "mark"))
    both = both.where(_within(F.col("n_a") + F.col("n_b"), F.abs(F.col("n_a") - F.col("n_b")), percent) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius))
    return stored(both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "mark_a", "mark_b").mapInArrow(run, "a long, b long"), "near-likely")


def compared(side: np.ndarray, n: np.ndarray, part: np.ndarray, fp: np.ndarray, marks: np.ndarray, percent: int, radius: int, block: int = 512, wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, weight) of likely pairs of different parts in a tile: of its two sides, or within its only one. Pairs that differ least weigh most. wide: the sets' wide marks."""
    fp, marks = fp.view(np.uint64), np.ascontiguousarray(marks).view(np.uint64)
    bits = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((bits, side))
    cut = int(np.searchsorted(side[order], 1))
    inside = cut in (0, len(side))
    end = len(side) if inside else cut
    for x in range(0, end, block):
        xs = order[x : min(x + block, end)]
        for y in range(x if inside else cut, len(side), block):
            ys = order[y : y + block]
            if max(bits[ys[0]] - bits[xs[-1]], bits[xs[0]] - bits[ys[-1]]) > radius:
                continue
            met = (part[xs, None] != part[None, ys]) & (np.bitwise_count(fp[xs, None] ^ fp[None, ys]) <= radius)
            met &= (100 + percent) * np.abs(n[xs, None] - n[None, ys]) <= (100 - percent) * (n[xs, None] + n[None, ys])
            if inside and x == y:
                met &= np.arange(len(xs))[:, None] < np.arange(len(ys))[None, :]
            a, b = np.nonzero(met)
            for lo in range(0, len(a), 1 << 15):
                i, j = xs[a[lo : lo + (1 << 15)]], ys[b[lo : lo + (1 << 15)]]
                apart = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
                on = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
                i, j, apart = i[on], j[on], apart[on]
                if wide is not None and len(i):
                    apart = np.maximum(apart, _wide_apart(wide, i, j))
                    on = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
                    i, j, apart = i[on], j[on], apart[on]
                if len(i):
                    yield i, j, -apart


def _forests(dealt: DataFrame, nodes: DataFrame, near: Callable) -> DataFrame:
    """(a, b, bucket, node): of each tile likely pairs (a, b) that, if all are links, join what all of its likely pairs would, and its nodes that are in any likely pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, bucket, node, part, n, fp, marks, wide in bayes._whole_tiles(batches):
            seen = np.zeros(len(node), bool)

            def found() -> Iterator[tuple[np.ndarray, ...]]:
                for i, j, w in near(side, n, part, fp, marks, wide):
                    seen[i] = seen[j] = True
                    yield i, j, w

            for i, j, _ in bayes._spanning(part, found()):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], names)
            size = int(seen.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array(bucket[seen]), pa.array(node[seen])], names)

    names = ["a", "b", "bucket", "node"]
    return bayes._in_tiles(dealt, nodes.select("node", "n", "fp", "mark", "wide")).mapInArrow(run, "a long, b long, bucket long, node long").distinct()


def _suspects(dealt: DataFrame, nodes: DataFrame, near: Callable) -> DataFrame:
    """(bucket, node, part) of tiles' rows that are in any likely pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, bucket, node, part, n, fp, marks, wide in bayes._whole_tiles(batches):
            seen = np.zeros(len(node), bool)
            for i, j, _ in near(side, n, part, fp, marks, wide):
                seen[i] = seen[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (bucket, node, part)], ["bucket", "node", "part"])

    return bayes._in_tiles(dealt, _only(nodes, dealt).select("node", "n", "fp", "mark", "wide")).mapInArrow(run, "bucket long, node long, part long").distinct()


def _classed(rows: DataFrame) -> DataFrame:
    """(bucket) of buckets that hold several parts, one of those with the same nodes."""
    of = rows.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return of.where("p <> q").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")


def _sized(rows: DataFrame, nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows with their bucket's number of rows m and of shingles, load."""
    sized = stored(rows.join(_only(nodes, rows).select("node", "n"), "node"), "near-sized")
    per = sized.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("load"))
    return bayes.spread_join(sized.drop("n"), per, "bucket", crowded, F.xxhash64("node"))


def _cut_anew(suspects: DataFrame, nodes: DataFrame, tile: int) -> DataFrame:
    """The stored suspects in tiles by their own number and the size of their sets; of buckets with the same suspects one is left."""
    crowded = bayes.hot_keys(suspects, "bucket")
    left = stored(bayes.spread_join(suspects, _classed(suspects), "bucket", crowded, F.xxhash64("node")), "near-left")
    return bayes._tiled(_sized(left, nodes, crowded), tile)


def _links_in_tiles(suspects: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, near: Callable) -> DataFrame:
    """(a, b): links that join all that each tile's links join, confirmed on whole sets inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, side, _, node, part, n, fp, items, marks in bayes._whole_tiles(batches):
            label, a, b = np.unique(part, return_inverse=True)[1], [], []
            wide = np.empty(len(items), object)
            wide[:] = [wide_mark(x) for x in items]
            for i, j, w in near(side, n, part, fp, marks, wide):
                for k in np.argsort(-w, kind="stable").tolist():
                    x, y = i[k], j[k]
                    if label[x] == label[y]:
                        continue
                    common = len(np.intersect1d(items[x], items[y], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        label[label == label[y]] = label[x]
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = _only(nodes, suspects).select("node", "n", "fp", "mark").join(_only(sets, suspects), "node").select("node", "n", "fp", "items", "mark")
    return bayes._in_tiles(suspects, more).mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, tile: int = 4096) -> DataFrame:
    """(doc_id, text_key, group) of each row of docs: rows of one group are joined by links of at least this similarity, in whole percents. Texts without words are one group."""
    percent = round(100 * least)
    radius = reach(percent / 100)
    near = lambda side, n, part, fp, marks, wide: compared(side, n, part, fp, marks, percent, radius, wide=wide)
    rows = stored(_rows(docs, _counts(docs, text_col, width), id_col, text_col, percent, width), "near-rows")
    nodes = stored(_nodes(rows), "near-nodes")
    met = _met(nodes)
    to = lambda c: met.select(F.least(c, "node").alias("a"), F.greatest(c, "node").alias("b"))
    tried = stored(to("lo").union(to("hi")).where("a <> b").distinct(), "near-tried")
    likely = _likely(tried, nodes, percent, radius)
    wanted = lambda pairs: nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi").select("node", "key", "text_key")
    known = stored(wanted(likely), "near-wanted")
    sets = bayes._sets(docs, text_col, rows, known, width)
    links = bayes._confirmed(likely, sets, percent)
    parts = lambda rows: stored(rows.join(components(links), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "near-parts")

    def open_tiles(part: DataFrame) -> DataFrame:
        """Buckets that hold several components, one of those with the same nodes, in tiles."""
        return bayes._tiled(bayes.spread_join(part, _classed(part), "bucket", bayes.hot_keys(part, "bucket"), F.xxhash64("node")), tile, _MARKED)

    def with_sets(needs: DataFrame) -> None:
        nonlocal sets, known
        new = stored(needs.join(known, "node", "left_anti"), "near-wanted")
        if not new.isEmpty():
            sets, known = sets.unionByName(bayes._sets(docs, text_col, rows, new, width)), known.unionByName(new)

    # A bucket of up to three nodes has met all its pairs.
    found = stored(_forests(open_tiles(parts(met.where("m > 3").select("bucket", "node", "m", "load"))), nodes, near), "near-found")
    more = stored(found.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "near-more")
    with_sets(wanted(more))
    ends = more.select(F.col("a").alias("node")).union(more.select("b"))
    links = links.unionByName(bayes._confirmed(more, _only(sets, ends), percent))
    # Parts only grow, so what is in a likely pair of two parts now was in one before.
    met = found.where("node is not null").select("bucket", "node")
    rest = stored(_suspects(open_tiles(parts(_sized(met, nodes, bayes.hot_keys(met, "bucket")))), nodes, near), "near-suspects")
    with_sets(nodes.join(rest.select("node").distinct(), "node", "left_semi").select("node", "key", "text_key"))
    links = links.unionByName(stored(_links_in_tiles(stored(_cut_anew(rest, nodes, tile), "near-dealt"), nodes, sets, percent, near), "near-links"))
    named = nodes.select("key", "node").join(components(links), "node", "left").select("key", F.coalesce("root", "node").alias("group"))
    filled = rows.where("key is not null").select("doc_id", "text_key", "key")
    out = bayes.spread_join(filled, named, "key", bayes.hot_keys(filled, "key"), F.monotonically_increasing_id())
    return out.select("doc_id", "text_key", "group").unionByName(rows.where("key is null").select("doc_id", "text_key", F.lit(-1).cast("long").alias("group")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """Docs with one row of each group: that of the smallest id (rows without an id last), all columns kept.

    Null and empty texts are one group; repeated rows are one. An empty table stays empty.
    Rows that miss a bitmap of those that go or are repeated stay where they are; only the others are shuffled with their texts.
    """
    names = ["__none", "__id", "__key"]
    named = lambda d, i, key: d.withColumns({"__none": i.isNull(), "__id": F.coalesce(i.cast("long"), F.lit(0)), "__key": key})
    grouped = stored(named(groups(docs, id_col, text_col, least, width), F.col("doc_id"), F.col("text_key")).select("group", *names), "near-groups")
    kept = stored(grouped.groupBy("group").agg(F.min(F.struct(*names)).alias("first")).select("first.*"), "near-kept")
    held = grouped.groupBy(*names).agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), names, "left")
    unsure = stored(held.where("n > 1 or stays is null").select(F.xxhash64(*names).alias("hash")), "near-unsure")
    longs, bits = bitmap(unsure)
    rows = named(docs, F.col(id_col).cast("long"), F.xxhash64(text_col))
    hit = in_bitmap(bits, longs, F.xxhash64(*names))
    single = rows.where(hit).join(kept.hint("shuffle_hash"), names, "left_semi").dropDuplicates(names)
    return rows.where(~hit).unionByName(single).drop(*names)
