"""Near copies by SimHash balls over several short fingerprints, verified by exact Jaccard similarity of shingles.

A radius of 3 in 64 bits (``op6_simhash``) finds copies with a few changed words. Texts that share 80 % of
their five-word shingles differ in 15 % of their SimHash bits; no ball around 64 bits that can be emitted
reaches them. So a text gets several fingerprints of fewer bits, from independent hashes, and a signature of
``SIGNATURE`` more bits. In each fingerprint, every text emits all variants within half the radius of 2, and
variants meet in a shuffle. ``scheme`` takes bits that grow with the logarithm of the number of texts, so
chance meetings stay proportional to it, and as many fingerprints as a pair at the similarity bound needs to
meet with probability ``RECALL`` (more similar pairs meet with more).

A group at a variant is never spelt out as pairs: its first text leads, those whose signatures are near to
the leader's are linked to it and leave, and the rest go on until all are linked or lead. This is done in
each task before the shuffle, so that a group of any size sends on its leaders only, and after it over a
sorted stream. What the first fingerprint has linked goes on under one name, so that the members of a large group are
not linked again by each of the others. Linked texts form clusters. Within a cluster all pairs are then compared exactly, by products of
0/1 matrices of shingles; only the components come out. So a text that meets its original at a variant is found
whatever else met there. Clusters over ``MEMBERS`` texts or ``WEIGHT`` shingles are first compared with their
most central text; those that it does not join are compared with all, block by block. A cluster of copies of
one text thus costs little more than its size, one of many texts that are half alike costs its pairs.

Defined cases: null and empty texts and those without words have no shingles and are alike; texts shorter
than a shingle have one, their whole sequence. Null ids are kept; the smallest id stands for a component, a
null id only if it has no other. Equal rows are one. Empty tables give empty results. Ties of a bit go by the
text's smallest shingle. Columns are carried whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import textvec as tv
from siftline.llm.graph import components
from siftline.llm.storage import discard, written

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, RECALL = 2, 0.99
MIN_BITS, SPARE_BITS, MAX_BITS = 22, 5, 48
#: Bits that tell a near text from one met by chance, and how many deviations beyond the mean at the bound pass.
SIGNATURE, SIGMAS = 128, 4
#: Variants to a shuffle; more fingerprints are dealt with one after the other, so that disk is bounded.
VARIANTS = 12_000_000
#: Variants that a task links before the shuffle at a time, and links told apart in memory after it.
HELD = 1 << 18
#: Rows that may be broadcast; more are shuffled.
BROADCAST_ROWS = 1 << 20
#: Texts and shingles of a cluster that are compared at once, and shingles that one product takes.
MEMBERS, WEIGHT, COLUMNS = 1024, 1 << 20, 4096
_LINK = np.int64(1 << 62)  # marks a row that is a link already


def scheme(n_texts: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """(bits, fingerprints, most differing bits of the signature) for a number of texts."""
    bits = min(max(MIN_BITS, math.ceil(math.log2(max(n_texts, 2))) + SPARE_BITS), MAX_BITS)
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # chance of a bit, at the bound
    meet = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(RADIUS + 1))
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
    return bits, count, math.floor(SIGNATURE * differ + SIGMAS * math.sqrt(SIGNATURE * differ * (1 - differ)))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, sorted, and n + 1 bounds."""
    low = tv.LOWER[data]
    starts, ends, bounds = tv.word_spans(low, offsets)
    words, rows = tv.Prefix(low).hashes(starts, ends), tv.owner(bounds)
    runs = words
    for k in range(1, width):
        runs = tv.combine(runs[:-1], words[k:]) if len(runs) else runs
    of = rows[: len(runs)]
    whole = of == rows[len(rows) - len(runs) :]
    runs, of = runs[whole], of[whole]
    n_words = np.diff(bounds)
    for row in np.flatnonzero((n_words > 0) & (n_words < width)):
        one = words[bounds[row] : bounds[row] + 1]
        for k in range(bounds[row] + 1, bounds[row + 1]):
            one = tv.combine(one, words[k : k + 1])
        runs, of = np.append(runs, one + np.uint64(n_words[row])), np.append(of, row)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    first = np.append(True, (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])) if len(runs) else np.empty(0, bool)
    runs, of = runs[first], of[first]
    return runs, np.searchsorted(of, np.arange(len(offsets)))


#: Eight lanes of a 64-bit word for the eight bits of a byte: sums of up to 255 of them do not overflow.
_LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.uint64(8) * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray, n_bits: int) -> np.ndarray:
    """(texts, n_bits): whether most of a text's shingles have a bit; a tie goes by its first shingle. No shingles: none."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    n_words = -(-n_bits // 64)
    out = np.zeros((len(n), 64 * n_words), dtype=bool)
    if not len(some):
        return out[:, :n_bits]
    parts = -(-n[some] // 255)
    first = np.concatenate([[0], np.cumsum(parts)])
    starts = np.repeat(bounds[some], parts) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    for k in range(n_words):
        salted = tv.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        lanes = np.add.reduceat(_LANES[salted.view(np.uint8).reshape(-1, 8)], starts, axis=0)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(starts), 64), first[:-1], axis=0, dtype=np.int64)
        lead = np.unpackbits(salted[bounds[some]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[some, 64 * k : 64 * k + 64] = 2 * ones + lead > n[some][:, None]
    return out[:, :n_bits]


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, bits: int, count: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's fingerprints, (texts, count), and signature, (texts, 2)."""
    major = majority(*shingles(data, offsets, width), SIGNATURE + bits * count)
    signature = np.packbits(major[:, :SIGNATURE], axis=1, bitorder="little").view(np.int64)
    parts = major[:, SIGNATURE:].reshape(len(major), count, bits).astype(np.int64)
    return parts @ (np.int64(1) << np.arange(bits, dtype=np.int64)), signature


def _nodes(docs: DataFrame, text: str, bits: int, count: int, width: int) -> DataFrame:
    """(node, prints, s1, s2): a row for each text, by its hash; equal texts give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(1)):
                prints, signature = fingerprints_of(data, offsets, bits, count, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, count, dtype=np.int32)), pa.array(prints.ravel()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists, *(pa.array(np.ascontiguousarray(signature[:, k])) for k in (0, 1))], names=["node", "prints", "s1", "s2"])

    return docs.select(F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text")).mapInArrow(run, "node long, prints array<long>, s1 long, s2 long").dropDuplicates(["node"])


def linked(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaders, links) of rows (variant, node, s1, s2) sorted by variant: rows that stay, and (node, node) rows.

    At each variant the first row leads; rows near to it are linked and leave; the rest do the same again.
    """
    leaders, links = [], [np.empty((0, 2), np.int64)]
    while len(rows):
        first = np.append(True, rows[1:, 0] != rows[:-1, 0])
        leaders.append(rows[first])
        of = np.cumsum(first) - 1
        rest = np.flatnonzero(~first)
        lead = leaders[-1][of[rest]]
        near = np.bitwise_count((rows[rest, 2:] ^ lead[:, 2:]).view(np.uint64)).sum(axis=1) <= most  # of signed numbers it would count the absolute value's
        pairs = np.stack([rows[rest[near], 1], lead[near, 1]], axis=1)
        links.append(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1))
        rows = rows[rest[~near]]
    return np.concatenate(leaders) if leaders else rows, np.concatenate(links)


def _different(pairs: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    return np.unique(rows, axis=0) if len(rows) else rows


def _met(nodes: DataFrame, tables: range, bits: int, most: int) -> DataFrame:
    """(lo, hi): links between texts that share a variant of one of the fingerprints in tables and are near by their signatures."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.append(0, np.int64(1) << np.arange(bits, dtype=np.int64))
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            leaders, links = linked(rows[np.argsort(rows[:, 0], kind="stable")], most)
            links = _different([links])
            spread = tv.mix(links[:, 0].view(np.uint64)).view(np.int64) & (_LINK - 1) | _LINK
            columns = [np.concatenate(x) for x in ((leaders[:, 0], spread), (leaders[:, 1], links[:, 0]), (leaders[:, 2], links[:, 1]), (leaders[:, 3], np.zeros(len(links), np.int64)))]
            return pa.record_batch([pa.array(c) for c in columns], names=["z", "node", "s1", "s2"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            prints = batch.column(1).flatten().to_numpy().reshape(n, -1)
            own = np.stack([batch.column(k).to_numpy() for k in (0, 2, 3)], axis=1)
            for t in tables:
                z = (prints[:, t : t + 1] ^ flips) | np.int64(t << bits)
                rows = np.empty((z.size, 4), np.int64)
                rows[:, 0], rows[:, 1:] = z.ravel(), np.repeat(own, len(flips), axis=0)
                held.append(rows)
                if sum(map(len, held)) > HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = np.empty((0, 4), np.int64)  # leaders of the variant that the rows before ended with

        def out() -> pa.RecordBatch:
            rows = _different(held)
            return pa.record_batch([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], names=["lo", "hi"])

        for batch in batches:
            rows = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            known = rows[:, 0] >= _LINK
            held.append(rows[known, 1:3])
            leaders, links = linked(rows[~known], most)
            held.append(links)
            # leaders of one round are apart by variant; those of the last variant go on
            last = leaders[leaders[:, 0] == leaders[:, 0].max()] if len(leaders) else last[:0]
            if sum(map(len, held)) > HELD:
                yield out()
                held = []
        yield out()

    variants = nodes.mapInArrow(emit, "z long, node long, s1 long, s2 long")
    return variants.repartition("z").sortWithinPartitions("z").mapInArrow(meet, "lo long, hi long")


def clusters(nodes: DataFrame, n: int, bits: int, count: int, most: int) -> DataFrame:
    """(node, cluster) of each text that met another one near to it by signature."""
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(spread)  # few small files would be few tasks, and each row becomes hundreds
    at_once = max(1, min(count, VARIANTS // (max(n, 1) * (bits + 1))))
    first = written(components(written(_met(nodes, range(1), bits, most).distinct())))
    named = nodes.join(first.hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("node"), "prints", "s1", "s2")
    named = written(named.repartition(spread))
    met = [written(_met(named, range(t, min(t + at_once, count)), bits, most).distinct()) for t in range(1, count, at_once)]
    discard(named)
    return components(reduce(DataFrame.unionAll, met, first.toDF("lo", "hi"))).select("node", F.col("root").alias("cluster"))


def within(rows: DataFrame, small: DataFrame, n_small: int, on: str, how: str = "inner") -> DataFrame:
    """A join with a table of n_small rows: broadcast if that is few, else shuffled."""
    return rows.join(F.broadcast(small), on, how) if n_small <= BROADCAST_ROWS else rows.hint("merge").join(small, on, how)


def _sets(docs: DataFrame, text: str, of: DataFrame, n: int, width: int) -> DataFrame:
    """(cluster, node, shingles) for each node of a cluster, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # this task's
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for a, b, data, offsets in tv.each_block(batch.column(2)):
                hashes, bounds = shingles(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a), lists], names=["cluster", "node", "shingles"])

    texts = within(docs.select(F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text")), of, n, "node")
    return texts.select("node", "cluster", "text").mapInArrow(run, "cluster long, node long, shingles array<long>").dropDuplicates(["node"])


class Sets:
    """Shingle sets side by side."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.flat = column.flatten().to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, row from 0, sizes) of the rows from a to before b."""
        sizes = self.sizes[a:b]
        return self.flat[self.bounds[a] : self.bounds[b]], np.repeat(np.arange(b - a), sizes), sizes


def alike(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """(left, right): which sets have at least this Jaccard similarity."""
    (x, xr, xn), (y, yr, yn) = left, right
    shared = np.intersect1d(x, y)
    same = np.zeros((len(xn), len(yn)), dtype=np.float32)  # whole numbers far below 2 ** 24 a product
    xs, ys = np.searchsorted(shared, x), np.searchsorted(shared, y)
    for low in range(0, len(shared), COLUMNS):
        n = min(COLUMNS, len(shared) - low)
        a, b = np.zeros((len(xn), n), np.float32), np.zeros((len(yn), n), np.float32)
        for grid, values, at, rows in ((a, x, xs, xr), (b, y, ys, yr)):
            mine = np.flatnonzero((at >= low) & (at < low + n))
            mine = mine[shared[at[mine]] == values[mine]]
            grid[rows[mine], at[mine] - low] = 1
        same += a @ b.T
    common = same.astype(np.float64)
    return common >= similarity * (xn[:, None] + yn[None, :] - common)  # no shingles on either side: alike


def _rooted(near: np.ndarray) -> np.ndarray:
    """The first member of each member's component, from a symmetric matrix."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            todo = np.array([start])
            while len(todo):
                root[todo] = start
                todo = np.flatnonzero(near[todo].any(axis=0) & (root < 0))
    return root


def _resolved(sets: DataFrame, n_tasks: int, similarity: float) -> DataFrame:
    """(node, root) within clusters that are compared at once, many to a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        cluster, node, held = table.column("cluster").to_numpy(), table.column("node").to_numpy(), Sets(table.column("shingles"))
        cuts = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster))
        root = np.empty(len(node), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = held.of(a, b)
            root[a:b] = node[a + _rooted(alike(rows, rows, similarity))]
        return pa.table([pa.array(node), pa.array(root)], names=["node", "root"])

    return sets.withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(n_tasks))).groupBy("task").applyInArrow(run, "node long, root long")


def _centres(sets: DataFrame) -> DataFrame:
    """(cluster, centre): the text whose signature is nearest to the majority of its cluster's signatures."""

    def signatures(batch: pa.RecordBatch) -> np.ndarray:
        held = Sets(batch.column(2))
        return majority(held.flat.view(np.uint64), held.bounds, SIGNATURE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            which, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            sums = np.zeros((len(which), SIGNATURE), np.int64)
            np.add.at(sums, of, 2 * signatures(batch).astype(np.int64) - 1)
            for c, s in zip(which.tolist(), sums, strict=True):
                found[c] = found.get(c, 0) + s
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([s.tolist() for s in found.values()], pa.list_(pa.int64()))], names=["cluster", "sums"])

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIGNATURE) > 0
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array((signatures(batch) != most).sum(axis=1))], names=["cluster", "node", "differ"])

    sums = sets.mapInArrow(count, "cluster long, sums array<long>").select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s"))
    most = written(sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums")))
    far = sets.join(most.hint("merge"), "cluster").select("cluster", "node", "shingles", "sums").mapInArrow(distance, "cluster long, node long, differ long")
    return written(far.groupBy("cluster").agg(F.min(F.struct("differ", "node")).alias("best")).select("cluster", F.col("best.node").alias("centre")))


def _edges(sets: DataFrame, similarity: float, members: int, weight: int) -> DataFrame:
    """(node, other): links that connect the components of large clusters."""
    centres = _centres(sets)
    middle = written(sets.join(centres.hint("merge"), "cluster").where("node = centre").select("cluster", "centre", F.col("shingles").alias("middle")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other, near = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for x, y in zip(own, other, strict=True):
                same = len(np.intersect1d(np.array(x, np.int64), np.array(y, np.int64), assume_unique=True))
                near.append(same >= similarity * (len(x) + len(y) - same))
            yield pa.record_batch([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(near, pa.bool_())], names=["cluster", "node", "shingles", "centre", "near"])

    schema = "cluster long, node long, shingles array<long>, centre long, near boolean"
    tried = written(sets.join(middle.hint("merge"), "cluster").select("cluster", "node", "shingles", "middle", "centre").mapInArrow(compare, schema))
    blocks = lambda n, w: F.ceil(F.greatest(n / members, w / weight, F.lit(1))).cast("int")
    far = F.when(~F.col("near"), 1).otherwise(0)
    sizes = tried.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("w"), F.sum(far).alias("m"), F.sum(far * F.size("shingles")).alias("v"))
    sizes = written(sizes.where("m > 0").select("cluster", blocks(F.col("n"), F.col("w")).alias("n_all"), blocks(F.col("m"), F.col("v")).alias("n_far")))
    rows = tried.join(sizes.hint("merge"), "cluster")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("not near").select("cluster", block("n_far").alias("i"), every("n_all").alias("j"), "node", "shingles")
    right = rows.select(F.col("cluster").alias("c"), every("n_far").alias("a"), block("n_all").alias("b"), F.col("node").alias("n"), F.col("shingles").alias("s"))

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = a.column("node").to_numpy(), b.column("n").to_numpy()
        near = alike(*(s.of(0, len(s.sizes)) for s in (Sets(a.column("shingles")), Sets(b.column("s")))), similarity)
        n = len(x)
        both = np.zeros((n + len(y),) * 2, bool)
        both[:n, n:], both[n:, :n] = near, near.T
        nodes, root = np.concatenate([x, y]), _rooted(both)
        return pa.table([pa.array(nodes), pa.array(nodes[root])], names=["node", "other"])

    found = left.groupBy("cluster", "i", "j").cogroup(right.groupBy("c", "a", "b")).applyInArrow(joined, "node long, other long")
    return found.where("node <> other").unionAll(tried.where("near and node <> centre").select("node", F.col("centre").alias("other")))


def similar(docs: DataFrame, *, text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, members: int = MEMBERS, weight: int = WEIGHT) -> DataFrame:
    """(node, root) of each text that is linked to another: its hash and the smallest hash of its component."""
    n = docs.count()
    bits, count, most = scheme(n, similarity)
    nodes = written(_nodes(docs, text, bits, count, width))
    of = written(clusters(nodes, n, bits, count, most))
    discard(nodes)
    sets = written(_sets(docs, text, of, of.count(), width))
    sizes = written(sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("w")))
    total = sizes.agg(F.sum("w"), F.sum("n")).first()
    n_tasks = max(1, (total[0] or 0) // weight, (total[1] or 0) // members)
    large = sizes.where((F.col("n") > members) | (F.col("w") > weight)).select("cluster")
    if large.isEmpty():
        return _resolved(sets, n_tasks, similarity)
    large = written(large)
    found = _resolved(sets.join(large.hint("merge"), "cluster", "left_anti"), n_tasks, similarity)
    return found.unionAll(components(written(_edges(written(sets.join(large.hint("merge"), "cluster")), similarity, members, weight))))


def _tag(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, that of the smallest id; columns as they came.

    Rows are told apart by a hash of id and text, which equal rows share. Only such hashes are grouped; texts
    are shuffled only if too many rows go to broadcast their hashes.
    """
    found = written(similar(docs.select(key, text), text=text, similarity=similarity, width=width))
    ids = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("node"), _tag(key, text).alias("tag")).groupBy("id", "node", "tag").agg(F.count("*").alias("n"))
    of = written(ids.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("root", "node")))
    first = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"))
    chosen = written(first.select(F.col("first.tag").alias("tag")))
    rest = written(of.join(chosen.hint("merge"), "tag", "left_anti").select("tag").distinct())
    twice = written(of.where("n > 1").select("tag").distinct().join(chosen.hint("merge"), "tag", "left_semi"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _tag(key, text).alias("tag"))
    gone = rest.unionAll(twice)
    out = within(rows, gone, gone.count(), "tag", "left_anti").select("_row")
    if not twice.isEmpty():
        out = out.unionAll(within(rows, twice, twice.count(), "tag", "left_semi").groupBy("tag").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
