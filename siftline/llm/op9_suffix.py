"""Suffix-array deduplication: bytes covered by a string of ``width`` bytes that starts anywhere else.

The suffix array is sparse. With width 400, each window of 400 bytes has 201 substrings of 200 bytes; the
one with the least hash (the leftmost of equals) anchors it. Equal windows have equal anchors at equal
places, so sorting the suffixes at anchors, about one byte in a hundred, finds every repeated window.

1. Anchors are hashed and counted over all documents; those whose hash is unique repeat nowhere. Anchors of
   equal hash and context (all bytes that matter: 200 left, 400 right) are one suffix with a count, so a
   group of copies is sorted once. Texts dense in anchors, such as one word over and over, repeat within
   themselves: windows equal to an earlier one of the same text are covered on the spot and not sent on.
2. The suffixes, with the bytes left of them, are sorted in each task and exchanged as front-coded runs,
   dealt by hash of the anchor.
3. A loser tree merges the runs (``losertree``): common prefixes come from the front coding and are never
   compared again. Suffixes with the same anchor form a group. Taking the neighbours with the longest
   common prefixes first and smaller sets into larger ones, each suffix is matched with the neighbours by
   its left bytes; of all partners, these reach furthest left at each length to the right. A match of 400
   bytes or more covers all its bytes. Different suffixes are matched by their bytes; only equal contexts
   (and equal windows of one text) are told by 64-bit hashes.
4. How far a suffix is covered goes back to all places that have it, and so to their documents, by joins.

A group of more than ``HOT`` different suffixes is split without loss: the offsets 0 to 200 of the anchor in
its window are cut into ranges, and for the range lo to hi the group's key grows from 200 bytes to the
400 - (hi - lo) that all such windows share. Ranges shrink from 201 offsets to 21, 3 and 1, where the key
is the window itself and any two of a group match whole.

The unit of a string is a byte, or a word: then a text is the row of its words' 64-bit hashes, positions are
multiples of 8 bytes, and what goes is the words of strings of ``width`` / 8 words, each with the blanks behind
it. ``passages`` counts such strings of ``PASSAGE_WORDS`` words beside the bytes, as columns of the query.

Defined cases: null texts are empty and remove nothing; texts below the width match nowhere; rows with
equal id and text are documents each on its own and so repeat each other; null ids are carried; empty
tables give empty results. Texts of any length are taken whole, in overlapping pieces of bounded size.
Other columns are carried by ``deduplicated`` whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import textvec as tv
from siftline.llm.losertree import Run, common_suffix, front_code, merge
from siftline.llm.storage import discard, released, written

WIDTH = 400
#: Words of the strings that the pipeline's stage removes: passages of over 50 words.
PASSAGE_WORDS = 51
WORD = 8
HOT = 30_000
#: Suffixes to a merge task, and bytes of suffixes held while a run is made.
GROUP_ROWS, RUN_BYTES = 20_000, 24 << 20
PIECE = 8 << 20
_INDEX = np.uint64((1 << 24) - 1)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    whole = -(-len(v) // w) * w
    padded = np.full(whole, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(v)] = v
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _key(width: int, unit: int) -> int:
    """Bytes of an anchor: about half the width."""
    return max(unit, width // 2 // unit * unit)


def _least(hashes: np.ndarray, places: int) -> np.ndarray:
    """The place of the anchor among so many hashes from each one on."""
    return (_sliding_min((hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64), places) & _INDEX).astype(np.int64)


def _windows_inside(offsets: np.ndarray, width: int, n: int, first: int, last: int) -> np.ndarray:
    """Which of the n windows lie within one text and start from first to before last."""
    begin, end = np.maximum(offsets[:-1], first), np.minimum(offsets[1:] - width + 1, last)
    some = end > begin
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, begin[some], 1)
    np.add.at(steps, np.minimum(end[some], n), -1)
    return np.cumsum(steps[:-1]) > 0


def _runs_of(at: np.ndarray) -> np.ndarray:
    """Sorted positions without repeats."""
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def contexts(prefix: tv.Prefix, at: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, k: np.ndarray | int) -> np.ndarray:
    """A hash of all that matters of a suffix: width - k bytes left of it and width from it on, as far as its text goes."""
    a, b = np.maximum(begin, at - (width - k)), np.minimum(end, at + width)
    return tv.combine(prefix.hashes(a, b), (at - a).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, first: int = 0, last: int = 1 << 62, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, contexts, covered) of the windows within a text of the block that start from first to before last.

    covered: (start, stop) rows of what repeats within one text that is dense in anchors.
    """
    prefix, k = tv.Prefix(data), _key(width, unit)
    hashes = prefix.windows(k)[::unit]
    none = np.empty((0, 2), dtype=np.int64)
    least = _least(hashes, (width - k) // unit + 1)
    if not len(least):
        return np.empty(0, np.int64), hashes[:0], hashes[:0], none
    inside = _windows_inside(offsets // unit, width // unit, len(least), first // unit, last // unit)
    at = _runs_of(least[inside])
    count, room = np.diff(np.searchsorted(at * unit, offsets)), np.diff(offsets) // unit
    dense = np.flatnonzero(count * (width // unit) > 10 * room + 20 * (width // unit))
    covered = [none]
    if len(dense):
        whole = prefix.windows(width)[::unit]
        for row in dense:
            begin = offsets[row] // unit
            mine = np.flatnonzero(inside[begin : offsets[row + 1] // unit]) + begin
            _, earliest, of, n = np.unique(whole[mine], return_index=True, return_inverse=True, return_counts=True)
            twice = mine[n[of] > 1]
            if len(twice):
                cuts = np.flatnonzero(np.diff(twice) > 1)
                covered.append(np.stack([twice[np.append(0, cuts + 1)] * unit, twice[np.append(cuts, len(twice) - 1)] * unit + width], axis=1))
            inside[mine] = False
            inside[mine[earliest]] = True
        at = np.unique(least[inside])
    hashes, at = hashes[at], at * unit
    row = np.searchsorted(offsets, at, side="right") - 1
    return at, hashes, contexts(prefix, at, offsets[row], offsets[row + 1], width, k), np.concatenate(covered)


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int]]:
    """(row, start in its text, bytes, offsets, first window, last window) of a block; a text longer than PIECE comes in overlapping pieces."""
    if len(data) <= PIECE:
        yield 0, 0, data, offsets, 0, 1 << 62
        return
    for row in range(len(offsets) - 1):
        text = data[offsets[row] : offsets[row + 1]]
        for at in range(0, max(1, len(text) - width + 1), PIECE):
            begin = max(0, at - width)
            part = text[begin : at + PIECE + 2 * width]
            yield row, begin, part, np.array([0, len(part)]), at - begin, at - begin + PIECE


def units(column: pa.Array, unit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for each block; with unit WORD the bytes are those of the words' hashes."""
    for a, b, data, offsets in tv.each_block(column):
        if unit > 1:
            starts, ends, bounds = tv.word_spans(data, offsets)
            data, offsets = tv.Prefix(data).hashes(starts, ends).astype("<u8").view(np.uint8), bounds * WORD
        yield a, b, data, offsets


def _tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("tag"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def _all_anchors(tagged: DataFrame, width: int, unit: int) -> DataFrame:
    """(tag, pos, k, h, ctx, stop): anchors, with null stop, and spans from pos to stop that are covered already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in units(batch.column(1), unit):
                for row, shift, part, bounds, first, last in _pieces(data, offsets, width):
                    at, hashes, context, covered = anchors(part, bounds, width, first, last, unit)
                    both = np.concatenate([at, covered[:, 0]])
                    of = np.searchsorted(bounds, both, side="right") - 1
                    pos = both - bounds[of] + shift
                    zero = np.zeros(len(covered), dtype=np.int64)
                    stop = np.concatenate([np.zeros(len(at), np.int64), pos[len(at) :] + covered[:, 1] - covered[:, 0]])
                    columns = [pa.array(tags[a + row + of]), pa.array(pos.astype(np.int32)), pa.array(np.full(len(both), _key(width, unit), np.int32)), pa.array(np.concatenate([hashes.view(np.int64), zero])), pa.array(np.concatenate([context.view(np.int64), zero])), pa.array(stop.astype(np.int32), mask=stop == 0)]
                    yield pa.record_batch(columns, names=["tag", "pos", "k", "h", "ctx", "stop"])

    return tagged.mapInArrow(run, "tag long, pos int, k int, h long, ctx long, stop int")


def _finer(cands: DataFrame, tagged: DataFrame, width: int, span: int, unit: int) -> DataFrame:
    """(tag, pos, k, h, ctx): each hot suffix (pos, k) cut into keys that leave ``span`` offsets each."""
    listed = cands.groupBy("tag").agg(F.collect_set(F.struct("pos", "k")).alias("at"))
    joined = tagged.hint("merge").join(listed, "tag").select("tag", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((a + i, data[offsets[i] : offsets[i + 1]]) for a, b, data, offsets in units(batch.column(1), unit) for i in range(b - a))
            for row, data in rows:
                prefix, out = tv.Prefix(data), set()
                for at in batch.column(2)[row].as_py():
                    for lo in range(0, width - at["k"] + 1, span * unit):
                        k = width - min((span - 1) * unit, width - at["k"] - lo)
                        start = at["pos"] - lo
                        if start >= 0 and start + k <= len(data):
                            out.add((start, k))
                if out:
                    starts, sizes = np.array(sorted(out), dtype=np.int64).T
                    zero = np.zeros(len(starts), dtype=np.int64)
                    columns = [zero + batch.column(0)[row].as_py(), starts.astype(np.int32), sizes.astype(np.int32), prefix.hashes(starts, starts + sizes).view(np.int64), contexts(prefix, starts, zero, zero + len(data), width, sizes).view(np.int64)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["tag", "pos", "k", "h", "ctx"])

    return joined.mapInArrow(run, "tag long, pos int, k int, h long, ctx long")


def candidates(tagged: DataFrame, width: int, hot: int, unit: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, suffixes, covered).

    places (tag, pos, k, h, ctx): where the first k bytes may begin another suffix. suffixes (k, h, ctx, m,
    tag, pos): the different ones, how often each occurs and one place of it; at most ``hot`` to (k, h), or
    k = width. covered (tag, pos, stop): spans that need no more search.
    """
    spark = tagged.sparkSession
    found = written(_all_anchors(tagged, width, unit))
    covered = written(found.where("stop is not null").select("tag", "pos", "stop"))
    level, above = found.where("stop is null").drop("stop"), found
    spans = [s for s in (21, 3) if s * unit <= width // 2] + [1]
    places, suffixes = [], []
    while True:
        twice = written(level.groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").select("k", "h"))
        kept = written(level.join(twice.hint("merge"), ["k", "h"]))
        discard(above, twice)
        released(spark)
        different = written(kept.groupBy("k", "h", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("tag", "pos")).alias("one")).select("k", "h", "ctx", "m", "one.tag", "one.pos"))
        large = written(different.groupBy("k", "h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", "h")) if spans else None
        released(spark)
        if large is None or large.isEmpty():
            places.append(kept)
            suffixes.append(different)
            break
        places.append(kept.join(large.hint("merge"), ["k", "h"], "left_anti"))
        suffixes.append(different.join(large.hint("merge"), ["k", "h"], "left_anti"))
        level = above = written(_finer(kept.join(large.hint("merge"), ["k", "h"], "left_semi"), tagged, width, spans.pop(0), unit))
    return reduce(DataFrame.unionByName, places), reduce(DataFrame.unionByName, suffixes), covered


RUN_SCHEMA = "k int, bucket int, shared array<int>, tails array<binary>, lefts array<binary>, hs array<long>, contexts array<long>, counts array<long>"


def _runs(suffixes: DataFrame, tagged: DataFrame, width: int, n_buckets: int, unit: int) -> DataFrame:
    """Sorted front-coded runs of the suffixes, one row for each task (or more), k and bucket."""
    bucket = F.pmod(F.xxhash64("h", "k"), F.lit(n_buckets)).cast("int").alias("bucket")
    listed = suffixes.groupBy("tag").agg(F.collect_list(F.struct("pos", "k", bucket, "h", "ctx", "m")).alias("at"))
    joined = tagged.hint("merge").join(listed, "tag").select("text", "at")
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    types = [pa.list_(t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())]

    def flush(held: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
        for (k, b), found in held.items():
            found.sort()
            shared, tails = front_code([x[0] for x in found])
            columns = [shared, tails, *([x[i] for x in found] for i in range(1, 5))]
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([b], pa.int32()), *(pa.array([c], t) for c, t in zip(columns, types, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in batches:
            rows = ((a + i, data[offsets[i] : offsets[i + 1]].tobytes()) for a, b, data, offsets in units(batch.column(0), unit) for i in range(b - a))
            for row, text in rows:
                at = batch.column(1)[row].values
                for p, k, b, h, ctx, m in zip(*(at.field(i).to_pylist() for i in range(6)), strict=True):
                    held.setdefault((k, b), []).append((text[p : p + width], text[max(0, p - width + k) : p], h, ctx, m))
                    size += 2 * width
                if size > RUN_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return joined.mapInArrow(run, RUN_SCHEMA)


def reach(strings: list[bytes], shared: list[int], lefts: list[bytes], counts: list[int], width: int, unit: int = 1) -> list[tuple[int, int]]:
    """How far left and right each suffix of a group is covered by matches of ``width`` bytes or more; (0, 0) if by none.

    strings are sorted and distinct together with their lefts, shared[i] is the common prefix of i - 1 and i.
    """
    n = len(strings)
    left, right = [0] * n, [0] * n
    for i in range(n):
        if counts[i] > 1 and len(lefts[i]) + len(strings[i]) >= width:
            left[i], right[i] = len(lefts[i]), len(strings[i])
    if n == 1:
        return [(left[0], right[0])]
    by_left = sorted(range(n), key=lambda i: lefts[i][::-1])
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    home = list(range(n))
    sets = [[r] for r in rank]

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        a, b, r = find(i - 1), find(i), shared[i] // unit * unit
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for s in sets[b]:
            at, x = bisect_left(large, s), by_left[s]
            for near in large[max(0, at - 1) : at + 1]:
                y = by_left[near]
                common = common_suffix(lefts[x], lefts[y]) // unit * unit
                if common + r >= width:
                    for z in (x, y):
                        if common > left[z]:
                            left[z] = common
                        if r > right[z]:
                            right[z] = r
        if len(sets[b]) * 8 > len(large):
            large.extend(sets[b])
            large.sort()
        else:
            for s in sets[b]:
                insort(large, s)
        sets[b], home[b] = [], a
    return list(zip(left, right, strict=True))


def _reached(runs: DataFrame, width: int, unit: int) -> DataFrame:
    """(k, h, ctx, l, r): how far each suffix that is covered at all is covered to its left and right."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        shared, tails, lefts, hs, ctxs, counts = (table.column(c).to_pylist() for c in ("shared", "tails", "lefts", "hs", "contexts", "counts"))
        out: tuple[list[int], ...] = ([], [], [], [])
        group: list[tuple[bytes, int, int, int]] = []  # string, prefix shared with the one before, run, place in it

        def close() -> None:
            found: list[tuple[bytes, int, bytes, int, int]] = []
            of: list[int] = []
            seen: set[tuple[bytes, bytes]] = set()
            low = width + 1  # the least prefix shared since the last one kept
            for string, common, which, at in group:
                low, left = min(low, common), lefts[which][at]
                if (string, left) not in seen:  # a row of equal id and text brings its suffixes again
                    seen.add((string, left))
                    found.append((string, low, left, hs[which][at], ctxs[which][at]))
                    of.append(counts[which][at])
                    low = width + 1
            if len(found) == 1 and of[0] == 1:
                return
            reached = reach([x[0] for x in found], [x[1] for x in found], [x[2] for x in found], of, width, unit)
            for (_, _, _, h, ctx), (l, r) in zip(found, reached, strict=True):
                if r:
                    for column, value in zip(out, (h, ctx, l, r), strict=True):
                        column.append(value)

        for which, at, common, string in merge([Run(s, t) for s, t in zip(shared, tails, strict=True)]):
            if common < k and group:
                close()
                group = []
            group.append((string, common, which, at))
        if group:
            close()
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())]
        return pa.table([pa.array([k] * len(out[0]), pa.int32()), *columns], names=["k", "h", "ctx", "l", "r"])

    return runs.groupBy("k", "bucket").applyInArrow(run, "k int, h long, ctx long, l int, r int")


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT, unit: int = 1) -> DataFrame:
    """(tag, spans): for each row's tag, a hash of id and text, the ranges that repeat elsewhere; they may overlap.

    width and ranges are in bytes, with unit ``WORD`` in words of 8 bytes.
    """
    tagged = _tagged(docs, key, text)
    places, suffixes, covered = candidates(tagged, width, hot, unit)
    n_buckets = max(8, suffixes.count() // GROUP_ROWS)
    reached = written(_reached(_runs(suffixes, tagged, width, n_buckets, unit), width, unit))
    released(docs.sparkSession)
    spans = places.join(reached.hint("merge"), ["k", "h", "ctx"]).select("tag", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"))
    spans = written(spans.unionAll(covered).distinct())
    discard(places, suffixes, reached, covered)
    return spans.groupBy("tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    kept, done, removed, n = [], 0, 0, 0
    stop = -1
    for a, b in sorted(spans):
        if a > stop:
            n += 1
            kept.append(raw[done:a])
            done = stop = a
        if b > stop:
            removed += b - stop
            done = stop = b
    kept.append(raw[done:])
    return b"".join(kept), removed, n


def word_cuts(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words (8 to a word) as bytes of the text: from a first word to the word after the last one."""
    if not spans:
        return []
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = tv.word_spans(data, np.array([0, len(data)]))
    edges = np.append(starts, len(data))
    return [(int(edges[a // WORD]), int(edges[b // WORD])) for a, b in spans]


def _cut_rows(docs: DataFrame, extra: str, make, spans: list[DataFrame], *, key: str, text: str) -> DataFrame:
    """docs with one more struct column, _made, of what make gives of each row's bytes and its spans in each of the tables."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(key), F.col(text)).alias("tag"), F.col(text).cast("binary").alias("_text"))
    found = [s.withColumnRenamed("spans", f"_{k}") for k, s in enumerate(spans)]
    found = found[0] if len(found) == 1 else found[0].hint("merge").join(found[1], "tag", "full")
    joined = slim.hint("merge").join(found, "tag", "left").drop("tag")
    schema = T.StructType([T.StructField("_row", joined.schema["_row"].dataType), T.StructField("_made", T._parse_datatype_string(extra))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tv.buffers(batch.column(1))
            for a, b in tv.blocks(offsets, 4 * tv.BLOCK):
                made = []
                for at in range(a, b):
                    own = [[(s["start"], s["stop"]) for s in batch.column(c)[at].as_py() or ()] for c in range(2, batch.num_columns)]
                    made.append(make(batch.column(1)[at].as_py(), *own))
                names = list(made[0])
                columns = [pa.array([m[c] for m in made]) for c in names]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.StructArray.from_arrays(columns, names)], names=["_row", "_made"])

    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT, passages: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    passages: also n_passage_words and n_passages, the words in strings of so many words that start anywhere
    else, and their maximal runs; they take no part in the others.
    """

    def make(raw: bytes | None, spans: list, words: list | None = None) -> dict:
        kept, removed, n = cut(raw or b"", spans)
        own = {"n_bytes": len(raw or b""), "n_removed": removed, "n_spans": n, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        if words is None:
            return own
        runs, covered, stop = 0, 0, -1
        for a, b in sorted(words):
            runs += a > stop
            covered += max(0, b - max(a, stop))
            stop = max(stop, b)
        return own | {"n_passage_words": covered // WORD, "n_passages": runs}

    slim = docs.select(key, text)
    fields = "n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string" + ",n_passage_words:long,n_passages:long" * bool(passages)
    spans = [repeated_spans(slim, key=key, text=text, width=width, hot=hot)]
    if passages:
        spans.append(repeated_spans(slim, key=key, text=text, width=passages * WORD, hot=hot, unit=WORD))
    return _cut_rows(slim, f"struct<{fields}>", make, spans, key=key, text=text).select(F.col(f"_row.`{key}`").alias(key), "_made.*")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT, words: int | None = None) -> DataFrame:
    """docs with the repeated bytes cut out of the text (and with them what is left of a character cut in two); null stays null.

    words: strings of so many words are cut instead of ``width`` bytes.
    """

    def make(raw: bytes | None, spans: list) -> dict:
        spans = word_cuts(raw or b"", spans) if words else spans
        return {"text": None if raw is None else cut(raw, spans)[0].decode("utf-8", "ignore") if spans else raw.decode("utf-8", "replace")}

    spans = repeated_spans(docs.select(key, text), key=key, text=text, width=words * WORD if words else width, hot=hot, unit=WORD if words else 1)
    out = _cut_rows(docs, "struct<text:string>", make, [spans], key=key, text=text)
    return out.select(*[F.col("_made.text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def shortened(docs: DataFrame, *, size: str = "n_chars", words: int = PASSAGE_WORDS) -> DataFrame:
    """docs of the pipeline without strings of so many words that repeat, and with the column of their length counted anew."""
    out = deduplicated(docs, words=words)
    return out.withColumn(size, F.length("text").cast(docs.schema[size].dataType)) if size in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=PASSAGE_WORDS)
