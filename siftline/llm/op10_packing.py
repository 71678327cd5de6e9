"""Best-fit packing of documents into training sequences, under conflicts.

Documents longer than a bin give full pieces, each a bin of its own, and a rest. In each shard, rests and
shorter documents are placed by falling size. Open bins are kept in order of residual room; a bin carries
a bitmap of its duplicate clusters and ``max_per_source`` bitmaps of its sources (seen once, twice, ...).
The search starts at the smallest residual that fits and goes on to the next larger one until a bin has
neither the item's cluster nor its source too often: the tightest compatible bin. Without one, a new bin
is opened. Nothing is dropped.

A duplicate cluster is what the caller says; the query takes the SimHash components of ``op6_simhash``, near copies
included, and ``pack`` by default equal texts without regard to case.

A shard holds about ``shard_rows`` documents (or ``SHARD_BYTES`` of text, if texts are asked for) chosen by
hash, so work and memory are bounded by it, copies and hot sources spread evenly, and a lost task packs the
same shard in the same way again.

Defined cases: documents without words get one row with a null bin; a null source is one source; repeated
rows are items each on its own (and copies of each other); ties of size go by hash, then id. Null ids are
packed. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.op6_simhash import near_duplicates
from siftline.llm.op7_mixing import WORD, n_words
from siftline.llm.storage import written

_WORD = re.compile(WORD)
CAPACITY, MAX_PER_SOURCE, SHARD_ROWS = 2048, 2, 8192
SHARD_BYTES = 16 << 20


class Bin:
    __slots__ = ("number", "used", "clusters", "sources")

    def __init__(self, number: int, per_source: int) -> None:
        self.number, self.used, self.clusters, self.sources = number, 0, 0, [0] * per_source

    def takes(self, source: int, cluster: int) -> bool:
        return not (self.clusters & cluster or self.sources[-1] & source)

    def add(self, size: int, source: int, cluster: int) -> None:
        self.used += size
        self.clusters |= cluster
        for k, plane in enumerate(self.sources):
            self.sources[k] = plane | source
            if not plane & source:
                break


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), in the order given; sizes are 1 to capacity, the rest small integers."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins: list[Bin] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and not bins[order[at][1]].takes(s, c):
            at += 1
        if at < len(order):
            chosen = bins[order.pop(at)[1]]
        else:
            bins.append(chosen := Bin(len(bins), per_source))
        out.append((chosen.number, chosen.used))
        chosen.add(size, s, c)
        if chosen.used < capacity:
            insort(order, (capacity - chosen.used, chosen.number))
    return out


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS, texts: bool = False) -> DataFrame:
    """(key, piece, start_word, n_words, bin_id, bin_offset) of each document's pieces, and with texts their text.

    cluster: a document's duplicate cluster, by default equal texts. A piece's text goes from its first word to
    the next piece's, so that a document's pieces side by side are its text.
    """
    cluster = F.xxhash64(F.lower(text)) if cluster is None else cluster
    item = docs.select(F.col(key).alias("k"), n_words(text).alias("size"), F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.xxhash64(F.col(key), F.col(text)).alias("tag"), *([F.col(text).alias("text")] if texts else []))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] if texts else 0
    return packed(item, docs.count(), n_bytes, key=key, capacity=capacity, max_per_source=max_per_source, shard_rows=shard_rows)


def packed(item: DataFrame, n_rows: int, n_bytes: int, *, key: str, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The same from items (k, size, source, cluster, tag), with texts if they have a text; tag tells rows apart."""
    kind, texts = item.schema["k"].dataType.simpleString(), "text" in item.columns
    n_shards = max(1, -(-n_rows // shard_rows), -(-n_bytes // SHARD_BYTES) if texts else 1)
    item = item.withColumn("shard", F.pmod(F.xxhash64("tag"), F.lit(n_shards)).cast("int"))
    names = [key, "piece", "start_word", "n_words", "bin_id", "bin_offset"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("tag", "ascending"), ("k", "ascending")])
        first = table.column("shard")[0].as_py() << 32
        sources = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
        clusters = table.column("cluster").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
        rows: list[list[int | None]] = [[] for _ in names]  # the first: row of the table
        rests: list[tuple[int, int, int, int, int, int]] = []
        closed = 0

        def put(*values: int | None) -> None:
            for column, value in zip(rows, values, strict=True):
                column.append(value)

        for at, size in enumerate(table.column("size").to_pylist()):
            whole, rest = divmod(size, capacity)
            for piece in range(whole):
                put(at, piece, piece * capacity, capacity, first + closed, 0)
                closed += 1
            if rest:
                rests.append((-rest, at, whole, sources[at], clusters[at], rest))
            elif not size:
                put(at, 0, 0, 0, None, None)
        rests.sort()
        for (_, at, piece, _, _, rest), (number, offset) in zip(rests, best_fit([(x[5], x[3], x[4]) for x in rests], capacity, max_per_source), strict=True):
            put(at, piece, piece * capacity, rest, first + closed + number, offset)
        keys = table.column("k").take(pa.array(rows[0], pa.int64()))
        columns = [keys, pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]]
        if texts:
            columns.append(pa.array(_cut(table.column("text"), rows[0], rows[2], rows[3], capacity), pa.string()))
        return pa.table(columns, names=[*names, "text"] if texts else names)

    return item.groupBy("shard").applyInArrow(run, f"`{key}` {kind}, piece int, start_word long, n_words long, bin_id long, bin_offset long" + ", text string" * texts)


def _cut(texts: pa.ChunkedArray, rows: list[int], first: list[int], n_words: list[int], least: int) -> list[str | None]:
    """The text of each piece (row, first word, number of words); first pieces below ``least`` words are whole documents."""
    out: list[str | None] = []
    starts: dict[int, list[int]] = {}
    for row, at, n in zip(rows, first, n_words, strict=True):
        text = texts[row].as_py()
        if text is not None and (at or n >= least):
            if row not in starts:
                starts[row] = [m.start() for m in _WORD.finditer(text)]
            cuts = starts[row]
            text = text[cuts[at] if at else 0 : cuts[at + n] if at + n < len(cuts) else len(text)]
        out.append(text)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64("doc_id", "text").alias("tag"))
    found = written(near_duplicates(rows, carry=("source", "size", "tag")))
    item = found.select(F.col("doc_id").alias("k"), "size", "source", F.col("component").alias("cluster"), "tag")
    return packed(item, found.count(), 0, key="doc_id")
