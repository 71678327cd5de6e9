"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints
with at most 3 differing bits meet in a variant z: one of them reaches z by at most one flip and the
other by at most two (three differing bits have two in the same half of the word, so the pair of flips
may be taken within a half; and as they differ in parity, only odd fingerprints need pairs of flips).
All fingerprints emit their variants, the shuffle on variants brings partners together, and each
variant links its members to the smallest member one flip away: that distance is 3 or less by
construction, and a group of n gives n links, never n squared. A link is verified by its bit count.

Before that, fingerprints without any partner are left out exactly: three differing bits leave one half
of the word with at most one, so a fingerprint whose halves meet no other's within one flip has no link.

Fingerprints are deduplicated first, so exact copies cost one row; a component's id is the smallest id in
it. Defined cases: null, empty or blank texts have fingerprint zero, which links like any other; texts
with fewer words than a shingle use the whole sequence. Rows with a null id are fingerprinted and linked
but never name a component; a component of null ids only has a null id. Repeated rows stay repeated.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv
from siftline.llm.graph import components
from siftline.llm.storage import written

SHINGLE, SEED, RADIUS = 3, 42, 3


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of a block, as signed integers."""
    starts, ends, bounds = tv.word_spans(data, offsets)
    n_words, n = np.diff(bounds), len(offsets) - 1
    out = np.zeros(n, dtype=np.int64)
    if not len(starts):
        return out
    # words side by side with one space after each: any run of them is a slice
    inside = tv.IS_WORD[data]
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 0x20, dtype=np.uint8)
    joined[np.arange(lengths.sum()) + np.repeat(np.arange(len(starts)), lengths)] = tv.LOWER[data[inside]]
    raw = joined.tobytes()
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    rows = np.repeat(np.arange(n), count)
    shift = np.concatenate([[0], np.cumsum(count)])
    first = bounds[rows] + np.arange(len(rows)) - shift[rows]
    last = np.minimum(first + width, bounds[rows + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(begin[first].tolist(), (begin[last] - 1).tolist(), strict=True)), np.uint64, len(rows))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(count)
    ones = np.add.reduceat(bits, shift[some], axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > count[some][:, None], axis=1)
    out[some] = np.ascontiguousarray(major).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """(key, *carry, fp) for each row."""
    slim = docs.select(key, *carry, text)
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (key, *carry)) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for a, b, data, offsets in tv.each_block(batch.column(last)):
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(last)), pa.array(fingerprints_of(data, offsets, width))], names=[key, *carry, "fp"])

    return slim.mapInArrow(run, schema)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _flips(value: Column, first: int, last: int) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: value.bitwiseXOR(_bit(i)))


def with_partners(fps: DataFrame) -> DataFrame:
    """Of the distinct fingerprints fp, those that may have one within 3 bits: a half equal to another's or one flip from it."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned(F.col("fp"), 32).bitwiseOR(F.lit(1 << 32).cast("long"))
    halves = fps.select(low.alias("low"), high.alias("high"))
    exact = halves.select(F.explode(F.array("low", "high")).alias("half")).groupBy("half").agg(F.count("*").alias("own"))
    near = halves.select(F.explode(F.concat(_flips(F.col("low"), 0, 31), _flips(F.col("high"), 0, 31))).alias("half"))
    met = exact.where("own > 1").select("half").unionAll(exact.join(near.hint("merge"), "half", "left_semi").select("half")).distinct()
    by_half = fps.select("fp", F.explode(F.array(low, high)).alias("half")).join(met.hint("merge"), "half", "left_semi")
    return by_half.select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(fp, centre): edges that connect all distinct fingerprints within 3 bits of each other, directly or by others, and no more.

    Sizes after explode are not known to the planner, so the joins are told to shuffle rather than broadcast.
    """
    fp = F.col("fp")
    one = fps.select("fp", F.explode(F.concat(F.array(fp), _flips(fp, 0, 63))).alias("z"))
    pairs = F.array(*[F.lit((1 << i) ^ (1 << j)).cast("long") for i in range(32) for j in range(i)])
    both = lambda p: F.array(fp.bitwiseXOR(p), fp.bitwiseXOR(F.call_function("shiftleft", p, F.lit(32))))
    two = fps.where(F.bit_count(fp) % 2 == 1).select("fp", F.explode(pairs).alias("p")).select("fp", F.explode(both(F.col("p"))).alias("z"))
    centre = one.groupBy("z").agg(F.min("fp").alias("centre"))
    met = one.unionAll(two).join(centre.hint("merge"), "z").where("fp <> centre")
    return met.where(F.bit_count(fp.bitwiseXOR(F.col("centre"))) <= RADIUS).select("fp", "centre").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """(key, *carry, fingerprint, component, component_id) for each row; component is a fingerprint, the same for all of one."""
    found = written(fingerprints(docs, key=key, text=text, carry=carry, width=width))
    fps = written(found.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = components(links(written(with_partners(fps))))
    of = fps.join(rooted, fps.fp == rooted.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    of = written(of)
    ids = written(of.groupBy("component").agg(F.min("least").alias("component_id")))  # a plain shuffle next to the join, which can be split
    of = of.select("fp", "component").join(ids.hint("merge"), "component")
    return found.join(of.hint("merge"), "fp").select(key, *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (of rows with this id, one); columns as they came.

    Only ids and fingerprints are grouped. A component's row is named by id and text hash, which equal rows
    share; where these repeat, one of the equal rows is taken.
    """
    found = near_duplicates(docs.select(key, text, F.xxhash64(key, text).alias("_tag")), key=key, text=text, carry=("_tag",))
    # the smallest (id, tag) of each component; a null id comes last
    first = found.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "_tag")).alias("first"))
    chosen = first.select(F.col("first.id").alias("_id"), F.col("first._tag").alias("_tag"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(key, text).alias("_tag_of"))
    same = tagged.hint("merge").join(chosen, tagged._key.eqNullSafe(chosen._id) & (tagged._tag_of == chosen._tag), "left_semi")
    one = same.groupBy("_key", "_tag_of").agg(F.first("_row").alias("_row"))
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
