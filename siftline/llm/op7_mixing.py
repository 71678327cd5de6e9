"""Mixing sources to target weights, with DataFrame functions only.

Targets: the sources, by code point with null last, take the weights in turn and share a multiple of all
words; a target stops at ``max_epochs`` times its source's size and the excess is reshared by weight
(the level at which no source is above is found from prefix sums over the sources sorted by cap / weight).

Sampling is Efraimidis and Spirakis's: each document draws the exponential key -ln(u) / quality, with u a
hash of its id and text, and a source's documents are taken in the order of their keys. Complete epochs
come first; of the rest of the target, documents are taken while their middle lies within it, so a source
misses its target by at most half of its largest document.

The quality is a column of the caller's, from ``LEAST_QUALITY`` to 1, or by default that floor and, above it, the
share of letters of any script among a text's characters other than blanks.

A hot source is no single group: keys are cut into slices, prefix sums run within a slice, and the slices' offsets
come from their totals. Slices are equally probable for documents of the least quality, so that none of a source
holds more than 1 / ``LEAST_QUALITY`` times its mean, whatever the qualities. The targets reach the rows with the same join on
(source, slice). No text is shuffled.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source of its own;
null ids are carried; rows with equal id and text have equal keys, each counts on its own, and which of
them stands before the other changes nothing but their place; an empty table gives an empty result. Ties
of the key are broken by hash and id. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
SLICE_ROWS, MIN_SLICES = 20_000, 256
LEAST_QUALITY = 0.25


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """LEAST_QUALITY to 1 by the share of letters among the characters other than blanks."""
    letters, others = (F.coalesce(F.length(F.regexp_replace(text, p, "")), F.lit(0)) for p in (r"\P{L}+", r"[\p{L}\s]+"))
    return LEAST_QUALITY + (1 - LEAST_QUALITY) * letters / F.greatest(letters + others, F.lit(1))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, no_source, source_size, target) from (source, no_source, source_size): a row for each source."""
    by_name, all_rows = Window.orderBy("no_source", "source"), Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select("*", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    s = s.select("*", (F.col("source_size") * float(max_epochs)).alias("cap"), (F.sum("source_size").over(all_rows) * float(share)).alias("budget"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    taken = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.select("*", ((F.col("budget") - taken) / rest).alias("level"))
    s = s.select("*", (F.col("cap") <= F.col("level") * F.col("weight")).alias("capped"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return s.select("source", "no_source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def slice_of(draw: Column, n_slices: int) -> Column:
    return F.least(F.floor((1 - F.exp(-LEAST_QUALITY * draw)) * n_slices), F.lit(n_slices - 1)).cast("int")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, quality: Column | None = None) -> DataFrame:
    """(key, tag, size, source_size, target, copies, taken) for each row; tag is a hash of id and text."""
    row = docs.select(F.col(key).alias("k"), F.coalesce(source, F.lit("")).alias("source"), F.col(source).isNull().alias("no_source"), n_words(text).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("tag"), F.least(F.greatest(F.coalesce(quality_weight(text) if quality is None else quality, F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY)), F.lit(1.0)).alias("quality"))
    unit = (F.shiftrightunsigned(F.xxhash64("tag", F.lit("mix")), 11).cast("double") + 0.5) / float(1 << 53)
    rows = written(row.select("k", "source", "no_source", "size", "tag", (-F.log(unit) / F.col("quality")).alias("draw")))
    n_slices = max(MIN_SLICES, rows.count() // SLICE_ROWS)
    rows = rows.withColumn("slice", slice_of(F.col("draw"), n_slices))
    group = ["source", "no_source"]
    slices = rows.groupBy(*group, "slice").agg(F.sum("size").alias("slice_size"))
    aims = targets(rows.groupBy(*group).agg(F.sum("size").alias("source_size")), weights=weights, share=share, max_epochs=max_epochs)
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*group, "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("offset")).join(aims, group)
    up_to = Window.partitionBy(*group, "slice").orderBy("draw", "tag", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("up_to", F.sum("size").over(up_to)).join(slices, [*group, "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    middle = F.col("offset") + F.col("up_to") - F.col("size") / 2
    chosen = (F.col("size") > 0) & (middle <= F.col("target") - epochs * F.col("source_size")) & (epochs < max_epochs)
    copies = F.when(F.col("size") > 0, epochs + chosen.cast("long")).otherwise(F.lit(0).cast("long"))
    return placed.select(F.col("k").alias(key), "tag", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they came. Rows are told apart by id and text hash, which equal rows share."""
    slim = docs.select(key, text, source)
    copies = mix(slim, key=key, text=text, source=source).where("copies > 0").groupBy(F.col(key).alias("_id"), F.col("tag").alias("_tag")).agg(F.max("copies").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_tag_of"))
    taken = rows.hint("merge").join(copies, (F.col("_tag") == F.col("_tag_of")) & F.col("_key").eqNullSafe(F.col("_id")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
