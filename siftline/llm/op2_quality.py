"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed to ``N_BUCKETS`` buckets. Two multinomials over the buckets, one of
the trusted texts and one of all texts, are counted over the whole corpus; each task returns at most
``N_BUCKETS`` rows, so what is summed and sent to the scorers has a fixed size. A text's score is the
mean over its n-grams of log(p_target / p_raw), and it is kept when that mean is at least
``THRESHOLD`` and the plain rules passed.

Defined cases: a null or empty text has no words, all counts 0, llr 0.0, fails the base rules and is
not kept. Repeated rows are scored each on its own, alike. Null ids are scored like others and are
never trusted. With no trusted text the ratio is 0 for every bucket. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv

N_BUCKETS = 1 << 16
THRESHOLD = -0.2
#: Pseudo-count by which a bucket's target count is drawn to what the raw corpus makes expect.
PRIOR = 5.0
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

COUNT_SCHEMA = "bucket int, n long"
RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _grams(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, prefix: tv.Prefix, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and each pair of neighbours in the same text."""
    rows = tv.owner(bounds)
    words = prefix.hashes(starts, ends)
    same = rows[1:] == rows[:-1] if len(rows) else np.empty(0, bool)
    pairs = tv.combine(words[:-1], words[1:])[same] if len(words) else words
    return (np.concatenate([words, pairs]) % np.uint64(n_buckets)).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def bucket_counts(docs: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n): n-gram counts over every text, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tv.each_block(batch.column(0)):
                starts, ends, bounds = tv.word_spans(data, offsets)
                total += np.bincount(_grams(starts, ends, bounds, tv.Prefix(data), n_buckets)[0], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, COUNT_SCHEMA).groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) by bucket; buckets too rare to tell stay near 0."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    p_raw = raw / raw.sum()
    ratio = (target + PRIOR) / (p_raw * target.sum() + PRIOR)
    return np.log(ratio / (p_raw * ratio).sum())


def rules(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The plain rules' counts per text of a block, and the words they were taken from."""
    starts, ends, bounds = tv.word_spans(data, offsets)
    prefix, n, inside = tv.Prefix(data), len(offsets) - 1, tv.IS_WORD[data]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": tv.sums_by(offsets, inside & ((data & 0xC0) != 0x80)),
        "n_symbols": tv.sums_by(offsets, _IS_SYMBOL[data]),
    }
    # lines: from a text's start or the byte after a newline, up to a newline or the text's end
    cuts = np.flatnonzero(data == 0x0A)
    owners = np.searchsorted(offsets, cuts, side="right") - 1
    order = np.argsort(np.concatenate([np.arange(n) * 2, owners * 2 + 1]), kind="stable")
    begin = np.concatenate([offsets[:-1], cuts + 1])[order]
    row = np.concatenate([np.arange(n), owners])[order]
    end = np.append(begin[1:] - 1, offsets[-1]) if n else begin
    last = np.append(row[1:] != row[:-1], True) if n else np.empty(0, bool)
    end = np.where(last, offsets[row + 1], end) if n else end
    wordy = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, row = begin[wordy], end[wordy], row[wordy]
    keys = tv.combine(prefix.hashes(begin, end) + (end - begin).astype(np.uint64), row.astype(np.uint64))
    again = np.ones(len(keys), dtype=bool)
    again[np.unique(keys, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(row[again], minlength=n)
    # windows of words found twice or more in their text
    rows, words, width = tv.owner(bounds), prefix.hashes(starts, ends), REPEAT_WINDOW
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= width:
        windows = words[: len(words) - width + 1]
        for k in range(1, width):
            windows = tv.combine(windows, words[k : len(words) - width + 1 + k])
        at = np.flatnonzero(rows[width - 1 :] == rows[: len(rows) - width + 1])
        keys = tv.combine(windows[at], rows[at].astype(np.uint64))
        by = np.argsort(keys, kind="stable")
        equal = keys[by][1:] == keys[by][:-1]
        twice = at[by[np.append(equal, False) | np.insert(equal, 0, False)]] if len(by) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    out["n_repeat_words"] = tv.sums_by(bounds, np.cumsum(covered[:-1]) > 0)
    return out, (starts, ends, bounds, prefix)


def quality(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Each row of docs with its rule counts, llr and verdict. trusted: the texts of the target, in a column of the same name."""

    def table(counts: DataFrame) -> np.ndarray:
        out = np.zeros(n_buckets, dtype=np.int64)
        for bucket, n in counts.collect():  # at most n_buckets rows
            out[bucket] = n
        return out

    ratios = log_ratios(table(bucket_counts(trusted, text, n_buckets)), table(bucket_counts(docs, text, n_buckets)))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(1)):
                out, (starts, ends, bounds, prefix) = rules(data, offsets)
                buckets, rows = _grams(starts, ends, bounds, prefix, n_buckets)
                grams = np.bincount(rows, minlength=b - a)
                llr = np.bincount(rows, weights=by_bucket[buckets], minlength=b - a) / np.maximum(grams, 1)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
                columns = [pa.array(out[c].astype(np.int64)) for c in RULE_COLUMNS]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *columns, pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))], names=[key, *RULE_COLUMNS, "base_failed", "llr", "kept"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in RULE_COLUMNS) + ", base_failed boolean, llr double, kept boolean"
    return docs.select(key, text).mapInArrow(score, schema)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents labelled as of good quality. The labels grow with the corpus, so at any size both sides are shuffled by id."""
    good = labels.filter("quality = 1").select("doc_id").hint("merge")
    return docs.select("doc_id", "text").join(good, "doc_id", "left_semi").select("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, trusted_texts(docs, labels))
