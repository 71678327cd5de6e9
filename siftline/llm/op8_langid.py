"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the strings of 1 to 4 bytes of a text's lower-cased letters (all other ASCII counts as
a space), hashed to ``BUCKETS`` embeddings. A text's vector is the mean of its subwords' embeddings and a
linear softmax turns it into language scores. Both are trained together by stochastic gradient descent in
numpy on a bounded sample: at most ``MAX_TRAIN`` labelled texts, those with the least hash of id. A fifth
of the sample calibrates: a temperature for the probabilities, then the least probability with which a
prediction is accepted (``REJECT`` of the right ones fall below it). As all is linear, embeddings and
softmax are multiplied out into one table of ``BUCKETS`` rows and a column for each language, which is
what scorers get.

Defined cases: null texts and texts without a letter get ``und``, score 0 and are rejected; so do all texts
if no labelled row was learned from. Null languages are not learned from; of several labels of an id all
count. Null ids are scored and never learned from. Repeated rows are scored alike. Equal scores go to the
first language by code point. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv

BUCKETS, DIM, SIZES = 1 << 15, 16, (1, 2, 3, 4)
MAX_TRAIN, EPOCHS, LEAST_STEPS, BATCH, RATE = 3072, 6, 400, 32, 20.0
REJECT = 0.01
SEED = 7

_FOLD = tv.LOWER.copy()
_FOLD[:128] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, of logits already divided by the temperature
    bias: np.ndarray
    least: float


def subwords(folded: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, bucket of the subword at each start) of folded bytes."""
    prefix = tv.Prefix(folded)
    for n in SIZES:
        yield n, ((prefix.windows(n) + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def bags(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, count) of each text's subwords."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        found = [at for _, at in subwords(_FOLD[data[a:b]])]
        counts = np.bincount(np.concatenate(found), minlength=1) if found else np.zeros(1, np.int64)
        at = np.flatnonzero(counts)
        out.append((at.astype(np.int32), counts[at].astype(np.float32)))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = tv.sums_by(offsets, _LETTER[tv.LOWER[data]]) > 0
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """A model of (bucket, count) bags and their languages."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(SEED)
    y = np.searchsorted(languages, labels)
    embed = np.zeros((BUCKETS, DIM))  # the softmax starts at random, so embeddings move from the first step
    out = rng.normal(0, 1, (DIM, len(languages)))
    bias = np.zeros(len(languages))
    shares = [c / c.sum() for _, c in rows]
    # a fifth to calibrate, if there is enough
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    learn = order[len(rows) // 5 :] if len(rows) >= 50 else order

    def vectors(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([rows[i][0] for i in batch])
        of = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
        share = np.concatenate([shares[i] for i in batch])
        starts = np.searchsorted(of, np.arange(len(batch)))
        return np.add.reduceat(embed[at] * share[:, None], starts, axis=0), at, of, share

    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(learn) // BATCH)))
    steps, done = epochs * -(-len(learn) // BATCH), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for first in range(0, len(learn), BATCH):
            batch = learn[first : first + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            mean, at, of, share = vectors(batch)
            g = softmax(mean @ out + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            g /= len(batch)
            back = g @ out.T
            out -= 0.05 * rate * (mean.T @ g)
            bias -= 0.01 * rate * g.sum(axis=0)
            np.subtract.at(embed, at, rate * share[:, None] * back[of])
    logits = np.concatenate([vectors(held[i : i + 256])[0] @ out + bias for i in range(0, len(held), 256)])
    heat = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / h)[np.arange(len(held)), y[held]], 1e-12)).mean() for h in heat]
    best = heat[int(np.argmin(loss))]
    p = softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return Model(languages, embed @ out / best, bias / best, float(np.quantile(right, REJECT)) if len(right) else 0.0)


def block_logits(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Each text's logits, from the mean over its subwords."""
    folded, n = _FOLD[data], len(offsets) - 1
    total = np.zeros((n, len(model.languages)))
    count = np.zeros(n)
    columns = [np.ascontiguousarray(model.table[:, k]) for k in range(len(model.languages))]
    for size, at in subwords(folded):
        stop = offsets[1:] - size + 1
        some = np.flatnonzero(stop > offsets[:-1])
        if not len(some):
            continue
        # from each text's first subword to its last; what lies between texts is summed apart and left out
        edges = np.stack([offsets[:-1][some], stop[some]], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= len(at) else edges
        for k, column in enumerate(columns):
            total[some, k] += np.add.reduceat(column[at], edges)[::2]
        count[some] += stop[some] - offsets[:-1][some]
    return total / np.maximum(count, 1)[:, None] + model.bias


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learns from the rows given; the caller leaves held-out rows out."""
    known = docs.where(f"`{lang}` is not null and `{key}` is not null and `{text}` is not null")
    least = known.select(F.xxhash64(key).alias("_order"), key).distinct().orderBy("_order", key).limit(max_train)
    sample = known.select(key, text, lang).join(F.broadcast(least.select(key)), key).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(0)):
                found = bags(data, offsets)
                columns = [pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], pa.list_(pa.float32()))]
                yield pa.record_batch([*columns, batch.column(1).slice(a, b - a)], names=["at", "n", "lang"])

    got = sample.mapInArrow(run, "at array<int>, n array<float>, lang string").toArrow()  # at most max_train ids' rows
    rows = [(a.values.to_numpy(), n.values.to_numpy(), lang.as_py()) for a, n, lang in zip(got.column("at"), got.column("n"), got.column("lang"), strict=True)]
    rows = sorted((r for r in rows if len(r[0])), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    return fit([(a, n) for a, n, _ in rows], [lang for _, _, lang in rows])


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, lang_pred, score, rejected) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    names = [key, *carry, "lang_pred", "score", "rejected"]
    slim = docs.select(key, *carry, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(batch.num_columns - 1)):
                ok = has_letter(data, offsets) & bool(m.languages)
                best, score = np.full(b - a, len(m.languages)), np.zeros(b - a)
                if m.languages:
                    p = softmax(block_logits(data, offsets, m))
                    best = np.where(ok, p.argmax(axis=1), best)
                    score = np.where(ok, p.max(axis=1), 0.0)
                columns = [pa.array(languages[best].tolist(), pa.string()), pa.array(score), pa.array(~ok | (score < m.least))]
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), *columns], names=names)

    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (key, *carry)) + ", lang_pred string, score double, rejected boolean"
    return slim.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs.where(~held_out())), carry=("held_out",))
