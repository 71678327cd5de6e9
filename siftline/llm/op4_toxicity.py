"""Toxicity: a logistic classifier on hashed words and word prefixes, regularised by counterfactuals.

Sentences of the training texts that hold an identity term are written again with another term of its set, and
every term is set beside the others and a neutral word; the squared difference of the two scores is penalised.
What a term adds to a score is thereby driven to 0, and neutral mentions are not taken for toxicity. Sets of
terms are given (``IDENTITY_TERMS``) and learned: ``stand_ins`` are words that share the beginning of telling words
without being more frequent in toxic texts themselves, so a classifier blames them by their company. Only features
significantly more frequent in toxic texts are learned from, and their weights are 0 or more, so a long or odd text
gathers no score from words that tell nothing. The weights are fitted by accelerated proximal gradient steps; the
model is ``N_FEATURES`` + 1 floats.

What is learned from is a bounded sample, by parameters: at most ``MAX_TRAIN`` labelled texts, those with the least
hash of id (one text for an id, that of the least hash); of them at most ``MAX_TERMS`` learned terms, the most
frequent, and ``MAX_SENTENCES`` sentences, those with the least hash. A sentence is the ``WINDOW`` words on either
side of its term, wherever it stands in the text. Features are taken and counted on the executors; the driver gets
two counts for each of ``N_FEATURES`` and then each sampled text's telling feature numbers. Every text is scored whole.

Defined cases: null or empty texts have no feature and the score of the intercept. Labels that are null are
not learned from; of several labels of an id the largest counts. Rows with a null id are held in, cannot be
labelled, and are scored. Repeated rows are scored alike. Without labelled rows of both classes all scores
are 0. Ties in the sample are broken by text hash. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv
from siftline.llm.storage import written

N_FEATURES = 1 << 18
#: Word prefixes taken beside the word, in bytes.
PREFIXES = (4, 5, 6)
MAX_TRAIN = 16_384
#: Learned terms, texts that each must be in, sentences that are swapped, swaps of each, and words on either side of its term.
MAX_TERMS, MIN_TEXTS, MAX_SENTENCES, SWAPS, WINDOW = 64, 8, 4096, 3, 10
#: The word that terms are set beside.
NEUTRAL = "people"
THRESHOLD = 0.3
ROUNDS, L1, L2, COUNTERFACTUAL = 2000, 1e-5, 1e-5, 1.0
#: Least chi-squared statistic of a feature that is learned from: by chance, few of N_FEATURES reach it.
CHI_SQUARED = 30.0
#: Neutral terms for groups of people, each line a set whose members are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
)

_EDGE = np.zeros(256, dtype=bool)  # bytes that are trimmed from words: ASCII other than letters and digits
_EDGE[:128] = True
_EDGE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = False


def features(data: np.ndarray, offsets: np.ndarray, n_features: int = N_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) pairs of a block, each once, by row: words of letters, digits and non-ASCII, and their prefixes."""
    low = tv.LOWER[data]
    spaced = np.where(_EDGE[low], np.uint8(0x20), low)
    starts, ends, bounds = tv.word_spans(spaced, offsets)
    rows, prefix = tv.owner(bounds), tv.Prefix(spaced)
    parts = [prefix.hashes(starts, ends)]
    of = [rows]
    for n in PREFIXES:
        long = ends - starts >= n
        parts.append(tv.mix(prefix.hashes(starts[long], starts[long] + n) + np.uint64(n)))
        of.append(rows[long])
    both = np.concatenate(of).astype(np.int64) * n_features + (np.concatenate(parts) % np.uint64(n_features)).astype(np.int64)
    both = np.unique(both)
    return both % n_features, both // n_features


def text_features(text: str, n_features: int = N_FEATURES) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]), n_features)[0]


def mentions(data: np.ndarray, offsets: np.ndarray, telling: np.ndarray, names: np.ndarray, n_features: int = N_FEATURES) -> list[tuple[int, str, str]]:
    """(row, word, the words around it), each word once a text: words in names, and those with a telling prefix that tell nothing as a whole.

    telling and names are sorted: feature numbers and hashes of words.
    """
    low = tv.LOWER[data]
    spaced = np.where(_EDGE[low], np.uint8(0x20), low)
    starts, ends, bounds = tv.word_spans(spaced, offsets)
    prefix, rows = tv.Prefix(spaced), tv.owner(bounds)
    whole = prefix.hashes(starts, ends)
    by_prefix = np.zeros(len(whole), bool)
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        by_prefix[long] |= np.isin(tv.mix(prefix.hashes(starts[long], starts[long] + n) + np.uint64(n)) % np.uint64(n_features), telling)
    at = np.flatnonzero(np.isin(whole, names) | by_prefix & ~np.isin(whole % np.uint64(n_features), telling))
    _, first = np.unique(np.stack([rows[at].astype(np.uint64), whole[at]]), axis=1, return_index=True)
    out, raw = [], spaced.tobytes()
    for k in at[np.sort(first)].tolist():
        row = int(rows[k])
        a, b = max(k - WINDOW, bounds[row]), min(k + WINDOW, bounds[row + 1] - 1)
        out.append((row, raw[starts[k] : ends[k]].decode("utf-8", "replace"), raw[starts[a] : ends[b]].decode("utf-8", "replace")))
    return out


def counterfactuals(found: list[tuple[str, str]], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, swaps: int = SWAPS) -> list[tuple[str, str]]:
    """Pairs of a sentence and its like with its term swapped, from (term, sentence); then each term beside the others of its set and a neutral word.

    A term is swapped for some of its set, from a place that the sentence's own hash gives.
    """
    pairs = []
    where = {t: group for group in terms for t in group}
    for term, sentence in found:
        words = sentence.split()
        others = [t for t in where.get(term, ()) if t != term]
        if term in words and others:
            first = zlib.crc32(sentence.encode())
            for k in range(min(swaps, len(others))):
                pairs.append((" ".join(words), " ".join(others[(first + k) % len(others)] if w == term else w for w in words)))
    for group in terms:
        pairs += [(a, b) for a in group for b in group if a < b]
        pairs += [(a, NEUTRAL) for a in group]
    return pairs


class Bags:
    """Rows of distinct feature numbers: all of them side by side, and n + 1 bounds."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray) -> None:
        self.flat, self.bounds, self.n = flat, bounds, len(bounds) - 1

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Bags:
        flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        return cls(flat, np.cumsum([0, *map(len, rows)]))

    def counts(self, n_features: int, chosen: np.ndarray | None = None) -> np.ndarray:
        flat = self.flat if chosen is None else self.flat[np.repeat(chosen, np.diff(self.bounds))]
        return np.bincount(flat, minlength=n_features).astype(float)


class Sparse:
    """Bags with only the features of a lookup, which gives their new numbers, or -1."""

    def __init__(self, bags: Bags, lookup: np.ndarray) -> None:
        kept = np.flatnonzero(lookup[bags.flat] >= 0)
        self.at, self.n = lookup[bags.flat[kept]], bags.n
        self.of = np.searchsorted(bags.bounds, kept, side="right") - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.of], minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(n: int, n1: int, both: np.ndarray, ones: np.ndarray, least: float = CHI_SQUARED) -> np.ndarray:
    """Features found more often in texts of label 1, by the chi-squared statistic of the two-by-two table: of n texts and of the n1 of label 1, those that have each."""
    cross = ones * (n - n1 - (both - ones)) - (both - ones) * (n1 - ones)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * cross * cross / (both * (n - both) * n1 * (n - n1))
    return np.flatnonzero((cross > 0) & (chi >= least))


def fit(rows: Bags, labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], *, n_features: int = N_FEATURES, rounds: int = ROUNDS, l1: float = L1, l2: float = L2, counterfactual: float = COUNTERFACTUAL, used: np.ndarray | None = None) -> np.ndarray:
    """Weights, the intercept last, by accelerated proximal gradient steps on balanced log loss + penalties; weights are 0 or more.

    used: the telling features, if rows hold no others.
    """
    weights = np.zeros(n_features + 1, dtype=np.float64)
    positive = labels > 0
    if not rows.n or positive.all() or not positive.any():
        weights[-1] = -40.0
        return weights
    used = telling(rows.n, int(positive.sum()), rows.counts(n_features), rows.counts(n_features, positive)) if used is None else used
    lookup = np.full(n_features, -1, dtype=np.int32)
    lookup[used] = np.arange(len(used))
    x, a, b = (Sparse(bags, lookup) for bags in (rows, Bags.of([p[0] for p in pairs]), Bags.of([p[1] for p in pairs])))
    share = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    # step by feature, from a bound on the curvature: rare ones move as far as common ones
    size = np.bincount(x.of, minlength=x.n) + 1.0
    curve = x.back(share * size, len(used)) * 0.25 + l2
    width = np.bincount(a.of, minlength=a.n) + np.bincount(b.of, minlength=b.n) + 1.0
    if a.n:
        curve += counterfactual * 2 / a.n * (a.back(width, len(used)) + b.back(width, len(used))) * 0.125
    step, step0 = 1 / curve, 1 / (0.25 * (share * size).sum())
    w = v = np.zeros(len(used))
    c = d = t = 1.0
    for _ in range(rounds):
        gap = share * (sigmoid(x.dot(v) + d) - positive)
        g, g0 = x.back(gap, len(used)) + l2 * v, gap.sum()
        if a.n:
            p, q = sigmoid(a.dot(v) + d), sigmoid(b.dot(v) + d)
            pull = counterfactual * 2 / a.n * (p - q)
            g += a.back(pull * p * (1 - p), len(used)) - b.back(pull * q * (1 - q), len(used))
            g0 += (pull * (p * (1 - p) - q * (1 - q))).sum()
        to = np.maximum(v - step * (g + l1), 0)
        to0 = d - step0 * g0
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, d = to + (t - 1) / nxt * (to - w), to0 + (t - 1) / nxt * (to0 - c)
        w, c, t = to, to0, nxt
    # without any evidence a text is no likelier toxic than the training texts are on the whole
    weights[used], weights[-1] = w, min(c, np.log(positive.sum() / (~positive).sum()))
    return weights


def score_block(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    at, row = features(data, offsets, len(weights) - 1)
    return sigmoid(np.bincount(row, weights=weights[at], minlength=len(offsets) - 1) + weights[-1])


def sampled(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, max_train: int) -> DataFrame:
    """(text, label, place): at most max_train rows, written."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    # the sample by hash of id: ids only until it is known, then one text of each
    chosen = known.orderBy(F.xxhash64(key), key).limit(max_train)
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).withColumn("_order", F.xxhash64(key, "_text"))
    one = rows.groupBy(key).agg(F.min_by(F.struct("_text", "_label"), "_order").alias("_one"), F.min("_order").alias("place"))
    return written(one.select(F.col("_one._text").alias("text"), F.col("_one._label").alias("label"), "place"))


def stand_ins(sample: DataFrame, used: np.ndarray, n: int, n1: int, terms: tuple[tuple[str, ...], ...]) -> tuple[tuple[tuple[str, ...], ...], list[tuple[str, str]]]:
    """The sets of terms with the learned one, and (term, sentence) of the sample's sentences that hold a term."""
    given = {t for group in terms for t in group}
    names = np.sort(np.array([tv.Prefix(raw).hashes(np.array([0]), np.array([len(raw)]))[0] for raw in (np.frombuffer(t.encode(), np.uint8) for t in given)], np.uint64))
    telling = np.sort(used).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, _, data, offsets in tv.each_block(batch.column(0)):
                found = mentions(data, offsets, telling, names)
                yield pa.record_batch([pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([labels[a + f[0]] for f in found], pa.int32())], names=["word", "sentence", "label"])

    spoken = written(sample.select("text", "label").mapInArrow(run, "word string, sentence string, label int"))
    counts = spoken.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    neutral = counts.where((F.col("n") >= MIN_TEXTS) & (F.col("n1") * n <= F.col("n") * n1) & ~F.col("word").isin(list(given)))
    learned = tuple(sorted(r.word for r in neutral.orderBy(F.desc("n"), "word").limit(MAX_TERMS).collect()))
    terms = (*terms, learned) if learned else terms
    said = spoken.where(F.col("word").isin([t for group in terms for t in group])).select("word", "sentence").distinct()
    said = said.orderBy(F.xxhash64("sentence", "word"), "sentence", "word").limit(MAX_SENTENCES).collect()
    return terms, sorted((r.word, r.sentence) for r in said)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights learned from the rows of labels with a text. The caller leaves held-out rows out of labels."""
    sample = sampled(docs, labels, key=key, text=text, label=label, max_train=max_train)
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, N_FEATURES), np.int64)
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for a, b, data, offsets in tv.each_block(batch.column(0)):
                at, row = features(data, offsets)
                both[0] += np.bincount(at, minlength=N_FEATURES)
                both[1] += np.bincount(at[positive[a:b][row]], minlength=N_FEATURES)
        found = np.flatnonzero(both[0])
        yield pa.record_batch([pa.array(found), pa.array(both[0][found]), pa.array(both[1][found])], names=["feature", "n", "n1"])

    counts = sample.select("text", "label").mapInArrow(count, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).toArrow()
    both, ones = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for target, name in ((both, "n"), (ones, "n1")):
        target[counts.column("feature").to_numpy()] = counts.column(name).to_numpy()
    used = telling(n, n1, both, ones) if 0 < n1 < n else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(0)):
                at, row = features(data, offsets)
                told = np.isin(at, used)
                at, row = at[told], row[told]
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.record_batch([lists, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["at", "label", "place"])

    got = sample.mapInArrow(run, "at array<int>, label int, place long").toArrow()  # at most max_train rows
    # one order whatever the partitions, so that sums, and the model, are the same on every run
    got = got.take(pa.array(np.argsort(got.column("place").to_numpy(), kind="stable")))
    sizes = pc.list_value_length(got.column("at")).to_numpy()
    flat = np.concatenate([c.flatten().to_numpy() for c in got.column("at").chunks]) if len(got) else np.empty(0, np.int32)
    rows = Bags(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    terms, found = stand_ins(sample, used, n, n1, terms)
    pairs = [(text_features(a), text_features(b)) for a, b in counterfactuals(found, terms)]
    return fit(rows, got.column("label").to_numpy(), pairs, counterfactual=counterfactual, used=used)


def score(docs: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """(key, *carry, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # N_FEATURES + 1 values
    names = [key, *carry, "score", "predicted"]
    slim = docs.select(key, *carry, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(batch.num_columns - 1)):
                s = score_block(data, offsets, w)
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (key, *carry)) + ", score double, predicted int"
    return slim.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs, labels), carry=("held_out",))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted as toxic by a model of all rows that the query may learn from; columns as they came."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    weights = train(docs, labels)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(score_block(data, offsets, w) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
