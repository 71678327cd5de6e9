"""Language-model scoring by a probabilistic suffix tree whose states are a distributed table.

A state is a context of up to ``DEPTH`` words that occurs ``MIN_COUNT`` times or more, whatever the size of the
corpus. Level by level, a context is kept if its next-symbol distribution diverges from that of its longest
kept suffix: the sum over its occurrences of the logarithm of the two probabilities' ratio, each occurrence
left out of its own count, is ``GAIN`` nats or more. Distributions are smoothed with the suffix's:
(n(cs) + m * p_suffix(s)) / (n(c) + m), with m = n(c) ** ``SPREAD``, so they sum to 1. Below them lies the base:
smoothed word counts, where all words not seen in training are one symbol. A token is scored by the longest kept
suffix of the words before it.

But for a number or two to each ``SPLIT`` occurrences or ``PART_KEYS`` pairs, nothing that grows with the corpus is
collected or sent to all. Texts are cut into chunks where they are read:
the words' 64-bit hashes, each once, and the tokens as places among them. At each level a chunk asks for each
of its different (context, word) pairs once: pairs with their counts in the chunk go, packed into arrays, to
parts dealt by the context's hash. A part holds all of its contexts' pairs, so it sums them, tests each
context and answers every chunk in the order in which it asked. Only pairs whose context is frequent enough
are asked for. Arrays travel as bytes: a word within a context as 48 bits of its hash, a probability, which only the
test looks at, as a half float. A context of ``SPLIT`` occurrences or more is dealt to several parts by its next words. With
its pairs goes its whole count, so that each part gets its share of the test's sum; the driver adds the shares, two numbers to
each such context and part, and names those that pass. The sum is one of integers: how contexts are dealt cannot change it.

Defined cases: a null or empty text has one token, the end. Null ids are learned from and are not held out.
Repeated rows are counted and scored each on its own. Without training rows the counts are 0, and the
base is the uniform 0.5 / (0.5 * (V + 1)). Ties cannot matter. Other columns are ignored. A text of any length
is in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import textvec as tv
from siftline.llm.storage import discard, released, written

DEPTH, MIN_COUNT = 2, 2
GAIN, SPREAD = 2.0, 0.85
#: Bytes of text to a chunk, (context, word) pairs to a part, and occurrences from which a context is split.
CHUNK_BYTES, PART_KEYS, SPLIT = 8 << 20, 1 << 20, 1 << 20
#: Steps to a nat in the test's sum.
STEPS = 1 << 20
#: Rounds in which the pairs of contexts of two words or more are asked for, so that their shuffle takes less disk.
ROUNDS = 2
#: The end's place among the hashes.
END = np.uint64(0x9D5C_3E1F_A7B2_4601)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block's texts, each text closed by the end, and n + 1 bounds."""
    low = tv.LOWER[data]
    starts, ends, bounds = tv.word_spans(low, offsets)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[bounds[1:] + np.arange(n)] = True
    out[~is_end] = tv.Prefix(low).hashes(starts, ends)
    out[is_end] = END
    return out, bounds + np.arange(n + 1)


def _listed(values: pa.Array) -> pa.ListArray:
    """A column of one list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _binary(values: np.ndarray, cuts: np.ndarray | None = None) -> pa.Array:
    """A column of arrays as compressed bytes, one of all values unless cut."""
    cuts = np.array([0, len(values)]) if cuts is None else cuts
    pack, values = zstandard.ZstdCompressor(level=1).compress, np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return pa.array([pack(values[a:b].data) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _numbers(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """The values of all arrays of a column of bytes, side by side."""
    unpack = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(unpack(x) for x in column.to_pylist()), kind)


def _sparse(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Such a column with null for arrays of zeros only."""
    some = [bool(values[a:b].any()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pc.if_else(pa.array(some, pa.bool_()), _binary(values, cuts), pa.scalar(None, pa.binary())) if any(some) else pa.nulls(len(some), pa.binary())


def _of_sparse(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(b"".join(bytes(8 * n) if x is None else unpack(x) for x, n in zip(column.to_pylist(), sizes.tolist(), strict=True)), np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, sorted; the place of one of each; the different key of each)."""
    order = np.argsort(keys)
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else order
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[order[first]], order[first], of


def _planes(values: np.ndarray) -> np.ndarray:
    """32-bit values by byte: small ones leave planes of zeros, which compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _of_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


#: What is sent of a pair: context, 48 bits of the word, count, probability below.
PAIR = np.dtype([("word", "V6"), ("n", "<i4"), ("below", "<f2")])


def chunked(docs: DataFrame, learn: Column, *, key: str, text: str, carry: tuple[str, ...], chunk_bytes: int) -> DataFrame:
    """(chunk, words, tokens, bounds, learn, n_words, n_tokens, c0, c1, ...): a row for about chunk_bytes of text, with a list of each document's key and carried columns."""
    slim = docs.select(F.col(text).alias("_text"), learn.alias("_learn"), F.col(key), *carry)
    kinds = [slim.schema[c].dataType.simpleString() for c in (key, *carry)]
    names = ["chunk", "words", "tokens", "bounds", "learn", "n_words", "n_tokens", *(f"c{k}" for k in range(len(kinds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, serial, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            words, places, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words have small places
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, places = words[order], rank[places]
            bounds = np.cumsum([0, *np.concatenate([h[1] for h in held])])
            columns = [pa.concat_arrays([h[2][i] for h in held]) for i in range(len(held[0][2]))]
            learned = columns[0].to_numpy(zero_copy_only=False).astype(np.uint8)
            return pa.record_batch([pa.array([first + serial]), _binary(words), _binary(_planes(places)), _binary(bounds.astype(np.int64)), _binary(learned), pa.array([len(words)]), pa.array([len(places)]), *map(_listed, columns[1:])], names=names)

        for batch in batches:
            for a, b, data, offsets in tv.each_block(batch.column(0)):
                hashes, bounds = tokens(data, offsets)
                held.append((hashes, np.diff(bounds), [c.slice(a, b - a) for c in batch.columns[1:]]))
                size += len(data) + b - a
                if size >= chunk_bytes:
                    yield out()
                    held, serial, size = [], serial + 1, 0
        if held:
            yield out()

    schema = "chunk long, words binary, tokens binary, bounds binary, learn binary, n_words long, n_tokens long" + "".join(f", c{k} array<{kind}>" for k, kind in enumerate(kinds))
    return slim.mapInArrow(run, schema)


class Chunk:
    """The tokens of a chunk, their probabilities by the levels answered so far, and the pairs to ask for next.

    gram: by token, the place of the string of ``level`` words that ends there, or -1; hashes and totals by place.
    """

    def __init__(self, row: dict[str, np.ndarray], n_tokens: int, n_distinct: int, min_count: int, spread: float, split: int) -> None:
        self.words, self.tokens, self.bounds = row["words"], _of_planes(row["tokens"]).astype(np.int64), row["bounds"]
        self.n_tokens, self.n_distinct, self.min_count, self.spread, self.split = n_tokens, n_distinct, min_count, spread, split
        sizes = np.diff(self.bounds)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], sizes)
        self.learn = np.repeat(row["learn"].astype(bool), sizes)
        self.level = 0
        self.gram, self.hashes = self.tokens, self.words
        self.totals = self.p = self.base = self.known = np.empty(0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(active tokens, pair of each, context of each pair, word of each pair, one token of each pair)."""
        if not self.level:
            every = np.arange(len(self.words))
            return np.arange(len(self.tokens)), self.tokens, np.zeros(len(every), np.int64), every, every
        before = np.append(-1, self.gram[:-1])
        active = np.flatnonzero((self.place >= self.level) & (before >= 0))
        active = active[self.totals[before[active]] >= self.min_count]
        pair, first, of = _grouped(before[active] * len(self.words) + self.tokens[active])
        return active, of, pair // len(self.words), pair % len(self.words), active[first]

    def asked(self, n_parts: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(order of the pairs by part, part of each in that order, what is sent of each in that order)."""
        active, of, context, word, one = self.found = self.pairs()
        own = self.words[word]
        if self.level:
            lead = self.hashes[context]
            whole = np.where(self.totals[context] >= self.split, self.totals[context], 0)
            salt = own % (1 + self.totals[context] // self.split).astype(np.uint64)
            part = tv.mix(lead + salt) % np.uint64(n_parts)
        else:
            lead, part = np.zeros(len(own), np.uint64), tv.mix(own) % np.uint64(n_parts)
            whole = np.zeros(len(own), np.int64)
        order = np.argsort(part.astype(np.uint16) if n_parts < 1 << 16 else part, kind="stable")  # the same on every machine
        n = np.bincount(of[self.learn[active]], minlength=len(own))
        below = self.p[one] if self.level else np.zeros(len(own))
        pairs = np.empty(len(order), PAIR)
        pairs["word"], pairs["n"], pairs["below"] = np.ascontiguousarray(own[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel(), n[order], below[order]
        return order, part[order].astype(np.int32), {"context": lead[order], "whole": whole[order], **{c: np.ascontiguousarray(pairs[c]) for c in PAIR.names}}

    def answered(self, totals: np.ndarray, kept: np.ndarray, passed: np.ndarray) -> None:
        """Takes the answers to what pairs() gave, in its order, and the contexts of several parts that are kept."""
        active, of, context, word, _ = self.found
        if not self.level:
            base = (totals + 0.5) / (self.n_tokens + 0.5 * (self.n_distinct + 1))
            self.p, self.known = base[of], totals[of] > 0
            self.base = np.log10(self.p)
            self.totals = totals
        else:
            n = self.totals[context].astype(float)
            wide = np.flatnonzero(n >= self.split)
            kept[wide] = np.isin(self.hashes[context[wide]], passed)
            use = np.flatnonzero(kept[of])
            m = (n**self.spread)[of[use]]
            self.p[active[use]] = (totals[of[use]] + m * self.p[active[use]]) / (n[of[use]] + m)
            self.gram = np.full(len(self.tokens), -1)
            self.gram[active] = of
            self.hashes, self.totals = tv.combine(self.hashes[context], self.words[word]), totals
        self.level += 1


def divergence(context: np.ndarray, whole: np.ndarray, totals: np.ndarray, below: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different contexts, sorted; the test's sum over the pairs of each, in steps; the different context of each pair).

    whole: a context's occurrences where only some of its pairs are given, or 0.
    """
    order = np.argsort(context)
    first = np.flatnonzero(np.append(True, np.diff(context[order].view(np.int64)) != 0))
    sizes = np.diff(np.append(first, len(order)))
    total, low, known = totals[order].astype(float), below[order].astype(float), whole[order[first]]
    n = np.repeat(np.where(known > 0, known, np.add.reduceat(total, first)), sizes)
    m = n**spread
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(total > 0, (total - 1 + m * low) / ((n - 1 + m) * low), 1.0)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(first)), sizes)
    return context[order[first]], np.add.reduceat(np.rint(total * np.log(ratio) * STEPS).astype(np.int64), first), of


def _answers(asks: DataFrame, level: int, gain: float, spread: float) -> DataFrame:
    """(chunk, level, part, totals, kept): an answer to each row of asks. Also (-1, ...), at level 0 with tokens and different
    words, else with the contexts whose pairs lie in several parts and this part's shares of their sums."""

    def run(table: pa.Table) -> pa.Table:
        context, n, below = (_numbers(table.column(c), k) for c, k in (("context", np.uint64), ("n", "<i4"), ("below", "<f2")))
        n, below = n.astype(np.int64), np.maximum(below, np.float16(1e-7))
        word = np.zeros((len(n), 8), np.uint8)
        word[:, :6] = _numbers(table.column("word"), np.uint8).reshape(-1, 6)
        word = word.view("<u8").ravel()
        cuts = np.concatenate([[0], np.cumsum(table.column("pairs").to_numpy())])
        key = tv.combine(context, word) if level else word
        _, one, of = _grouped(key)
        sums = np.bincount(of, weights=n, minlength=len(one)).astype(np.int64)
        kept, own = np.ones(len(one), bool), np.array([sums.sum(), (sums > 0).sum()])
        if level:
            whole = _of_sparse(table.column("whole"), np.diff(cuts))[one]
            contexts, steps, at = divergence(context[one], whole, sums, below[one], spread)
            kept = (steps >= gain * STEPS)[at]
            wide = np.unique(at[whole > 0])
            own = np.stack([contexts[wide].view(np.int64), steps[wide]], axis=1).ravel()
        chunk, totals, lists = table.column("chunk").combine_chunks(), sums[of], kept[of].astype(np.uint8)
        if len(own):
            chunk = pa.concat_arrays([chunk, pa.array([-1], pa.int64())])
            totals, lists = np.append(totals, own), np.append(lists, np.zeros(len(own), np.uint8))
            cuts = np.append(cuts, len(totals))
        rows = len(chunk)
        return pa.table([chunk, pa.array(np.full(rows, level, np.int32)), pa.array(np.full(rows, table.column("part")[0].as_py(), np.int32)), _binary(totals, cuts), _binary(lists, cuts)], names=["chunk", "level", "part", "totals", "kept"])

    return asks.groupBy("part").applyInArrow(run, "chunk long, level int, part int, totals binary, kept binary")


def _passed(shares: np.ndarray, gain: float) -> np.ndarray:
    """The contexts of several parts whose shares, (context, steps) of each part, sum to the gain."""
    contexts, _, of = _grouped(np.ascontiguousarray(shares[:, 0]).view(np.uint64))
    steps = np.zeros(len(contexts), np.int64)
    np.add.at(steps, of, shares[:, 1])
    return contexts[steps >= gain * STEPS]


def _replayed(row: dict, answers: pa.Table, done: list[tuple[int, np.ndarray]], model: tuple) -> Chunk:
    """A chunk after all levels that were answered: their numbers of parts, and the contexts of several parts that are kept."""
    state = Chunk(row, *model)
    level, part = (answers.column(c).to_numpy() for c in ("level", "part"))
    for k, (n_parts, passed) in enumerate(done):
        order, _, _ = state.asked(n_parts)
        mine = np.flatnonzero(level == k)
        own = answers.take(pa.array(mine[np.argsort(part[mine], kind="stable")]))
        totals, kept = np.empty(len(order), np.int64), np.empty(len(order), bool)
        for target, name, kind in ((totals, "totals", np.int64), (kept, "kept", np.uint8)):
            target[order] = _numbers(own.column(name), kind)
        state.answered(totals, kept, passed)
    return state


def _row(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: _numbers(table.column(c), kind) for c, kind in (("words", np.uint64), ("tokens", np.uint8), ("bounds", np.int64), ("learn", np.uint8))}


def score(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), depth: int = DEPTH, min_count: int = MIN_COUNT, gain: float = GAIN, spread: float = SPREAD, chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS, split: int = SPLIT) -> DataFrame:
    """(key, *carry, n_tokens, n_known, train_tokens, base_score, score) for each row, by a model of the rows that learn marks."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, *carry)]
    chunks = written(chunked(docs, learn, key=key, text=text, carry=carry, chunk_bytes=chunk_bytes))
    n_all, n_words = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    done: list[tuple[int, np.ndarray]] = []
    answers, model = None, (0, 0, min_count, spread, split)

    def sent(state: Chunk, chunk: int, n_parts: int, rounds: int, which: int) -> pa.Table:
        _, part, sent = state.asked(n_parts)
        mine = part % rounds == which
        part, sent = part[mine], {c: v[mine] for c, v in sent.items()}
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        cuts = np.append(first, len(part)).astype(np.int64)
        columns = [*(_binary(sent[c], cuts) for c in ("context", "word", "n", "below")), _sparse(sent["whole"], cuts)]
        return pa.table([pa.array(part[first], pa.int32()), pa.array(np.full(len(first), chunk)), pa.array(np.diff(cuts)), *columns], names=["part", "chunk", "pairs", "context", "word", "n", "below", "whole"])

    def asking(n_parts: int, model: tuple, done: list[tuple[int, np.ndarray]], rounds: int, which: int):
        first = lambda left: sent(Chunk(_row(left), *model), left.column("chunk")[0].as_py(), n_parts, rounds, which)
        later = lambda left, right: sent(_replayed(_row(left), right, done, model), left.column("chunk")[0].as_py(), n_parts, rounds, which)
        return later if done else first

    asked = "part int, chunk long, pairs long, context binary, word binary, n binary, below binary, whole binary"
    slim = chunks.select("chunk", "words", "tokens", "bounds", "learn")
    for level in range(depth + 1):
        n_parts = max(1, -(-(n_all if level else n_words) // part_keys))
        rounds, found = ROUNDS if level > 1 else 1, None
        for which in range(rounds):
            ask = asking(n_parts, model, list(done), rounds, which)
            asks = (slim.groupBy("chunk").cogroup(answers.groupBy("chunk")) if level else slim.groupBy("chunk")).applyInArrow(ask, asked)
            one = written(_answers(asks, level, gain, spread))
            found = one if found is None else found.unionAll(one)
            released(docs.sparkSession)
        # two numbers from each part, and a part for each PART_KEYS words; then two to each SPLIT occurrences or so
        own = _numbers(found.where("chunk = -1").select("totals").toArrow().column("totals"), np.int64).reshape(-1, 2)
        done.append((n_parts, _passed(own, gain) if level else np.empty(0, np.uint64)))
        if not level:
            model = (*map(int, own.sum(axis=0)), min_count, spread, split)
        found = found.where("chunk >= 0")
        answers = found if answers is None else answers.unionAll(found)
    names = [key, *carry, "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        state = _replayed(_row(left), right, done, model)
        sums = [np.add.reduceat(x, state.bounds[:-1]) for x in (state.known.astype(np.int64), state.base, np.log10(state.p))]  # each text has a token
        columns = [left.column(f"c{k}").combine_chunks().flatten() for k in range(len(kinds))]
        return pa.table([*columns, pa.array(np.diff(state.bounds)), *map(pa.array, sums)], names=names)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip((key, *carry), kinds, strict=True)) + ", n_tokens long, n_known long, base_score double, score double"
    scored = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema))
    discard(chunks, answers)
    return scored.withColumn("train_tokens", F.lit(int(model[0])).cast("long"))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    return score(docs, ~F.col("held_out"), carry=("held_out",))
