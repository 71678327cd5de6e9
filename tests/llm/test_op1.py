import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import op1_suffix_tree as op
from tests.llm.common import clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lowered), END]


def brute(train, texts, depth, least, gain, spread):
    """The same model with dictionaries, a context at a time: rows, kept contexts, and the probability of a word after a context."""
    c = Counter(t for x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    base = lambda t: (c[t] + 0.5) / (n + 0.5 * (v + 1))
    following = {}
    for x in train:
        s = tokens(x)
        for k in range(1, depth + 1):
            for i in range(k, len(s)):
                following.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    kept = set()

    def p(context, s):
        for k in range(min(len(context), depth), 0, -1):
            if context[-k:] in kept:
                own = following[context[-k:]]
                m = sum(own.values()) ** spread
                return (own[s] + m * p(context[-k + 1 :] if k > 1 else (), s)) / (sum(own.values()) + m)
        return base(s)

    for k in range(1, depth + 1):
        new = set()
        for context, own in following.items():
            total = sum(own.values())
            if len(context) == k and total >= least:
                m = total**spread
                low = {s: p(context[1:], s) for s in own}
                if sum(j * math.log((j - 1 + m * low[s]) / ((total - 1 + m) * low[s])) for s, j in own.items()) >= gain:
                    new.add(context)
        kept |= new
    out = []
    for x in texts:
        t = tokens(x)
        total = sum(math.log10(p(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(len(t)))
        out.append((len(t), sum(c[y] > 0 for y in t), sum(math.log10(base(y)) for y in t), total))
    return n, out, kept, p, c


def sentences():
    lines = ["The cat sat on a mat", "the dog ate the cat", "a bird ate on a mat", "the cat sat on the dog"]
    rng = random.Random(3)
    return [(i, " ".join([*rng.choices(lines, k=i % 5 + 1), f"rare{i // 2}"]), "en", "s", 1) for i in range(60)]


@pytest.mark.parametrize("depth,gain,chunk_bytes,part_keys,split", [(2, 2.0, 500, 40, 1 << 20), (3, 8.0, 1 << 20, 1 << 20, 1 << 20), (2, -1e9, 900, 30, 5)])
def test_like_dictionaries(spark, depth, gain, chunk_bytes, part_keys, split):
    """The last: contexts split over parts are kept without the test, so here all are."""
    docs = documents(spark, sentences()).repartition(3)
    data = docs.collect()
    n, want, kept, p, c = brute([r.text for r in data if r.doc_id % 3], [r.text for r in data], depth, op.MIN_COUNT, gain, op.SPREAD)
    got = {r.doc_id: r for r in op.score(docs, F.expr("doc_id % 3 <> 0"), depth=depth, gain=gain, chunk_bytes=chunk_bytes, part_keys=part_keys, split=split).collect()}
    assert len(kept) > 5
    for r, (n_tokens, known, base, score) in zip(data, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n_tokens, known, n)
        assert abs(g.base_score - base) < 1e-8 and abs(g.score - score) < 1e-4, (g, score)
    for context in list(kept)[:20]:  # a distribution sums to 1 after any context, with one unseen word
        assert abs(sum(p(context, s) for s in c) + p(context, "unseen") - 1) < 1e-9


@pytest.mark.parametrize("split", [5, 60, 1 << 20])
def test_contexts_in_several_parts_take_the_same_test(spark, split):
    """Words drawn evenly, some of whose frequent contexts fail the test, beside sentences, whose frequent contexts pass it."""
    rng = random.Random(9)
    even = [(100 + i, " ".join(rng.choices(["red", "blue", "tall", "wide", "old"], k=40)), "en", "s", 1) for i in range(40)]
    docs = documents(spark, [*sentences(), *even]).repartition(3)
    data = docs.collect()
    n, want, kept, p, c = brute([r.text for r in data], [r.text for r in data], 2, op.MIN_COUNT, op.GAIN, op.SPREAD)
    often = Counter(x for r in data for x in itertools.pairwise(tokens(r.text)) if x[1] is not END)
    assert ("the",) in kept and {x for x, k in often.items() if k >= 60} - kept
    got = {r.doc_id: r for r in op.score(docs, F.lit(True), chunk_bytes=900, part_keys=30, split=split).collect()}
    for r, (*_, score) in zip(data, want, strict=True):
        assert abs(got[r.doc_id].score - score) < 1e-4, (r.doc_id, got[r.doc_id].score, score)


def test_sum_of_the_test_whatever_the_parts():
    rng = np.random.default_rng(1)
    context, n, below = rng.integers(0, 9, 5000).astype(np.uint64) << np.uint64(61), rng.integers(0, 50, 5000), rng.random(5000).astype(np.float16).clip(np.float16(1e-7))
    keys, steps, of = op.divergence(context, np.zeros(5000, np.int64), n, below, op.SPREAD)
    whole, shares = np.bincount(of, n).astype(np.int64)[of], []
    for part in range(7):
        mine = rng.permutation(np.arange(part, 5000, 7))
        k, share, _ = op.divergence(context[mine], whole[mine], n[mine], below[mine], op.SPREAD)
        shares.append(np.stack([k.view(np.int64), share], axis=1))
    for bound in sorted(steps.tolist()):
        assert op._passed(np.concatenate(shares), bound / op.STEPS).tolist() == keys[steps >= bound].tolist()


def test_texts_that_occur_twice_stand_out(spark):
    """At any size: copies of a text of its own words get contexts of two occurrences."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(120)]
    data = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *texts[:20]])]
    mean = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in op.score(documents(spark, data), F.lit(True)).collect()}
    assert min(mean[i] for i in range(20)) > max(mean[i] for i in range(20, 120)) + 0.2


def test_awkward_rows(spark):
    docs = clashing(documents(spark)).withColumn("held_out", op.held_out())
    got = op.score(docs, ~F.col("held_out"), carry=("held_out",))
    assert got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[40].n_tokens == by[41].n_tokens == by[42].n_tokens == 1 and not by[None].held_out
    assert all(r.n_known == r.n_tokens for r in by.values() if not r.held_out)


def test_long_texts(spark):
    """Texts of more than a block and more than a chunk."""
    rng = random.Random(7)
    texts = ["one two " * 80_000, " ".join(f"w{rng.randrange(3000)}" for _ in range(90_000)), "one two three"]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    by = {r.doc_id: r for r in op.score(docs, F.lit(True), chunk_bytes=100_000).collect()}
    assert [by[i].n_tokens for i in range(3)] == [160_001, 90_001, 4]
    assert by[0].score / by[0].n_tokens > -0.02 > by[0].base_score / by[0].n_tokens


def test_empty_tables(spark):
    docs = documents(spark)
    assert op.score(docs.where(F.lit(False)), F.lit(True)).count() == 0
    row = op.score(docs.where("doc_id = 5"), F.lit(False)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and abs(row.base_score) < 1e-9 and abs(row.score) < 1e-9


def test_query_against_sql_counts(spark, sf, duck):
    got = {r.doc_id: r for r in op.query(spark, sf).collect()}
    data = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in data}
    c = Counter(t for i, x in data if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in data:
        t = tokens(x)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[y] > 0 for y in t), n)
        assert abs(r.base_score - sum(math.log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in t)) < 1e-6
    mean = lambda f: sum(f(r) for r in got.values() if r.held_out) / sum(r.n_tokens for r in got.values() if r.held_out)
    assert mean(lambda r: r.score) > mean(lambda r: r.base_score)
