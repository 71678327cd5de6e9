import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import op6_similar as op
from siftline.llm import textvec as tv
from tests.llm.common import clashing, documents, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts, similarity=0.8):
    """Components of the different texts, by all pairs."""
    sets = {t: shingle_set(t) for t in texts}
    keys, home = list(sets), {t: t for t in sets}

    def find(t):
        while home[t] != t:
            t = home[t]
        return t

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if jaccard(sets[a], sets[b]) >= similarity:
                home[find(a)] = find(b)
    return {t: find(t) for t in keys}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def corpus(seed=11):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    for base in texts[:30]:
        texts += [edited(rng, base, rng.randrange(1, 3)) for _ in range(rng.randrange(1, 4))]
    hub = prose(rng, 150)
    return texts + [edited(rng, hub, 2) for _ in range(40)] + ["", None, "  ", "one two", "One  TWO", "one two three"]


def test_shingles_like_brute_force():
    texts = ["", "One", "one two three four", "a b c d e", "a b c d e a b c d e", None, "x " * 9, prose(random.Random(1), 50)]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    hashes, bounds = op.shingles(data, offsets)
    known = {}
    for k, t in enumerate(texts):
        own = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert len(own) == len(shingle_set(t)) and own == sorted(own)
        known.setdefault(frozenset(shingle_set(t)), set()).add(tuple(own))
    assert all(len(v) == 1 for v in known.values())


def test_scheme_grows_with_the_logarithm():
    for n in (10, 10**5, 10**9, 10**12):
        bits, count, most = op.scheme(n)
        assert bits <= op.MAX_BITS and 2**bits >= min(n * 32, 2**op.MAX_BITS) and most < 0.3 * op.SIGNATURE
    assert op.scheme(10**9)[1] > op.scheme(10**6)[1] > op.scheme(10**6, 0.95)[1]


def test_majority_like_counting():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 3, 254, 255, 256, 700, 0, 4]
    hashes, bounds = rng.integers(0, 1 << 64, sum(sizes), dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    got = op.majority(hashes, bounds, 100)
    for k, n in enumerate(sizes):
        own = hashes[bounds[k] : bounds[k + 1]]
        for bit in (0, 7, 8, 63, 64, 99):
            salted = tv.mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (bit // 64 + 1) & (1 << 64) - 1))
            ones = [int(x) >> bit % 64 & 1 for x in salted]
            assert got[k, bit] == (n > 0 and (2 * sum(ones) > n or 2 * sum(ones) == n and ones[0] == 1))


def test_fingerprints_of_similar_texts_are_close():
    rng = random.Random(2)
    a = prose(rng, 300)
    texts = [a, edited(rng, a, 3), prose(rng, 300)]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    prints, signature = op.fingerprints_of(data, offsets, 24, 10)
    bits = lambda x, y: int(np.bitwise_count(prints[x] ^ prints[y]).sum())
    assert bits(0, 1) < 45 < 80 < bits(0, 2) and prints.max() < 1 << 24
    near = lambda x, y: int(np.bitwise_count((signature[x] ^ signature[y]).view(np.uint64)).sum())
    assert near(0, 1) < 30 < 45 < near(0, 2)


def test_linked_loses_no_row():
    rng = np.random.default_rng(6)
    near = rng.integers(-(1 << 63), 1 << 63, (3, 2))
    rows = np.array([[z, 100 * z + k, *near[k % 3]] for z in range(40) for k in range(z % 7 + 1)])
    leaders, links = op.linked(rows, 10)
    assert len(leaders) == sum(min(3, z % 7 + 1) for z in range(40)) and len(leaders) + len(links) == len(rows)
    assert all((a - b) % 3 == 0 and a // 100 == b // 100 and a < b for a, b in links.tolist())


@pytest.mark.parametrize("n,seed", [(400, 1), (1600, 2)])
def test_recall_of_pairs_at_the_bound(n, seed):
    """Of hundreds of pairs of similarity 0.80 to 0.85, at two sizes of the scheme, at least RECALL share a variant and pass the signature."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = prose(rng, 230).split()
        texts.append(" ".join(words))
        for at in rng.sample(range(6, 222, 7), 5):
            words[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string()), 1 << 30))
    sets = [shingle_set(t) for t in texts]
    pairs = np.array([k for k in range(n) if 0.8 <= jaccard(sets[2 * k], sets[2 * k + 1]) <= 0.85])
    bits, count, most = op.scheme(10**5 * n)
    prints, signature = op.fingerprints_of(data, offsets, bits, count)
    met = (np.bitwise_count(prints[2 * pairs] ^ prints[2 * pairs + 1]) <= op.RADIUS).any(axis=1)
    near = np.bitwise_count((signature[2 * pairs] ^ signature[2 * pairs + 1]).view(np.uint64)).sum(axis=1) <= most
    assert len(pairs) > 300 and (met & near).mean() >= op.RECALL


@pytest.mark.parametrize("members", [op.MEMBERS, 8])  # with 8, clusters are compared with their centre and in blocks
def test_components_like_all_pairs(spark, members):
    texts = corpus()
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    want = groups([t or "" for t in texts])
    found = {r.node: r.root for r in op.similar(docs, members=members).collect()}
    node = {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    got = {i: found.get(node[i], node[i]) for i in range(len(texts))}
    pairs = wrong = missed = 0
    for i in range(len(texts)):
        for j in range(i):
            together = want[texts[i] or ""] == want[texts[j] or ""]
            pairs += together
            missed += together and got[i] != got[j]
            wrong += got[i] == got[j] and not together
    assert pairs > 800 and wrong == 0 and missed <= 0.01 * pairs
    kept = op.representatives(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = sorted(r.doc_id for r in kept.collect())
    least = {}
    for i in range(len(texts)):
        least[got[i]] = min(least.get(got[i], i), i)
    assert ids == sorted(least.values())


def test_awkward_rows(spark):
    data = rows()
    docs = documents(spark, data)
    ids = [r.doc_id for r in op.representatives(docs).collect()]
    want = groups([r[1] or "" for r in data])
    assert len(ids) == len(set(want.values())) and None in ids and ids.count(3) == 1
    assert op.representatives(docs.where(F.lit(False))).count() == 0
    assert op.representatives(docs.where("doc_id = 1")).count() == 1


def test_copies_of_one_text_that_are_not_copies_of_each_other(spark):
    """A star: edits far apart leave each copy at 0.85 to the original and about 0.72 to the other copies."""
    rng = random.Random(4)
    words = prose(rng, 304).split()
    texts = [" ".join(words)]
    for k in range(300):
        new = list(words)
        for at in rng.sample(range(10, 290, 7), 5):
            new[at] = f"new{k}x{at}"
        texts.append(" ".join(new))
    sets = [shingle_set(t) for t in texts]
    assert all(jaccard(sets[0], s) >= 0.8 for s in sets[1:]) and sum(jaccard(sets[i], sets[i + 1]) < 0.8 for i in range(1, 300)) > 280
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert op.representatives(docs).count() <= 3
    assert op.similar(docs, members=50).select("root").distinct().count() <= 3
