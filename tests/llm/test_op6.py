import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from siftline.llm import op6_simhash as op
from siftline.llm import textvec as tv
from siftline.llm.graph import components
from tests.llm.common import clashing, documents, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius=3):
    """Smallest member of the component of each distinct value."""
    values, home = sorted(values), {v: v for v in values}

    def find(v):
        while home[v] != v:
            v = home[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                home[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_like_brute_force():
    texts = ["", None, "One", "one TWO", "a b c", "É a\tb\n\nc D", prose(random.Random(1), 300), "x x x x x"]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    for width in (3, 5):
        got = op.fingerprints_of(data, offsets, width).view(np.uint64).tolist()
        assert got == [brute(t, width) for t in texts]


def test_links_like_brute_force(spark):
    rng = random.Random(4)
    fps = {0, (1 << 63) | 7}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(6)):
            flipped = base
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                flipped ^= 1 << b
            fps.add(flipped)
            base = rng.choice([base, flipped])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = roots(signed)
    got = {r.node: r.root for r in components(op.links(op.with_partners(frame))).collect()}
    assert {f: got.get(f, f) for f in signed} == want and len(set(want.values())) < len(signed)
    edges = op.links(frame).collect()
    assert all(bin((e.fp ^ e.centre) & (1 << 64) - 1).count("1") <= 3 for e in edges)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(200, 200 + i) for i in range(30)]
    home = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in home.items() if k in got} and all(v == k for k, v in home.items() if k not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    data = rows()
    docs = clashing(documents(spark, data))
    got = op.near_duplicates(docs).collect()
    assert len(got) == len(data)
    fps = {brute(r[1]) for r in data}
    want = roots(fps)
    least = {}
    for r in data:
        root = want[brute(r[1])]
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    expected = sorted(((r[0], f"{brute(r[1]):016x}", least.get(want[brute(r[1])])) for r in data), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected
    kept = op.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(want.values())) and sorted(i for i in ids if i is not None) == sorted(least.values())
    assert op.near_duplicates(docs.where(F.lit(False))).count() == 0 and op.representatives(docs.where(F.lit(False))).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: brute(t) for i, t in docs.items()}
    want = roots(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[want[f]] = min(least.get(want[f], i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op.query(spark, sf).collect()} == {(i, f"{f:016x}", least[want[f]]) for i, f in fps.items()}
