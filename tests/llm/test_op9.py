import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import op9_suffix as op
from siftline.llm.losertree import Run, common_prefix, common_suffix, front_code, merge
from tests.llm.common import clashing, documents, prose


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + width]) for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i : i + width])] > 1:
                mark[i : i + width] = b"\1" * width
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=7))
def test_merge_sorts_and_knows_prefixes(groups):
    ordered = [sorted(g) for g in groups]
    got = list(merge([Run(*front_code(g)) for g in ordered]))
    strings = [s for _, _, _, s in got]
    assert strings == sorted(x for g in groups for x in g)
    assert all(ordered[run][at] == s for run, at, _, s in got)
    assert all(common == common_prefix(strings[i - 1], strings[i]) for i, (_, _, common, _) in enumerate(got) if i)


def test_merge_never_compares_known_prefixes(monkeypatch):
    import siftline.llm.losertree as lt

    looked = []
    real = lt.common_prefix
    rng = random.Random(1)
    runs = [Run(*front_code(sorted("p" * 300 + prose(rng, 3) for _ in range(50)) and sorted(("p" * 300 + prose(rng, 3)).encode() for _ in range(50)))) for _ in range(8)]
    monkeypatch.setattr(lt, "common_prefix", lambda a, b, known=0: looked.append(known) or real(a, b, known))
    n = sum(1 for _ in lt.merge(runs))
    assert n == 400 and sum(k < 300 for k in looked) < 16  # only the first round looks at the prefix that all share


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=8), st.binary(max_size=8))
def test_common_ends(a, b):
    p = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert common_prefix(a, b) == p and common_suffix(a[::-1], b[::-1]) == p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=4), st.text(alphabet="ab", min_size=4, max_size=8), st.integers(1, 2)), min_size=1, max_size=14, unique_by=lambda x: x[:2]))
def test_reach_like_all_pairs(items):
    width, items = 8, sorted(items, key=lambda x: (x[1], x[0]))
    strings, lefts, counts = [x[1].encode() for x in items], [x[0].encode() for x in items], [x[2] for x in items]
    shared = [0] + [common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False)]
    want = []
    for i in range(len(items)):
        best = [0, 0]
        for j in range(len(items)):
            if i == j and counts[i] < 2:
                continue
            l, r = common_suffix(lefts[i], lefts[j]), common_prefix(strings[i], strings[j])
            if l + r >= width:
                best = [max(best[0], l), max(best[1], r)]
        want.append(tuple(best))
    assert op.reach(strings, shared, lefts, counts, width) == want


def test_pieces_find_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    data[20_000:25_000] = data[3_000:8_000]
    bounds = np.array([0, len(data)])
    whole = op.anchors(data, bounds)
    monkeypatch.setattr(op, "PIECE", 4096)
    found = {}
    for _, shift, part, offsets, first, last in op._pieces(data, bounds, op.WIDTH):
        at, hashes, context, _ = op.anchors(part, offsets, op.WIDTH, first, last)
        found |= {int(p) + shift: (int(h), int(c)) for p, h, c in zip(at, hashes, context, strict=True)}
    assert found == {int(p): (int(h), int(c)) for p, h, c in zip(*whole[:3], strict=True)}


def samples(seed=2):
    rng = random.Random(seed)
    shared, passage = prose(rng, 90), prose(rng, 70)
    texts = [prose(rng, rng.randrange(5, 150)) for _ in range(25)]
    texts += [f"{prose(rng, rng.randrange(1, 9))} {passage[: rng.randrange(300, len(passage))]} {prose(rng, 4)}" for _ in range(25)]
    texts += [shared] * 6 + [shared[:-1] + "é", "z" + shared[1:], "ab" * 600, "ab" * 201, "b" + "ab" * 200, "y" * 400, "y" * 401, "x" * 399, "", None, "é" * 250 + "q", "é" * 250 + "r"]
    return texts


@pytest.mark.parametrize("hot", [op.HOT, 3, 1])
def test_like_brute_force(spark, hot):
    texts = samples()
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, texts[4], "en", "s", 1)]
    want = sorted((str(r[0]), *b) for r, b in zip(data, brute([r[1] for r in data], 400), strict=True))
    docs = clashing(documents(spark, data))
    got = op.digests(docs, hot=hot)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert sum(w[2] > 0 for w in want) > 20


def word_runs(texts, n):
    """Each text's word spans, and which words lie in strings of n words that start anywhere else."""
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    raw = [(t or "").encode() for t in texts]
    strings = [[tuple(r[a:b] for a, b in w[i : i + n]) for i in range(len(w) - n + 1)] for r, w in zip(raw, words, strict=True)]
    seen = Counter(s for own in strings for s in own)
    marks = []
    for w, own in zip(words, strings, strict=True):
        mark = [False] * len(w)
        for i, s in enumerate(own):
            if seen[s] > 1:
                mark[i : i + n] = [True] * n
        marks.append(mark)
    return raw, words, marks


def passages():
    """Passages of 49 to 54 short words, below 400 bytes, in other texts; and what samples() has."""
    rng = random.Random(8)
    texts = samples(6)
    for n in (49, 50, 51, 52, 54):
        passage = " ".join(f"{rng.choice('abcdé')}{rng.randrange(99)}" for _ in range(n))
        texts += [f"{prose(rng, rng.randrange(0, 9))}\n{passage}\t {prose(rng, 5)}" for _ in range(3)]
    return texts + ["ja " * 51 + "nein", "ja " * 50 + "doch", "ja " * 200]


@pytest.mark.parametrize("hot", [op.HOT, 3])
def test_passages_like_brute_force(spark, hot):
    texts = passages()
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (2, texts[2], "en", "s", 1)]
    _, _, marks = word_runs([r[1] for r in data], 51)
    want = sorted((str(r[0]), *b, sum(m), sum(x and (not i or not m[i - 1]) for i, x in enumerate(m))) for r, b, m in zip(data, brute([r[1] for r in data], 400), marks, strict=True))
    got = op.digests(clashing(documents(spark, data)), hot=hot, passages=51)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words, r.n_passages) for r in got.collect()) == want
    assert any(w[5] and not w[2] for w in want)


def test_stage_and_empty_tables(spark):
    texts = passages()
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    out = op.shortened(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect()}
    for i, (raw, words, mark) in enumerate(zip(*word_runs(texts, 51), strict=True)):
        edges = [a for a, _ in words] + [len(raw)]
        kept = raw[: edges[0]] + b"".join(raw[edges[k] : edges[k + 1]] for k, m in enumerate(mark) if not m)
        assert by[i].text == (None if texts[i] is None else kept.decode())
        assert by[i].text is None or by[i].n_chars == len(by[i].text)
    assert sum(any(m) for m in word_runs(texts, 51)[2]) > 20
    none = docs.where(F.lit(False))
    assert op.digests(none, passages=51).count() == 0 and op.shortened(none).count() == 0


def test_bytes_cut_from_texts(spark):
    texts = samples(5)
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    by = {r.doc_id: r.text for r in op.deduplicated(docs).collect()}
    for i, (t, b) in enumerate(zip(texts, brute(texts, 400), strict=True)):
        assert (by[i] is None) == (t is None) and (b[1] or by[i] == t)
        assert not b[1] or b[0] - b[1] - 3 <= len(by[i].encode()) <= b[0] - b[1]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs]
    want = {(r.doc_id, *b, sum(m)) for r, b, m in zip(docs, brute(texts, 400), word_runs(texts, 51)[2], strict=True)}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in op.query(spark, sf).collect()} == want
