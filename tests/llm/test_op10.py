import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import op10_packing as op
from tests.llm.common import clashing, documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(items, capacity, per_source):
    """Looks at every bin for the tightest compatible one."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + size <= capacity and sum(x[1] == source for x in b) < per_source and all(x[2] != cluster for x in b)]
        k = min(fits)[1] if fits else len(bins)
        bins += [[]] if not fits else []
        out.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((size, source, cluster))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 6)), max_size=40), st.integers(1, 3))
def test_best_fit_like_brute_force(items, per_source):
    assert op.best_fit(items, 20, per_source) == brute(items, 20, per_source)


def check(got, data, capacity, per_source):
    """Whole documents in bins that hold no more than they may, and no conflicts."""
    text = defaultdict(list)
    for r in data:
        text[r[0]].append(r)
    pieces = defaultdict(list)
    for g in got:
        pieces[g.doc_id].append(g)
    for key, own in text.items():
        sizes = sorted(len(WORD.findall(r[1] or "")) for r in own)
        assert sum(p.n_words for p in pieces[key]) == sum(sizes)
        assert all(p.bin_id is None for p in pieces[key]) == (sum(sizes) == 0)
    bins = defaultdict(list)
    for g in got:
        if g.bin_id is not None:
            bins[g.bin_id].append(g)
    for inside in bins.values():
        inside.sort(key=lambda p: p.bin_offset)
        at = 0
        for p in inside:
            assert p.bin_offset == at
            at += p.n_words
        assert at <= capacity
        rests = [text[p.doc_id][0] for p in inside]
        assert max(Counter(r[3] for r in rests).values()) <= per_source and max(Counter(r[1] for r in rests).values()) == 1


def test_pack(spark):
    data = rows(3, 150) + [(1000 + i, "copy of one text", "en", f"s{i % 4}", 1) for i in range(40)]
    docs = clashing(documents(spark, data))
    got = op.pack(docs, capacity=128, max_per_source=2, shard_rows=64).collect()
    check(got, data, 128, 2)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, op.pack(docs.repartition(5), capacity=128, max_per_source=2, shard_rows=64).collect())) == sorted(map(key, got))
    assert op.pack(docs.where(F.lit(False))).count() == 0
    assert [(p.piece, p.start_word, p.n_words) for p in sorted((p for p in got if p.doc_id == 154), key=lambda p: p.piece)] == [(k, 128 * k, min(128, 3000 - 128 * k)) for k in range(24)]


def test_texts_of_pieces(spark):
    data = rows(3, 60) + [(900, "  spaced\n out " * 300, "en", "s9", 1)]
    got = op.pack(documents(spark, data), capacity=128, texts=True).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g.piece):
        by[g.doc_id].append(g)
        assert g.text is None or len(WORD.findall(g.text)) == g.n_words
    for r in data:
        if sum(x[0] == r[0] for x in data) == 1:
            assert (None if r[1] is None else "".join(g.text for g in by[r[0]])) == r[1]


def test_query(spark, sf):
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op.query(spark, sf).collect(), data, op.CAPACITY, op.MAX_PER_SOURCE)


def test_near_copies_do_not_share_a_bin(spark, sf):
    from siftline.llm import op6_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    component = {r.doc_id: r.component for r in op6_simhash.near_duplicates(docs).collect()}
    rests = Counter((g.bin_id, component[g.doc_id]) for g in op.query(spark, sf).collect() if g.n_words % op.CAPACITY)
    assert max(rests.values()) == 1 and max(Counter(component.values()).values()) > 1


def test_long_text(spark):
    docs = documents(spark, [(1, "word " * 100_000, "en", "s", 1), (2, "a b", "en", "s", 1)])
    got = [g for g in op.pack(docs, texts=True).collect() if g.doc_id == 1]
    assert sum(g.n_words for g in got) == 100_000 and "".join(g.text for g in sorted(got, key=lambda g: g.piece)) == "word " * 100_000
