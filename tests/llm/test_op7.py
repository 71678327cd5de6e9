import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import op7_mixing as op
from tests.llm.common import clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def aims(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Shares by weight; what exceeds the cap is shared again until none does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = [s for s in open_ if cap * sizes[s] <= unit * w[s]]
        if not over:
            return out | {s: unit * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="aBé0", max_size=3)), st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_like_resharing(spark, sizes):
    frame = spark.createDataFrame([(s or "", s is None, n) for s, n in sizes.items()], "source string, no_source boolean, source_size long")
    got = {None if r.no_source else r.source: r.target for r in op.targets(frame).collect()}
    want = aims(sizes)
    assert all(abs((got[s] or 0) - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix(spark):
    rng = random.Random(8)
    data = [(i, " ".join(["wörd"] * rng.randrange(0, 60)), "en", rng.choice(["a"] * 6 + ["b", "c", "d", None, ""]), 1) for i in range(600)]
    data += [(None, "x y", "en", "a", 1), (1, None, "en", "a", 1), (5000, "same row", "en", "b", 1), (5000, "same row", "en", "b", 1)]
    docs = clashing(documents(spark, data))
    got = op.mix(docs).collect()
    assert len(got) == len(data)
    sizes, of = Counter(), {}
    for i, text, _, source, _ in data:
        sizes[source] += len(WORD.findall(text or ""))
        of[i, len(WORD.findall(text or ""))] = source
    want, taken = aims(sizes), defaultdict(int)
    for r in got:
        source = of[r.doc_id, r.size]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = op.mix(docs.repartition(9)).collect()
    key = lambda r: (str(r.doc_id), r.tag, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = op.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_complete_epochs_come_first(spark):
    docs = documents(spark, [(i, "a b c", "en", "big" if i < 90 else "tiny", 1) for i in range(100)])
    by = defaultdict(Counter)
    for r in op.mix(docs).collect():
        by[r.source_size][r.copies] += 1
    assert by[30] == Counter({2: 10}) and set(by[270]) <= {1, 2}


def test_quality_scales_the_keys(spark):
    rows = [(i, "good words here" if i % 2 else "1 2 3", "en", "s" if i < 2000 else "t", 1) for i in range(2300)]
    docs = documents(spark, rows)
    for quality in (None, F.when(F.col("doc_id") % 2 == 1, 1.0)):  # a caller's null is the least
        got = op.mix(docs, weights=(1, 1), share=0.5, max_epochs=1, quality=quality).where("source_size = 6000")
        rate = {r.good: r.rate for r in got.groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg((F.col("taken") > 0).cast("double")).alias("rate")).collect()}
        assert rate[1] > 1.5 * rate[0]


def test_quality_is_blind_to_scripts(spark):
    texts = ["plain words", "语言没有空格的文本", "кириллица", "a1 b2", "123 456", "", None, "$$$ a"]
    frame = documents(spark, [(i, t, None, "s", 1) for i, t in enumerate(texts)])
    got = [r.q for r in frame.select("doc_id", op.quality_weight("text").alias("q")).orderBy("doc_id").collect()]
    assert got == [1.0, 1.0, 1.0, 0.625, 0.25, 0.25, 0.25, 0.25 + 0.75 / 4]


def test_slices_are_even(spark):
    """Whatever the quality of a source's documents, no slice holds more than 1 / LEAST_QUALITY times the mean."""
    n, slices = 40_000, 64
    draw = lambda q: -F.log((F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") + 0.5) / float(1 << 53)) / q
    for q, most in ((0.25, 1.5), (0.5, 2.3), (1.0, 4.4)):
        sizes = [r["count"] for r in spark.range(n).select(op.slice_of(draw(q), slices).alias("s")).groupBy("s").count().collect()]
        assert max(sizes) <= most * n / slices


def test_long_text(spark):
    docs = documents(spark, [(1, "word " * 100_000, "en", "s", 1), (2, "a b", "en", "s", 1)])
    by = {r.doc_id: r for r in op.mix(docs).collect()}
    assert by[1].size == 100_000 and by[1].taken in (100_000, 200_000)


def test_empty_and_native(spark):
    docs = documents(spark)
    assert op.mix(docs.where(F.lit(False))).count() == 0
    blank = op.mix(documents(spark, [(1, "", "en", "s", 0), (2, None, "en", None, 0)])).collect()
    assert all(r.taken == 0 for r in blank)
    plan = op.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
