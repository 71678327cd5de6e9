import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import op2_quality as op
from siftline.llm import textvec as tv
from tests.llm.common import clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \né#", max_size=60)), min_size=1, max_size=6))
def test_rules_like_brute_force(texts):
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string()), 1 << 20))
    out, _ = op.rules(data, offsets)
    assert list(zip(*(out[c].tolist() for c in op.RULE_COLUMNS), strict=True)) == [brute(t) for t in texts]


def test_ratio_like_brute_force(spark):
    data = [(i, t, "en", "s", 1) for i, t in enumerate(["good clean words here " * 5, "good text", "| menu | home |" * 9, "", None])]
    docs = documents(spark, data)
    buckets = 1 << 10

    def grams(text):
        words = WORD.findall(text or "")
        _, _, raw, offsets = next(tv.each_block(pa.array([text], pa.string())))
        starts, ends, bounds = tv.word_spans(raw, offsets)
        return op._grams(starts, ends, bounds, tv.Prefix(raw), buckets)[0].tolist(), 2 * len(words) - 1 if words else 0

    raw, target = Counter(), Counter()
    for i, text, *_ in data:
        found, n = grams(text)
        assert len(found) == n
        raw.update(found)
        if i < 2:
            target.update(found)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {b: (target[b] + op.PRIOR) / (raw[b] / n_raw * n_target + op.PRIOR) for b in raw}
    z = sum(raw[b] / n_raw * ratio[b] for b in raw)
    # buckets that no text has count in the norm with probability 0
    got = {r.doc_id: r for r in op.quality(docs, docs.where("doc_id < 2").select("text"), n_buckets=buckets).collect()}
    for i, text, *_ in data:
        found, n = grams(text)
        want = sum(math.log(ratio[b] / z) for b in found) / max(n, 1)
        assert abs(got[i].llr - want) < 1e-9
        assert got[i].kept == (not got[i].base_failed and got[i].llr >= op.THRESHOLD)
    assert got[0].llr > got[2].llr


def test_awkward_rows(spark):
    docs = clashing(documents(spark))
    got = op.quality(docs, docs.where(F.lit(False)).select("text"))
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.llr == 0 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert (by[40].n_words, by[40].base_failed, by[40].kept) == (0, True, False) and by[44].n_repeat_words == 3000 and by[44].base_failed
    assert op.quality(docs.where(F.lit(False)), docs.select("text")).count() == 0
    assert np.all(op.log_ratios(np.zeros(4), np.ones(4)) == 0)


def test_clean_documents_stay_and_junk_goes(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op.query(spark, sf).join(labels, "doc_id").where("not base_failed")
    rates = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] == 1.0 and rates.get(0, 0) < 0.5
