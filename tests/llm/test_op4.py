import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.llm import op4_toxicity as op
from siftline.llm import textvec as tv
from tests.llm.common import clashing, documents, prose


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randrange(5, 60)), int(rng.random() < 0.2)
        if toxic:
            text += f" you {rng.choice(['scumbag', 'moron', 'idiot'])} {rng.choice(['women', 'muslims', 'x'])}"
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_features_like_brute_force():
    texts = ["Hello, hello WORLD!", "", "Straße été x", None, "a-b abcdefgh"]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    at, row = op.features(data, offsets)
    for k, t in enumerate(texts):
        assert sorted(at[row == k].tolist()) == sorted(op.text_features(t or "").tolist())
    assert len(at[row == 0]) == 2 * 3  # hello and world with prefixes of 4 and 5 bytes (hello and its prefix of 5 differ by salt)


def test_learns_and_leaves_group_mentions_alone(spark):
    rows, labels = corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = op.held_out()
    weights = op.train(docs, marks.where(~held))
    assert np.array_equal(weights, op.train(docs.repartition(7), marks.where(~held)))
    got = op.score(docs.withColumn("held_out", held), weights, carry=("held_out",)).join(marks, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    neutral = documents(spark, [(1, "We met women and men there.", "en", "s", 1), (2, "muslims and christians work here", "en", "s", 1), (3, "you moron", "en", "s", 1)])
    a, b, c = (r.score for r in op.score(neutral, weights).orderBy("doc_id").collect())
    assert a < op.THRESHOLD and b < op.THRESHOLD and c > op.THRESHOLD


def test_counterfactuals_lower_what_terms_add():
    rows, labels = corpus(300)
    at = op.Bags.of([op.text_features(r[1] + " women" * (x[2] and r[0] % 2)) for r, x in zip(rows, labels, strict=True)])
    y = np.array([x[2] for x in labels])
    pairs = [(op.text_features(a), op.text_features(b)) for a, b in op.counterfactuals([("women", r[1]) for r in rows[:50]])]
    gap = lambda w: max(abs(op.sigmoid(w[a].sum() + w[-1]) - op.sigmoid(w[b].sum() + w[-1])) for a, b in pairs)
    assert gap(op.fit(at, y, pairs, counterfactual=50.0)) < 0.5 * gap(op.fit(at, y, pairs, counterfactual=0.0))
    found = op.counterfactuals([("women", "hi women there")], swaps=9)
    assert [p for p in found[:3]] and {p[1] for p in found[:3]} == {"hi men there", "hi girls there", "hi boys there"} and ("gay", "people") in found


def neutral_mentions():
    """Toxic texts hold an insult or a rare word of one beginning; the bare word, and one like it, are in few texts, none of them toxic."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        text = prose(rng, rng.randrange(8, 40))
        if toxic:
            text += " moron" if i % 2 else f" grofel{rng.choice('abcdefgh')}{rng.randrange(999)}"
        elif i % 20 == 1:
            text += f" {['grofel', 'grofelz'][i % 40 == 1]} {prose(rng, 3)}"
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_penalty_acts_on_neutral_mentions(spark):
    rows, labels = neutral_mentions()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = op.sampled(docs, marks, key="doc_id", text="text", label="toxic", max_train=10**6).collect()
    assert len(sample) == 900
    without, with_ = (op.train(docs, marks.where(~op.held_out()), counterfactual=c) for c in (0.0, 10.0))
    assert np.abs(without - with_).max() > 0.1
    scores = [{r.doc_id: r.score for r in op.score(docs, w).collect()} for w in (without, with_)]
    mean = lambda s, k, n: sum(s[i] for i in range(k, 900, n)) / len(range(k, 900, n))
    assert mean(scores[1], 1, 20) < mean(scores[0], 1, 20) - 0.1 and mean(scores[1], 5, 10) > 0.9


def test_mentions_like_brute_force():
    texts = ["Grofel one two, GROFEL women! " + "x " * 700 + "women end", "", None, "nothing here", "grofela women"]
    hashed = lambda t: tv.Prefix(np.frombuffer(t, np.uint8)).hashes(np.array([0]), np.array([len(t)]))
    names = np.sort(hashed(b"women"))
    telling = np.sort(np.concatenate([tv.mix(hashed(b"grof") + np.uint64(4)), hashed(b"grofela")]) % np.uint64(op.N_FEATURES))
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    got = op.mentions(data, offsets, telling, names)
    assert [g[:2] for g in got] == [(0, "grofel"), (0, "women"), (4, "women")] and got[0][2].startswith("grofel one two")
    # a term far into a text is found, with the words around it
    _, _, data, offsets = next(tv.each_block(pa.array(["x " * 3000 + "women end"])))
    assert op.mentions(data, offsets, telling, names) == [(0, "women", "x " * op.WINDOW + "women end")]


def test_sample_is_bounded_by_rows(spark):
    docs = documents(spark, [(i % 10, f"text {i}", "en", "s", 1) for i in range(200)])
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    one = lambda d, n: sorted((r.text, r.label) for r in op.sampled(d, marks, key="doc_id", text="text", label="toxic", max_train=n).collect())
    assert len(one(docs, 7)) == 7 and one(docs, 7) == one(docs.repartition(5), 7)


def test_awkward_rows(spark):
    docs = clashing(documents(spark))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = op.train(docs, none)
    got = op.score(docs, weights).collect()
    assert len(got) == docs.count() and all(r.score < 1e-9 and r.predicted == 0 for r in got)
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None), (9999, 0, 1)], none.schema)
    weights = op.train(docs, marks)
    by = {r.doc_id: r.score for r in op.score(docs, weights).collect()}
    assert by[40] == by[41] == by[42] and all(0 <= s <= 1 for s in by.values())
    assert op.score(docs.where(F.lit(False)), weights).count() == 0


def test_stage_drops_what_the_query_predicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = op.clean(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in op.query(spark, sf).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
