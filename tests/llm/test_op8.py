import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.llm import op8_langid as op
from siftline.llm import textvec as tv
from tests.llm.common import clashing, documents


def test_accuracy_on_held_out(spark, sf):
    got = op.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_logits_are_the_mean_over_subwords():
    rng = np.random.default_rng(1)
    model = op.Model(["a", "b"], rng.normal(size=(op.BUCKETS, 2)), np.array([0.1, -0.1]), 0.5)
    texts = ["Hello world", "", "é", "a", None, "xyz " * 50]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    got = op.block_logits(data, offsets, model)
    for k, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ((at, n),) = op.bags(raw, np.array([0, len(raw)]))
        want = (model.table[at] * n[:, None]).sum(axis=0) / max(n.sum(), 1) + model.bias
        assert np.allclose(got[k], want)


def test_letters():
    texts = ["a", "1 2", "", "é", "日本", "!?", None, "ŉ", "１", "٣"]
    _, _, data, offsets = next(tv.each_block(pa.array(texts, pa.string())))
    assert op.has_letter(data, offsets).tolist() == [any(c.isalpha() for c in t or "") for t in texts]


def test_awkward_rows(spark):
    docs = clashing(documents(spark))
    model = op.train(docs)
    assert model.languages == ["de", "en"]
    rows = op.identify(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (40, 41, 42))
    assert by[None].lang_pred in model.languages
    nothing = op.train(docs.where(F.lit(False)))
    assert {r.lang_pred for r in op.identify(docs, nothing).collect()} == {"und"} and op.identify(docs.where(F.lit(False)), model).count() == 0
    again = op.train(docs.repartition(5))
    assert np.array_equal(model.table, again.table)
