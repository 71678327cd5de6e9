import re

import __spark_entry__
import corpus_pipeline
from siftline.llm import op4_toxicity, op7_mixing, op10_packing
from tests.llm.common import clashing, documents
from tests.llm.test_op6_similar import groups
from tests.llm.test_op9 import word_runs
from tests.llm.test_op10 import check


def test_stages_like_brute_force(spark, sf, tmp_path):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest has too few toxic labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            bad = {r.doc_id for r in op4_toxicity.query(spark, sf).where("predicted = 1").collect()}
            assert bad and {r.doc_id for r in after} == {r[0] for r in before} - bad
        elif name == "simhash_near_dedup":
            of, least = groups([r[1] or "" for r in before]), {}
            for r in before:
                least[of[r[1] or ""]] = min(least.get(of[r[1] or ""], r[0]), r[0])
            ids = [r.doc_id for r in after]
            assert set(least.values()) <= set(ids) and len(ids) <= 1.02 * len(least) < len(before)
        elif name == "suffix_array_dedup":
            marked = 0
            by = {r.doc_id: r.text for r in after}
            for r, raw, words, mark in zip(before, *word_runs([r[1] for r in before], 51), strict=True):
                edges = [x for x, _ in words] + [len(raw)]
                kept = raw[: edges[0]] + b"".join(raw[edges[i] : edges[i + 1]] for i, m in enumerate(mark) if not m)
                assert by[r[0]] == (None if r[1] is None else kept.decode())
                marked += any(mark)
            assert len(after) == len(before) and marked
        elif name == "source_mixing":
            assert len(after) != len(before) and {r.doc_id for r in after} <= {r[0] for r in before}
            words = lambda rows: sum(len(re.findall(op7_mixing.WORD, r[1] or "")) for r in rows)
            assert abs(words(after) / words(before) - 1.5) < 0.2
        else:
            check(after, before, op10_packing.CAPACITY, op10_packing.MAX_PER_SOURCE)


def test_run_and_registration(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "bin_id" in out.columns
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_awkward_and_empty_tables(spark, sf, tmp_path):
    """Nulls, blanks, repeats, a long text and clashing columns go through all stages; empty tables stay empty."""
    docs, none = clashing(documents(spark)), clashing(documents(spark)).where("false")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (docs, none):
            path = str(tmp_path / f"{name}{frame is none}")
            stage(spark, frame, sf).write.parquet(path)
        docs, none = (spark.read.parquet(str(tmp_path / f"{name}{empty}")) for empty in (False, True))
        assert docs.count() > 0 and none.count() == 0
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            ids = [r.doc_id for r in docs.collect()]
            assert None in ids and len(ids) == len(set(ids))
