"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import op1_suffix_tree, op2_quality, op3_telephony, op4_toxicity, op5_warc, op6_simhash, op7_mixing, op8_langid, op9_suffix, op10_packing
from siftline.llm.storage import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]


def _bounded(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


_OWN: dict[str, Query] = {
    "op1_suffix_tree_lm": op1_suffix_tree.query,
    "op2_quality_llr": op2_quality.query,
    "op3_telephony_audio": op3_telephony.query,
    "op4_counterfactual_toxicity": op4_toxicity.query,
    "op5_warc_bundles": op5_warc.query,
    "op6_simhash_ball": op6_simhash.query,
    "op7_source_mixing": op7_mixing.query,
    "op8_language_id": op8_langid.query,
    "op9_suffix_dedup": op9_suffix.query,
    "op10_best_fit_packing": op10_packing.query,
}

QUERIES = {name: _bounded(query) for name, query in _OWN.items()}

#: None of the ten can be written in DuckDB SQL (hashes, trained models, byte formats, components); see tests/llm.
SQL: dict[str, str] = {}
