"""Weighted scores, the scorer's and the final tier, and the pluggable rerank stage."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import Profiles
from siftline.functions.text import any_hit, normalize_literal, two_decimals
from siftline.operators.rules import is_listed

SKIPPED = "Scoring skipped because job was hard rejected."


def source_weight(source: Column, weights: dict[str, float]) -> Column:
    """The weight of a source, else of what stands before its first colon, else 0."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, source), F.try_element_at(table, F.substring_index(source, ":", 1)), F.lit(0.0))


def _weighted(text: Column, weights: dict[str, float], label: str) -> tuple[Column, Column]:
    """(sum of the weights of phrases in text, their labels in order)."""
    total, labels = F.lit(0.0), []
    for phrase, weight in weights.items():
        hit = text.contains(F.lit(normalize_literal(phrase)))
        total = total + F.when(hit, float(weight)).otherwise(0.0)
        labels.append(F.when(hit, F.lit(f"{label}:{phrase}")))
    return total, F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")


def score(records: DataFrame, profiles: Profiles) -> DataFrame:
    """Decided records with fit_score and scorer_tier; score signals follow the sorted rule signals."""
    title, description, company = F.col("_title"), F.col("_description"), F.col("_company")
    by_title, title_labels = _weighted(title, profiles.title_weights, "title_weight")
    by_description, description_labels = _weighted(description, profiles.description_weights, "description_weight")
    priority = is_listed(company, profiles.company_priority)
    total = by_title + by_description + source_weight(F.col("source"), profiles.source_weights) + F.when(priority, 2.0).otherwise(0.0)
    total = total - F.when(any_hit(title, profiles.bucket_c_signals), 8.0).otherwise(0.0)
    total = total + F.when(any_hit(description, profiles.bucket_a_signals), 3.0).otherwise(0.0) + F.when(any_hit(description, profiles.bucket_b_signals), 1.5).otherwise(0.0)
    decision = F.col("filter_decision")
    rejected = decision == "reject"
    full = F.when(rejected, 0.0).when(decision == "review", F.greatest(total - 3.0, F.lit(0.0))).otherwise(total)
    out = records.withColumn("fit_score", full)
    added = F.concat(title_labels, description_labels, F.when(priority, F.array(F.concat(F.lit("company_priority:"), F.col("company")))).otherwise(F.array().cast("array<string>")))
    line = F.when(rejected, F.lit(SKIPPED)).otherwise(F.concat(F.lit("Deterministic score computed as "), two_decimals(F.col("fit_score")), F.lit(".")))
    tier = F.when(rejected, "C").when((F.col("fit_score") >= profiles.threshold_a) & (decision == "pass"), "A").otherwise("B")
    return out.withColumns(
        {
            "deterministic_score": F.col("fit_score"),
            "matched_signals": F.when(rejected, F.col("matched_signals")).otherwise(F.concat("matched_signals", added)),
            "audit_log": F.array_append("audit_log", line),
            "scorer_tier": tier,
        }
    )


Reranker = Callable[[pd.DataFrame], pd.DataFrame]
ANSWER = "struct<semantic_score:double,bridge_role:boolean,fit_reason:string,risks:array<string>>"


def skip_rerank(records: DataFrame) -> DataFrame:
    """The disabled stage: a line in the audit log."""
    return records.withColumn("audit_log", F.array_append("audit_log", F.lit("Semantic rerank skipped.")))


def without_key(records: DataFrame) -> DataFrame:
    """The enabled stage without credentials: a line in the audit log, by decision."""
    line = F.when(F.col("filter_decision") == "pass", F.lit("Semantic rerank skipped because API key is missing.")).otherwise(F.lit("Semantic rerank not allowed for non-passing job."))
    return records.withColumn("audit_log", F.array_append("audit_log", line))


def merge_answers(records: DataFrame, answer: Column) -> DataFrame:
    """Adds an answer (a struct like ANSWER, null where there is none) to each passed record."""
    passed = F.col("filter_decision") == "pass"
    a = records.withColumn("_answer", answer)
    got = passed & F.col("_answer").isNotNull()
    points = F.coalesce(F.col("_answer.semantic_score"), F.lit(0.0))
    said = F.trim(F.coalesce(F.col("_answer.fit_reason"), F.lit("")))
    none = F.array().cast("array<string>")
    line = F.when(~passed, F.lit("Semantic rerank not allowed for non-passing job.")).when(got, F.concat(F.lit("Semantic rerank added "), two_decimals(points), F.lit(" points."))).otherwise(F.lit("Semantic rerank skipped."))
    return a.withColumns(
        {
            "semantic_score": F.when(got, points),
            "fit_score": F.when(got, F.col("fit_score") + points).otherwise(F.col("fit_score")),
            "bridge_role": F.col("bridge_role") | (got & F.coalesce(F.col("_answer.bridge_role"), F.lit(False))),
            "fit_reason": F.when(got & (said != ""), said).otherwise(F.col("fit_reason")),
            "risks": F.when(got, F.array_sort(F.array_distinct(F.concat("risks", F.coalesce(F.col("_answer.risks"), none))))).otherwise(F.col("risks")),
            "audit_log": F.array_append("audit_log", line),
        }
    ).drop("_answer")


def prompt_column(template: str, max_chars: int) -> Column:
    """The prompt of each record: the template's placeholders filled, the description cut."""
    fields = {"title": "title", "company": "company", "location": "location_text", "remote_text": "remote_text", "employment_type": "employment_type", "timezone_text": "timezone_text"}
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column), F.lit("")))
    text = F.coalesce(F.nullif(F.col("description_clean"), F.lit("")), F.col("description_raw"))
    return F.replace(out, F.lit("{description}"), F.substring(text, 1, max_chars))


def rerank(records: DataFrame, ask: Callable[[pd.Series], pd.Series], *, template: str, max_chars: int = 6000) -> DataFrame:
    """Asks about passed records only, in Arrow batches of prompts: other columns stay where they are, and rules run once.

    ask maps prompts to strict JSON. Malformed JSON ends the run.
    """

    def answers(prompts: pd.Series) -> pd.Series:
        asked = prompts[prompts.notna()]
        said = pd.Series(list(ask(asked)), index=asked.index, dtype=object) if len(asked) else asked.astype(object)
        return said.reindex(prompts.index).where(prompts.notna(), None)

    # not deterministic: the optimiser may neither repeat a question nor move a filter below it
    model = F.pandas_udf(answers, "string").asNondeterministic()
    prompt = F.when(F.col("filter_decision") == "pass", prompt_column(template, max_chars))
    asked = records.withColumn("_prompt", prompt).withColumn("_said", model("_prompt")).drop("_prompt")
    return merge_answers(asked, F.from_json("_said", ANSWER, {"mode": "FAILFAST"})).drop("_said")


def final_tier(records: DataFrame, profiles: Profiles) -> DataFrame:
    """tier and bucket by the final thresholds, which are not those of the scorer."""
    rejected = F.col("filter_decision") == "reject"
    tier = F.when(rejected, "C").when((F.col("fit_score") >= profiles.final_a) & F.col("bridge_role"), "A").when(F.col("fit_score") >= profiles.final_b, "B").otherwise("C")
    return records.withColumn("tier", tier).withColumn("bucket", F.concat(F.lit("Bucket "), F.col("tier")))
