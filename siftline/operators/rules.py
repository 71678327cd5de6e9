"""The rule engine: phrase rules that pass, review or reject a record, with signals, reasons and risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import Rules
from siftline.functions.text import any_hit, normalize, normalize_literal, or_else, phrase_hits

#: The sentence of each rule, in rule order.
REASONS = {
    "closed": "Job is marked closed by the source.",
    "closed_phrase": "Job description indicates the role is no longer open.",
    "blacklist": "Company is on the configured blacklist.",
    "geography": "Role restricts hiring geography outside the target LATAM/Americas scope.",
    "timezone": "Timezone requirement looks incompatible with Chile/LATAM/Americas coverage.",
    "title": "Title maps to an excluded role family.",
    "description": "Description contains excluded role-family signals.",
    "phrase": "Description contains explicit hard blockers.",
    "review": "No strong target-family signals found; send to manual review.",
    "ambiguous": "Role passed hard filters but contains ambiguity that merits review.",
}
MANUAL = "Manual review: passed blockers but lacked enough high-confidence bridge-role signals."


def normalized(records: DataFrame) -> DataFrame:
    """records with _title, _company, _description (normal forms) and _blob (that of all fields the rules look at)."""
    description = or_else(F.col("description_clean"), F.col("description_raw"))
    each = records.select("*", normalize(F.col("title")).alias("_title"), normalize(F.col("company")).alias("_company"), normalize(description).alias("_description"), *[normalize(F.col(c)).alias(f"_{c}") for c in ("location_text", "remote_text", "timezone_text", "employment_type")])
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("_title", "_company", "_location_text", "_remote_text", "_timezone_text", "_employment_type", "_description")]
    return each.withColumn("_blob", F.concat_ws(" ", *parts)).drop("_location_text", "_remote_text", "_timezone_text", "_employment_type")


def _one(condition: Column, value: Column) -> Column:
    return F.when(condition, F.array(value)).otherwise(F.array().cast("array<string>"))


def is_listed(company: Column, names: Sequence[str]) -> Column:
    """Whether a normalised company equals a name of the list."""
    return company.isin([normalize_literal(n) for n in names]) if names else F.lit(False)


def hits(records: DataFrame, rules: Rules) -> DataFrame:
    """normalised records with the hits of each rule, labelled, in columns h_*."""
    title, blob, company = F.col("_title"), F.col("_blob"), F.col("_company")
    cancelled = any_hit(blob, [*rules.allowlist_phrases, *rules.target_geographies])
    none = F.array().cast("array<string>")
    return records.select(
        "*",
        _one(F.col("status") == "closed", F.lit("status:closed")).alias("h_closed"),
        phrase_hits(blob, rules.closed_phrases, "status_phrase:").alias("h_closed_phrase"),
        _one(is_listed(company, rules.company_blacklist), F.concat(F.lit("company_blacklist:"), F.col("company"))).alias("h_blacklist"),
        F.when(cancelled, none).otherwise(phrase_hits(blob, rules.geography_blockers, "geo_blocker:")).alias("h_geography"),
        phrase_hits(blob, rules.timezone_blockers, "timezone_blocker:").alias("h_timezone"),
        phrase_hits(title, rules.negative_title_signals, "title_blocker:").alias("h_title"),
        phrase_hits(blob, rules.negative_description_signals, "desc_blocker:").alias("h_description"),
        phrase_hits(blob, rules.blocker_phrases, "phrase_blocker:").alias("h_phrase"),
        phrase_hits(title, rules.positive_title_signals, "title_signal:").alias("h_title_signal"),
        phrase_hits(blob, rules.positive_description_signals, "description_signal:").alias("h_description_signal"),
        phrase_hits(blob, rules.allowlist_phrases, "allowlist:").alias("h_allowlist"),
        _one(is_listed(company, rules.company_whitelist), F.concat(F.lit("company_whitelist:"), F.col("company"))).alias("h_whitelist"),
        phrase_hits(blob, rules.timezone_allowed, "timezone_signal:").alias("h_timezone_signal"),
        phrase_hits(blob, rules.review_phrases, "review_flag:").alias("h_review"),
    )


BLOCKING = ("closed", "closed_phrase", "blacklist", "geography", "timezone", "title", "description", "phrase")
MATCHING = ("title_signal", "description_signal", "allowlist", "whitelist", "timezone_signal")


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def decided(records: DataFrame) -> DataFrame:
    """Records with hits, plus decision, bridge_role, fit_reason, signals, risks, audit log, and a provisional tier and bucket; the hits are dropped."""
    found = records.select(
        "*",
        F.concat(*[F.col(f"h_{k}") for k in BLOCKING]).alias("_blockers"),
        F.concat(*[F.col(f"h_{k}") for k in MATCHING]).alias("_matched"),
        ((F.size("h_title_signal") > 0) | (F.size("h_description_signal") > 0)).alias("bridge_role"),
    )
    decision = F.when(F.size("_blockers") > 0, "reject").when(F.col("bridge_role"), "pass").otherwise("review")
    found = found.withColumn("filter_decision", decision)
    passed, review = F.col("filter_decision") == "pass", F.col("filter_decision") == "review"
    risks = F.when(passed, F.col("h_review")).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("_risks", risks)
    because = [F.when(F.size(f"h_{k}") > 0, F.lit(REASONS[k])) for k in BLOCKING]
    because += [F.when(review, F.lit(REASONS["review"])), F.when(F.size("_risks") > 0, F.lit(REASONS["ambiguous"]))]
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    detail = F.concat(or_else(first(F.col("_matched"), 4), F.lit("deterministic match")), F.when(F.size("_risks") > 0, F.concat(F.lit("; risks: "), first(F.col("_risks"), 2))).otherwise(""))
    reason = F.when(F.col("filter_decision") == "reject", F.concat(F.lit("Rejected due to: "), first(F.col("_blockers"), 4))).when(review, F.lit(MANUAL)).otherwise(F.concat(F.lit("Passed hard filters with signals: "), detail))
    return found.select(
        *[c for c in found.columns if not c.startswith("h_") and c not in ("_blockers", "_matched", "_risks")],
        reason.alias("fit_reason"),
        sorted_set(F.col("_matched")).alias("matched_signals"),
        sorted_set(F.col("_blockers")).alias("detected_blockers"),
        sorted_set(F.col("_risks")).alias("risks"),
        F.array_compact(F.array(*because)).alias("audit_log"),
        F.when(F.col("filter_decision") == "reject", "C").otherwise("B").alias("provisional_tier"),
        F.when(F.col("filter_decision") == "reject", "Bucket C").otherwise("Bucket B").alias("provisional_bucket"),
    )


def apply_rules(records: DataFrame, rules: Rules) -> DataFrame:
    """Normalises, matches and decides: narrow throughout, no shuffle."""
    return decided(hits(normalized(records), rules))
