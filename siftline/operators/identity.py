"""Identity of a record: source id, else canonical URL, else a fingerprint of its content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import canonical_parts, normalize, or_else, stable_hash, url_parts, url_text

PREFIX = 800


def content_keys(records: DataFrame) -> DataFrame:
    """records with _by_id, fingerprint and content_hash: all of the identity that needs texts, and no URL.

    Where URLs come from a join, take these keys first and leave the texts out of its shuffle.
    """
    by_id = F.when(F.coalesce(F.col("source_job_id"), F.lit("")) != "", F.concat(F.col("source"), F.lit(":"), normalize(F.col("source_job_id")))).otherwise("")
    parts = [normalize(F.col(c)) for c in ("company", "title", "location_text", "remote_text")] + [normalize(F.substring("description_clean", 1, PREFIX))]
    more = [normalize(F.col(c)) for c in ("salary_text", "timezone_text", "employment_type", "status")]
    out = records.withColumns({"_by_id": by_id, "_body": F.concat_ws("|", *parts)})
    return out.withColumns({"fingerprint": stable_hash(F.col("_body")), "content_hash": stable_hash(F.concat_ws("|", "_body", *more))}).drop("_body")


def identified(keyed: DataFrame) -> DataFrame:
    """Rows of ``content_keys`` with apply_url and original_url, plus job_uid."""
    first = or_else(F.col("apply_url"), F.col("original_url"))
    out = keyed.withColumns({"_first": url_text(first), "_second": url_text(F.col("original_url"))})
    for step in (url_parts, canonical_parts):
        out = out.withColumns({c: step(F.col(c)) for c in ("_first", "_second")})
    return out.withColumn("job_uid", stable_hash(or_else(*map(F.col, ("_by_id", "_first", "_second", "fingerprint"))))).drop("_by_id", "_first", "_second")


def identity(records: DataFrame) -> DataFrame:
    """records with job_uid, fingerprint and content_hash. No shuffle."""
    return identified(content_keys(records))
