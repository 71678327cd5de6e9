"""Keyed upsert with change detection, events and the alert state machine, in sets instead of row by row.

A batch may hold an id several times; later rows see earlier ones. The stored row enters as sequence -1,
and windows over (job_uid, seq) give each row its predecessor. One exchange on job_uid serves all.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.schema import PAYLOAD, STATE


def transitions(rows: DataFrame, *, uid: str = "job_uid", seq: str = "seq", content: str = "content_hash", tier: str = "tier", stored_alert: str = "last_alerted_tier", sends: bool = True) -> DataFrame:
    """rows (incoming with seq >= 0, stored with -1) plus is_new, changed, tier_changed, previous_tier, event, should_alert; stored rows are kept."""
    w = Window.partitionBy(uid).orderBy(seq)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select(
        "*",
        F.lag(tier).over(w).alias("previous_tier"),
        F.lag(content).over(w).alias("_previous_content"),
        F.coalesce(F.max(F.when(F.col(seq) < 0, F.col(stored_alert) == "A")).over(earlier), F.lit(False)).alias("_stored_a"),
        F.coalesce(F.max((F.col(seq) >= 0) & (F.col(tier) == "A")).over(earlier), F.lit(False)).alias("_had_a"),
        F.lag(F.lit(1)).over(w).isNull().alias("is_new"),
    )
    # an A row that did not alert when it came had alerted before, so any earlier A row means an alert was sent
    alerted = F.col("_stored_a") | F.col("_had_a") if sends else F.col("_stored_a")
    out = before.select(
        "*",
        (F.col("is_new") | ~F.col("_previous_content").eqNullSafe(F.col(content))).alias("changed"),
        (F.col("is_new") | ~F.col("previous_tier").eqNullSafe(F.col(tier))).alias("tier_changed"),
        alerted.alias("alerted_before"),
    )
    event = F.when(F.col("is_new"), "created").when(F.col("changed") | F.col("tier_changed"), "updated")
    alert = (F.col(tier) == "A") & (~F.col("alerted_before") | F.col("tier_changed"))
    return out.select("*", event.alias("event"), alert.alias("should_alert")).drop("_previous_content", "_stored_a", "_had_a")


def latest(rows: DataFrame, *, uid: str = "job_uid", seq: str = "seq", stored_alert: str = "last_alerted_tier", sends: bool = True) -> DataFrame:
    """The last row of each id of ``transitions``, with first_seen_at and created_at of the first and the alert state of all."""
    w = Window.partitionBy(uid).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = F.max(F.when(F.col(seq) < 0, F.col(stored_alert))).over(whole)
    sent = F.max((F.col(seq) >= 0) & F.col("should_alert")).over(whole)
    ranked = rows.select("*", F.first("first_seen_at").over(whole).alias("_first"), F.first("created_at").over(whole).alias("_created"), (F.when(sent, "A").otherwise(kept) if sends else kept).alias("_alert"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    return ranked.where("_last").withColumns({"first_seen_at": F.col("_first"), "created_at": F.col("_created"), stored_alert: F.col("_alert")}).drop("_first", "_created", "_alert", "_last")


def stamped(incoming: DataFrame, run_ts: Column) -> DataFrame:
    """Incoming rows in the columns of the state, seen at run_ts, with their seq."""
    stamps = {c: run_ts for c in ("first_seen_at", "last_seen_at", "created_at", "updated_at")} | {"last_alerted_tier": F.lit(None).cast("string")}
    return incoming.withColumns(stamps).select(*STATE.names, F.col("seq").cast("long").alias("seq"))


def upsert(incoming: DataFrame, state: DataFrame, run_ts: datetime, *, sends: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, new state, events) of a batch; incoming has the state's record and evaluation columns and seq.

    Only ids of the batch meet the windows: the other stored rows pass by, on an anti join.
    """
    ts = F.lit(run_ts)
    ids = incoming.select("job_uid").distinct()
    touched = state.join(ids, "job_uid", "left_semi").select(*STATE.names, F.lit(-1).cast("long").alias("seq"))
    moved = transitions(stamped(incoming, ts).unionByName(touched), sends=sends)
    results = moved.where("seq >= 0").select("job_uid", "seq", "is_new", "changed", "tier_changed", "should_alert")
    renewed = latest(moved, sends=sends).select(*STATE.names)
    untouched = state.join(ids, "job_uid", "left_anti").select(*STATE.names)
    happened = moved.where("seq >= 0 and event is not null")
    payload = F.struct(
        F.when(F.col("event") == "created", F.col("tier")).alias("tier"),
        F.when(F.col("event") == "updated", F.col("previous_tier")).alias("previous_tier"),
        F.when(F.col("event") == "updated", F.col("tier")).alias("new_tier"),
        F.when(F.col("event") == "updated", F.col("changed")).alias("changed"),
        F.lit(None).cast("string").alias("channel"),
        F.lit(None).cast("string").alias("message"),
    )
    events = happened.select("job_uid", F.col("event").alias("event_type"), ts.alias("created_at"), payload.alias("payload"))
    return results, untouched.unionByName(renewed), events


def acknowledged(alerts: DataFrame, run_ts: datetime, channel: str) -> DataFrame:
    """alert_sent events of (job_uid, tier, message); ids without a stored row are the caller's to leave out."""
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in PAYLOAD.fields}
    values = nothing | {"tier": F.col("tier"), "channel": F.lit(channel), "message": F.col("message")}
    return alerts.select("job_uid", F.lit("alert_sent").alias("event_type"), F.lit(run_ts).alias("created_at"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("payload"))


def counters(results: DataFrame) -> DataFrame:
    """One row: ingested, persisted (updates count) and alerts."""
    n = F.count("*")
    return results.agg(n.alias("ingested"), n.alias("persisted"), F.coalesce(F.sum(F.col("should_alert").cast("long")), F.lit(0)).cast("long").alias("alerts"))
