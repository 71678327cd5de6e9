import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.operators.identity import identity
from siftline.operators.state import counters, latest, transitions, upsert
from siftline.schema import STATE
from tests.records import records

T0 = datetime(2024, 1, 1)


def test_source_id_wins(spark):
    a, b = identity(records(spark, {"source_job_id": "123", "original_url": "https://e.com/1?utm_campaign=a", "description_clean": "x"}, {"source_job_id": "123", "original_url": "https://e.com/1?utm_campaign=b", "description_clean": "y"})).collect()
    assert a.job_uid == b.job_uid and a.content_hash != b.content_hash


def test_url_ignores_campaigns(spark):
    a, b, c = identity(records(spark, *[{"original_url": u} for u in ("https://example.com/jobs/42?utm_campaign=abc", "https://example.com/jobs/42?utm_campaign=xyz", "https://example.com/jobs/43")])).collect()
    assert a.job_uid == b.job_uid != c.job_uid


def test_fingerprint_across_sources(spark):
    rows = [{"source": s, "company": "C", "title": "T", "location_text": "L", "description_clean": "d" * 800 + tail} for s, tail in (("a", "1"), ("b", "2"))]
    a, b = identity(records(spark, *rows)).collect()
    assert a.job_uid == b.job_uid and a.fingerprint == b.fingerprint


def test_known_identity(spark):
    (r,) = identity(records(spark, {"source": "dailyremote-bridge", "source_job_id": "/remote-job/product-analytics-lead-4189860"})).collect()
    assert r.job_uid.startswith("2c11ffb5a78f1eb8")


def model(stored, rows, sends):
    """Row at a time."""
    state, out = {k: dict(v) for k, v in stored.items()}, []
    for uid, content, tier in rows:
        old = state.get(uid)
        if old is None:
            new, changed, moved, event = True, True, True, "created"
            alert = tier == "A"
            state[uid] = {"tier": tier, "content": content, "alerted": None}
        else:
            new, changed, moved = False, old["content"] != content, old["tier"] != tier
            event = "updated" if changed or moved else None
            alert = tier == "A" and (old["alerted"] != "A" or moved)
            old.update(tier=tier, content=content)
        if alert and sends:
            state[uid]["alerted"] = "A"
        out.append((new, changed, moved, event, alert))
    return out, state


def test_transitions_like_the_row_model(spark):
    rng = random.Random(3)
    for sends in (True, False):
        stored = {f"u{i}": {"tier": rng.choice("ABC"), "content": rng.choice("xy"), "alerted": rng.choice(["A", None])} for i in range(20)}
        rows = [(f"u{rng.randrange(40)}", rng.choice("xy"), rng.choice("ABC")) for _ in range(300)]
        want, end = model(stored, rows, sends)
        data = [(k, v["content"], v["tier"], v["alerted"], -1) for k, v in stored.items()] + [(*r, None, i) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(data, "job_uid string, content_hash string, tier string, last_alerted_tier string, seq long")
        moved = transitions(frame.withColumns({c: F.lit(T0) for c in ("first_seen_at", "created_at")}), sends=sends)
        got = moved.where("seq >= 0").orderBy("seq").collect()
        assert [(r.is_new, r.changed, r.tier_changed, r.event, r.should_alert) for r in got] == want
        assert {r.job_uid: {"tier": r.tier, "content": r.content_hash, "alerted": r.last_alerted_tier} for r in latest(moved, sends=sends).collect()} == end


def incoming(spark, rows):
    """(uid, content, tier) as rows of the state's columns with seq."""
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "job_uid string, content_hash string, tier string, seq long")
    return frame.select(*[F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields], "seq")


def test_upsert_keeps_first_seen_and_others(spark):
    empty = spark.createDataFrame([], STATE)
    _, state, events = upsert(incoming(spark, [("a", "1", "A"), ("b", "1", "B")]), empty, T0, sends=True)
    assert {(e.job_uid, e.event_type, e.payload.tier) for e in events.collect()} == {("a", "created", "A"), ("b", "created", "B")}
    state = spark.createDataFrame(state.collect(), STATE)
    later = T0 + timedelta(hours=1)
    results, new, events = upsert(incoming(spark, [("a", "2", "A"), ("a", "2", "B"), ("c", "1", "C")]), state, later, sends=True)
    by = {r.job_uid: r for r in new.collect()}
    assert set(by) == {"a", "b", "c"} and by["a"].tier == "B" and by["a"].last_alerted_tier == "A"
    assert by["a"].first_seen_at == T0 and by["a"].last_seen_at == later and by["b"].last_seen_at == T0
    assert [(r.job_uid, r.should_alert) for r in results.orderBy("seq").collect()] == [("a", False), ("a", False), ("c", False)]
    updated = [e.payload for e in events.where("event_type = 'updated'").collect()]
    assert [(p.previous_tier, p.new_tier, p.changed) for p in updated] in ([("A", "A", True), ("A", "B", False)], [("A", "B", False), ("A", "A", True)])
    assert counters(results).first().asDict() == {"ingested": 3, "persisted": 3, "alerts": 0}


def test_transitions_take_one_exchange(spark):
    frame = incoming(spark, [("a", "1", "A")]).withColumn("last_alerted_tier", F.lit(None).cast("string"))
    plan = transitions(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_urls_are_cut_once(spark):
    plan = identity(records(spark, {"original_url": "https://e.com/1"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 20
