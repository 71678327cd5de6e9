import csv
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.config import App, Chat, Profiles, Rerank, Rules, Source
from siftline.plans import reports
from siftline.plans.pipeline import Engine
from siftline.schema import RECORD
from siftline.sources.scan import landed
from siftline.sources.store import Store
from siftline.streaming.intake import start
from tests.records import records
from tests.test_sources import CARDS, PARAMS

T0 = datetime(2024, 1, 1)
RULES = Rules(positive_title_signals=["title"])
PROFILES = Profiles(title_weights={"title": 20.0})


def app(base, **chat):
    sources = [Source("cards", "html", True, PARAMS | {"url": "https://e.org/c"}), Source("broken", "html", True, {"url": "x"}), Source("off", "nothing", False)]
    return App(store=str(base), rules=RULES, profiles=PROFILES, sources=sources, chat=Chat(enabled=True, **chat), rerank=Rerank())


def test_run_alert_digest_and_exports(spark, tmp_path):
    pages = landed(spark.createDataFrame([("https://e.org/c", CARDS)], "url string, html string"))
    sent = []
    engine = Engine(spark, app(tmp_path / "s"), pages, send=lambda m: sent.append(m) or True)
    assert engine.run(T0) == {"ingested": 2, "persisted": 2, "alerts": 1}
    assert len(sent) == 1 and sent[0].splitlines()[:2] == ["A-tier job alert", "Title @ Acme"] and sent[0].endswith("Apply: https://e.org/a?x=1")
    assert engine.run(T0 + timedelta(hours=1)) == {"ingested": 2, "persisted": 2, "alerts": 0}
    kinds = sorted(r.event_type for r in engine.store.events().collect())
    assert kinds == ["alert_sent", "created", "created"]
    text = engine.digest(now=T0 + timedelta(hours=2))
    assert text == "Daily job digest\n\nA-tier roles (1)\n- [A] Title @ Acme | Why: title_signal:title, title_weight:title | Link: https://e.org/a?x=1"
    assert sent[-1] == text and engine.digest(now=T0 + timedelta(days=3)).endswith(reports.EMPTY_DIGEST)
    path = engine.export_csv(str(tmp_path / "out" / "x.csv"))
    raw = path.read_bytes()
    assert raw.count(b"\r\n") == 2 and tuple(next(csv.reader(raw.decode().splitlines()))) == reports.CSV_COLUMNS
    page = engine.render_html(str(tmp_path / "r.html")).read_text()
    assert page.count("<tr>") == 3 and "<td>20.0</td>" in page
    engine.feedback("u", "good")
    assert engine.store.feedback().count() == 1


def test_failed_sends_stay_due(spark, tmp_path):
    """Of three alerts the second fails: two are acknowledged, and only the other is sent by the next run."""
    rows = records(spark, *[{"title": f"title {k}", "source_job_id": k, "company": k} for k in "abc"])
    engine = Engine(spark, app(tmp_path / "s"), None)
    from siftline.operators.identity import identity
    from siftline.operators.state import upsert
    from siftline.plans.pipeline import evaluate
    from siftline.sources.staging import written

    decided = written(identity(evaluate(rows.withColumn("seq", F.monotonically_increasing_id()), RULES, PROFILES)))
    results, _, events = upsert(decided, engine.store.state(), T0, sends=True)
    _, state, _ = upsert(decided, engine.store.state(), T0, sends=False)
    engine.store.commit(state, events)
    alerts = written(decided.join(results.where("should_alert"), ["job_uid", "seq"]).select("job_uid", "tier", "seq", reports.instant_alert().alias("message")))
    said = []

    def send(message):
        said.append(message)
        if len(said) == 2:
            raise OSError("no line")
        return True

    engine.send = send
    assert engine._alert(alerts, T0) == 2 and len(said) == 3
    assert engine.store.state().where("last_alerted_tier = 'A'").count() == 2
    assert engine.store.events().where("event_type = 'alert_sent'").count() == 2
    results, _, _ = upsert(decided, engine.store.state(), T0, sends=True)
    assert results.where("should_alert").count() == 1


def test_a_run_that_dies_before_its_pointer_leaves_no_trace(spark, tmp_path, monkeypatch):
    import pytest

    store = Store(spark, str(tmp_path / "s"))
    state, events = store.state(), store.events()
    assert store.commit(state, events) == 1

    def dies(self, versions):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "_point", dies)
        with pytest.raises(OSError):
            store.commit(state, events)
    assert store.versions() == [1] and store.commit(state, events) == 3 and store.versions() == [1, 3]


def test_all_sources_failing_fails_the_run(spark, tmp_path):
    import pytest
    from dataclasses import replace

    broken = replace(app(tmp_path / "s"), sources=[Source("broken", "html", True, {"url": "x"})])
    with pytest.raises(RuntimeError, match="broken"):
        Engine(spark, broken, None).run(T0)


def test_without_sender_a_rows_stay_due(spark, tmp_path):
    pages = landed(spark.createDataFrame([("https://e.org/c", CARDS)], "url string, html string"))
    engine = Engine(spark, app(tmp_path / "s"), pages)
    engine.run(T0)
    assert engine.run(T0)["alerts"] == 0 and engine.store.state().where("last_alerted_tier is not null").count() == 0


def test_rerank_in_the_run(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    (tmp_path / "p.txt").write_text("{title}")
    pages = landed(spark.createDataFrame([("https://e.org/c", CARDS)], "url string, html string"))
    base = replace(app(tmp_path / "s"), rerank=Rerank(enabled=True, prompt_path=str(tmp_path / "p.txt")))
    engine = Engine(spark, base, pages)
    engine.run(T0)
    lines = {r.title: r.audit_log[-1] for r in engine.store.state().collect()}
    assert lines["Title"] == "Semantic rerank skipped because API key is missing." and lines[""] == "Semantic rerank not allowed for non-passing job."
    Engine(spark, base, pages, ask=lambda p: p.map(lambda x: '{"semantic_score": 1.5, "risks": ["r"]}')).run(T0)
    row = engine.store.state().where("title = 'Title'").first()
    assert row.fit_score == 21.5 and row.risks == ["r"] and row.audit_log[-1] == "Semantic rerank added 1.50 points."


def test_limit_comes_before_the_filter(spark):
    rows = spark.range(6).select(*[F.lit(None).cast("string").alias(c) for c in reports.CSV_COLUMNS if c not in ("job_uid", "tier", "matched_signals", "detected_blockers")], F.col("id").cast("string").alias("job_uid"), F.when(F.col("id") % 2 == 0, "C").otherwise("B").alias("tier"), F.array(F.lit("x"), F.lit("y")).alias("matched_signals"), F.array().cast("array<string>").alias("detected_blockers"), (F.lit(T0) + F.make_interval(hours=F.col("id").cast("int"))).alias("updated_at"))
    got = reports.shortlist(rows, 3)
    assert {r.job_uid for r in got.collect()} == {"5", "3"} and got.first().matched_signals == "x, y"
    assert {r.job_uid for r in reports.recent(rows, 2, "C").collect()} == {"4", "2"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("TakeOrderedAndProject")


def test_two_places(spark):
    values = [0.125, 2.675, 9.5, 0.0, -8.0, 10.0, 1.005, 14.25, 0.375, 0.29, 1.115, -2.675, 17.335, 123456.785]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(reports.two_places(F.col("x")).alias("v")).collect()]
    assert got == [str(round(v, 2)) for v in values]


def test_digest_keeps_k_rows_before_the_exchange(spark):
    plan = reports.digest_rows(spark.createDataFrame([], "job_uid string, tier string, fit_score double, title string, company string, matched_signals array<string>, fit_reason string, risks array<string>, apply_url string, original_url string, last_seen_at timestamp"))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, tmp_path):
    table = records(spark, {"title": "title a", "source_job_id": "1"}, {"title": "b", "source_job_id": "2"})
    table.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        start(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")), store, RULES, PROFILES, str(tmp_path / "cp")).awaitTermination()
    assert {(r.title, r.tier) for r in store.state().collect()} == {("title a", "A"), ("b", "C")} and store.events().count() == 2


def test_identity_can_be_replaced_and_rows_keep_the_order_of_sources(spark, tmp_path):
    from dataclasses import replace

    from siftline.operators.identity import identity

    pages = landed(spark.createDataFrame([("https://e.org/c", CARDS)], "url string, html string"))
    twice = replace(app(tmp_path / "s"), sources=[Source(k, "html", True, PARAMS | {"url": "https://e.org/c"}) for k in ("first", "second")])
    engine = Engine(spark, twice, pages, identify=lambda records: identity(records).withColumn("job_uid", F.lit("one")))
    assert engine.run(T0) == {"ingested": 4, "persisted": 4, "alerts": 0}
    row = engine.store.state().collect()
    assert [(r.job_uid, r.source, r.title) for r in row] == [("one", "second", "")]


def test_commands(spark, tmp_path, capsys):
    import json

    import yaml

    from siftline.cli import main

    spark.createDataFrame([("https://e.org/c", CARDS)], "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "rules.yaml").write_text("positive_title_signals: [title]")
    (tmp_path / "search_profiles.yaml").write_text("title_weights: {title: 20}")
    sources = [{"name": "cards", "type": "html", "params": PARAMS | {"url": "https://e.org/c"}}]
    (tmp_path / "settings.yaml").write_text(yaml.safe_dump({"store": str(tmp_path / "store"), "log_level": "error", "sources": sources}))
    run = lambda *a: (main(["--config", str(tmp_path / "settings.yaml"), "--pages", str(tmp_path / "pages"), *a]), capsys.readouterr().out.strip())
    code, said = run("run")
    assert code == 0 and json.loads(said) == {"ingested": 2, "persisted": 2, "alerts": 0}
    assert run("digest", "--hours", "24")[1].splitlines()[2] == "A-tier roles (1)"
    assert run("export-csv", "--output", str(tmp_path / "o.csv"))[1] == str(tmp_path / "o.csv") and "Acme" in (tmp_path / "o.csv").read_text()
    assert run("render-html", "--output", str(tmp_path / "o.html"), "--limit", "1")[0] == 0 and (tmp_path / "o.html").read_text().count("<tr>") == 2
    assert run("feedback", "u", "good")[1] == "feedback for u: good"
    assert Store(spark, str(tmp_path / "store")).feedback().first().label == "good"
