"""The run: scan, decide, score, rerank, tier, identify, upsert, commit, alert."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import App, Profiles, Rules
from siftline.operators.identity import identity
from siftline.operators.rules import apply_rules
from siftline.operators.scoring import final_tier, rerank, score, skip_rerank, without_key
from siftline.operators.state import acknowledged, upsert
from siftline.plans import reports
from siftline.sources.scan import Pages, records_of, union
from siftline.sources.staging import written
from siftline.sources.store import Store

log = logging.getLogger(__name__)
#: Rows are numbered by source, then by partition (up to 2**20 of them) and place in it, in 63 bits.
MAX_SOURCES, SOURCE_ROWS = 2**10, 2**53
Send = Callable[[str], bool]
Ask = Callable[[pd.Series], pd.Series]


def evaluate(records: DataFrame, rules: Rules, profiles: Profiles, reranked: Callable[[DataFrame], DataFrame] = skip_rerank) -> DataFrame:
    """Records with their decision, score and tier. Narrow: no shuffle."""
    return final_tier(reranked(score(apply_rules(records, rules), profiles)), profiles)


def chat_sender(app: App) -> Send | None:
    """Posts to the configured chat, or None where it is off or lacks credentials."""
    token, chat = os.environ.get(app.chat.bot_token_env), os.environ.get(app.chat.chat_id_env)
    if not (app.chat.enabled and token and chat):
        return None

    def send(text: str) -> bool:
        import requests

        answer = requests.post(f"https://api.telegram.org/bot{token}/sendMessage", json={"chat_id": chat, "text": text, "disable_web_page_preview": True}, timeout=20)
        answer.raise_for_status()
        return True

    return send


def model_asker(app: App, *, url: str = "https://api.openai.com/v1/responses", timeout: float = 60.0) -> Ask | None:
    """Asks a hosted model, prompt by prompt; None where the key is missing."""
    key, model = os.environ.get(app.rerank.api_key_env), app.rerank.model
    if not key:
        return None

    def ask(prompts: pd.Series) -> pd.Series:
        import requests

        def one(prompt: str) -> str:
            answer = requests.post(url, headers={"Authorization": f"Bearer {key}"}, json={"model": model, "input": prompt}, timeout=timeout)
            answer.raise_for_status()
            said = [part["text"] for item in answer.json()["output"] for part in item.get("content") or [] if part.get("type") == "output_text"]
            return "".join(said)

        return prompts.map(one)

    return ask


class Engine:
    """The five commands over one store."""

    def __init__(self, spark: SparkSession, app: App, pages: Pages, *, send: Send | None = None, ask: Ask | None = None, identify: Callable[[DataFrame], DataFrame] = identity) -> None:
        self.spark, self.app, self.pages, self.identify = spark, app, pages, identify
        self.ask = ask or (model_asker(app) if app.rerank.enabled else None)
        self.send = send or chat_sender(app)
        self.store = Store(spark, app.store)

    def _reranked(self, records: DataFrame) -> DataFrame:
        if not self.app.rerank.enabled:
            return skip_rerank(records)
        if self.ask is None:
            return without_key(records)
        template = Path(self.app.rerank.prompt_path).read_text(encoding="utf-8")
        return rerank(records, self.ask, template=template, max_chars=self.app.rerank.max_description_chars)

    def run(self, now: datetime | None = None) -> dict[str, int]:
        """One intake. A source that fails is reported and left out, and if all fail so does the run; alerts go out after the commit and are then acknowledged."""
        now = now or datetime.now(timezone.utc)
        parts, failed = [], []
        enabled = [s for s in self.app.sources if s.enabled]
        if len(enabled) > MAX_SOURCES:
            raise ValueError(f"{len(enabled)} sources, at most {MAX_SOURCES}")
        for k, source in enumerate(enabled):
            try:
                # written: a fetch that fails does so here and takes only its source along, and none is fetched twice
                numbered = records_of(self.spark, source, self.pages, now).withColumn("seq", F.lit(k * SOURCE_ROWS) + F.monotonically_increasing_id())
                parts.append(written(numbered))
            except Exception:
                log.exception("source %s failed", source.name)
                failed.append(source.name)
        if failed and not parts:
            raise RuntimeError(f"no source could be read: {', '.join(failed)}")
        if not parts:
            return {"ingested": 0, "persisted": 0, "alerts": 0}
        # evaluated once: results, state, events and alerts all read the same rows
        decided = written(self.identify(evaluate(union(parts), self.app.rules, self.app.profiles, self._reranked)))
        sends = self.send is not None and self.app.chat.instant_a_tier
        stored = self.store.state()
        results, _, events = upsert(decided, stored, now, sends=sends)
        _, state, _ = upsert(decided, stored, now, sends=False)  # what is due stays due until it is sent
        ingested = decided.count()
        alerts = None
        if sends:
            due = results.where("should_alert").select("job_uid", "seq")
            alerts = written(decided.join(due, ["job_uid", "seq"]).select("job_uid", "tier", "seq", reports.instant_alert().alias("message")))
        self.store.commit(state, events)
        sent = self._alert(alerts, now) if alerts is not None else 0
        return {"ingested": ingested, "persisted": ingested, "alerts": sent}

    def _alert(self, alerts: DataFrame, now: datetime) -> int:
        """Sends alerts in their order and commits an acknowledgement for those that went out; the others stay due."""
        sent: list[tuple[str, int]] = []  # names only: messages pass by one at a time
        for r in alerts.orderBy("seq").toLocalIterator():
            try:
                if self.send(r.message):
                    sent.append((r.job_uid, r.seq))
            except Exception:
                log.exception("alert for %s failed", r.job_uid)
        if sent:
            done = self.spark.createDataFrame(sent, "job_uid string, seq long")
            named = done.select("job_uid", F.lit("A").alias("_sent")).distinct()
            state = self.store.state().join(named, "job_uid", "left").withColumn("last_alerted_tier", F.coalesce("_sent", "last_alerted_tier"))
            self.store.commit(state, acknowledged(alerts.join(done, ["job_uid", "seq"], "left_semi"), now, "telegram"))
        return len(sent)

    def digest(self, hours: int = reports.DIGEST_HOURS, now: datetime | None = None) -> str:
        text = reports.digest(self.store.state(), now or datetime.now(timezone.utc), hours=hours)
        if self.send is not None and self.app.chat.daily_digest_enabled:
            self.send(text)
        return text

    def export_csv(self, path: str) -> Path:
        return reports.write_csv(self.store.state(), path)

    def render_html(self, path: str, limit: int = reports.HTML_ROWS) -> Path:
        return reports.write_html(self.store.state(), path, limit)

    def feedback(self, uid: str, label: str, note: str = "", now: datetime | None = None) -> None:
        self.store.add_feedback(uid, label, note, now or datetime.now(timezone.utc))
