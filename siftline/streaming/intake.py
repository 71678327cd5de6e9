"""Continuous intake: each micro-batch of records goes through the same upsert as a batch run."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.config import Profiles, Rules
from siftline.operators.identity import identity
from siftline.operators.state import upsert
from siftline.plans.pipeline import evaluate
from siftline.sources.staging import written
from siftline.sources.store import Store


def start(records: DataFrame, store: Store, rules: Rules, profiles: Profiles, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream. A batch is one version of the store; one that is run again after a failure changes nothing twice,
    as equal content gives no event."""

    def intake(batch: DataFrame, _: int) -> None:
        arrived = batch.withColumn("seq", F.monotonically_increasing_id())
        decided = written(identity(evaluate(arrived, rules, profiles)))  # evaluated once for state and events
        _, state, events = upsert(decided, store.state(), datetime.now(timezone.utc))
        store.commit(state, events)

    return records.writeStream.foreachBatch(intake).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
