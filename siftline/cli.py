"""Commands: run, digest, export-csv, render-html, feedback."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from siftline.config import load
from siftline.plans.pipeline import Engine
from siftline.sources.scan import fetched, landed


class JsonLines(logging.Formatter):
    """One JSON object to a line."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": datetime.now(timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline")
    p.add_argument("--config", default="config/settings.yaml")
    p.add_argument("--pages", help="a Parquet table of landed pages (url, html); without it pages are fetched")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("run")
    commands.add_parser("digest").add_argument("--hours", type=int, default=24)
    commands.add_parser("export-csv").add_argument("--output", default="data/shortlisted_jobs.csv")
    html = commands.add_parser("render-html")
    html.add_argument("--output", default="data/review.html")
    html.add_argument("--limit", type=int, default=100)
    feedback = commands.add_parser("feedback")
    feedback.add_argument("uid")
    feedback.add_argument("label")
    feedback.add_argument("--note", default="")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    app = load(a.config)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    logging.basicConfig(level=app.log_level.upper(), handlers=[handler], force=True)
    spark = SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, app, landed(spark.read.parquet(a.pages)) if a.pages else fetched(spark))
    if a.command == "run":
        print(json.dumps(engine.run()))
    elif a.command == "digest":
        print(engine.digest(a.hours))
    elif a.command == "export-csv":
        print(engine.export_csv(a.output))
    elif a.command == "render-html":
        print(engine.render_html(a.output, a.limit))
    else:
        engine.feedback(a.uid, a.label, a.note)
        print(f"feedback for {a.uid}: {a.label}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
