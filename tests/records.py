"""Records for tests: the schema's columns with defaults."""

from __future__ import annotations

from siftline.schema import RECORD

DEFAULTS = {"source": "s", "company": "Example", "title": "", "original_url": "", "description_raw": "", "description_clean": "", "status": "open"}


def records(spark, *rows):
    filled = [DEFAULTS | {k: v for k, v in r.items()} for r in rows]
    for r in filled:
        r.setdefault("source_metadata", {})
        if r["description_clean"] and not r["description_raw"]:
            r["description_raw"] = r["description_clean"]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RECORD.fields) for r in filled], RECORD)
