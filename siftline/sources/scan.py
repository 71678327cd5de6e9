"""Sources: landed HTML pages to records, by heading blocks, by selectors, or by a watchlist of companies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce
from typing import Any
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siftline.config import Source, read_yaml
from siftline.schema import RECORD
from siftline.sources.html import Node, parse

#: Places looked for in a block's text, in order.
PLACES = ("worldwide", "united states", "canada", "argentina", "panama", "brazil", "europe", "americas", "latin america")
SPACE = re.compile(r"\s+")
Pages = Callable[[list[str]], DataFrame]


def compact(text: str | None) -> str:
    return SPACE.sub(" ", text or "").strip()


def place(text: str) -> str | None:
    folded = text.casefold()
    return next((p.title() for p in PLACES if p in folded), None)


def salary(text: str) -> str | None:
    return " ".join([w for w in text.split() if "$" in w][:4]) or None


def heading_blocks(url: str, html: str | None, *, heading: str = "h2", separator: str = "·") -> Iterator[dict[str, Any]]:
    """A record for each heading with a link: what follows it, up to the next heading, is its block."""
    for head in parse(html).select(heading):
        link = head.select_one("a[href]")
        title = compact(link.text()) if link else ""
        if not title:
            continue
        block: list[Node] = []
        for node in head.siblings_after():
            if node.name == heading:
                break
            block.append(node)
        texts = [compact(n.text()) for n in block]
        whole = compact(" ".join(texts))
        target = urljoin(url, link.attrs["href"])
        apply_to = next((n.attrs["href"] for n, t in zip(block, texts, strict=True) if n.name == "a" and n.attrs.get("href") and "apply" in t.lower()), None)
        described = next((t for n, t in zip(block, texts, strict=True) if n.name == "p"), None)
        named = next((compact(t.split(separator, 1)[0]) for t in texts if separator in t), None)
        text = whole if described is None else described
        yield {
            "company": named or "Unknown",
            "title": title,
            "original_url": target,
            "apply_url": urljoin(url, apply_to) if apply_to else target,
            "source_job_id": link.attrs["href"],
            "location_text": place(whole),
            "remote_text": "Remote",
            "employment_type": "Full Time" if "full time" in whole.casefold() else None,
            "salary_text": salary(whole),
            "timezone_text": None,
            "description_raw": text,
            "description_clean": text,
            "source_metadata": [("listing_url", url)],
        }


#: Record field and the parameter that names its selector.
OPTIONAL = {"location_text": "location_selector", "remote_text": "remote_selector", "salary_text": "salary_selector", "employment_type": "employment_type_selector", "timezone_text": "timezone_selector"}


def cards(url: str, html: str | None, params: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """A record for each element of the listing selector that has a title and a company; entities may name the references to resolve."""

    def read(card: Node, name: str) -> str | None:
        node = card.select_one(params[name]) if params.get(name) else None
        return (compact(node.text()) or None) if node else None

    for card in parse(html, params.get("entities")).select(params["listing_selector"]):
        head, company = card.select_one(params["title_selector"]), card.select_one(params["company_selector"])
        if head is None or company is None:
            continue
        target = urljoin(url, head.attrs.get("href") or "")
        button = card.select_one(params["apply_selector"]) if params.get("apply_selector") else None
        text = read(card, "description_selector") or ""
        yield {
            "company": compact(company.text()),
            "title": compact(head.text()),
            "original_url": target,
            "apply_url": urljoin(url, button.attrs["href"]) if button and button.attrs.get("href") else target,
            "source_job_id": card.attrs.get(params.get("job_id_attribute") or "data-job-id"),
            **{field: read(card, name) for field, name in OPTIONAL.items()},
            "description_raw": text,
            "description_clean": text,
            "source_metadata": [("source_url", url)],
        }


#: Records to an Arrow batch.
BATCH_RECORDS = 1000


def _records(pages: DataFrame, name: str, run_ts: datetime, read: Callable[[str, str | None], Iterator[dict]]) -> DataFrame:
    """The records of (url, html) pages, in Arrow batches of records; a record may name a source of its own."""
    columns = [f.name for f in RECORD.fields if f.name not in ("posted_at", "status")]
    schema = ", ".join(f"{f.name} {'array<struct<k:string,v:string>>' if f.name == 'source_metadata' else f.dataType.simpleString()}" for f in RECORD.fields if f.name in columns)

    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found += [{"source": name} | r | {"source_metadata": [{"k": k, "v": v} for k, v in r["source_metadata"]]} for r in read(url or "", html)]
                if len(found) >= BATCH_RECORDS:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    out = pages.select("url", "html").mapInArrow(run, schema)
    out = out.withColumn("source_metadata", F.map_from_entries("source_metadata"))
    return out.select(*[{"posted_at": F.lit(run_ts).cast("timestamp"), "status": F.lit("open")}.get(f.name, F.col(f.name)).alias(f.name) for f in RECORD.fields])


def scan_headings(pages: DataFrame, source: Source, run_ts: datetime) -> DataFrame:
    params = source.params
    options = {"heading": params.get("heading", "h2"), "separator": params.get("separator", "·")}
    return _records(pages, source.name, run_ts, lambda url, html: heading_blocks(url, html, **options))


def scan_cards(pages: DataFrame, source: Source, run_ts: datetime) -> DataFrame:
    params = dict(source.params)
    return _records(pages, source.name, run_ts, lambda url, html: cards(url, html, params))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def read_headings(spark: SparkSession, source: Source, pages: Pages, run_ts: datetime) -> DataFrame:
    urls = source.params.get("search_urls") or []
    return scan_headings(pages(urls), source, run_ts) if urls else empty_records(spark)


def read_cards(spark: SparkSession, source: Source, pages: Pages, run_ts: datetime) -> DataFrame:
    return scan_cards(pages([source.params["url"]]), source, run_ts)


#: What a company of a watchlist may name of a selector scan's parameters.
FORWARDED = ("listing_selector", "title_selector", "description_selector", "apply_selector", "location_selector", "salary_selector", "employment_type_selector", "timezone_selector", "job_id_attribute")


def scan_watchlist(pages: Pages, source: Source, companies: list[dict[str, Any]], run_ts: datetime) -> DataFrame:
    """The selector scans of all enabled companies in one pass over their pages; the company's name and bucket replace what a page says."""
    wanted: dict[str, list[dict[str, Any]]] = {}
    for item in companies:
        if item.get("enabled", True):
            wanted.setdefault(item["careers_url"], []).append(item)

    def read(url: str, html: str | None) -> Iterator[dict[str, Any]]:
        for item in wanted.get(url, []):
            params = {k: item[k] for k in FORWARDED if item.get(k)} | {"company_selector": item.get("company_selector") or item["title_selector"]}
            more = {"source": f"{source.name}:{item['name']}", "company": item["name"]}
            for found in cards(url, html, params):
                yield found | more | {"source_metadata": [*found["source_metadata"], ("watchlist_bucket", str(item.get("bucket", "core")))]}

    return _records(pages(list(wanted)), source.name, run_ts, read)


def read_watchlist(spark: SparkSession, source: Source, pages: Pages, run_ts: datetime) -> DataFrame:
    companies = read_yaml(source.params["watchlist_path"]).get("companies") or []
    return scan_watchlist(pages, source, companies, run_ts) if any(c.get("enabled", True) for c in companies) else empty_records(spark)


def union(parts: list[DataFrame]) -> DataFrame:
    """A bag union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


Reader = Callable[[SparkSession, Source, Pages, datetime], DataFrame]
READERS: dict[str, Reader] = {"dailyremote": read_headings, "html": read_cards, "watchlist": read_watchlist}


def register(kind: str, reader: Reader) -> None:
    """Adds a kind of source."""
    READERS[kind] = reader


def records_of(spark: SparkSession, source: Source, pages: Pages, run_ts: datetime) -> DataFrame:
    if source.type not in READERS:
        raise ValueError(f"Unsupported source adapter type: {source.type}")
    return READERS[source.type](spark, source, pages, run_ts)


def landed(table: DataFrame) -> Pages:
    """Pages from a landed table (url, html): the usual source, and the one that scales."""
    return lambda urls: table.where(F.col("url").isin(list(urls))).select("url", "html")


def json_object(text: str) -> dict[str, Any]:
    """A fetched JSON document, which must be an object."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("expected a JSON object")
    return data


def fetched(spark: SparkSession, *, timeout: float = 20.0) -> Pages:
    """Pages fetched by tasks: retries 3, backoff 0.5 on 429 and 5xx; an HTTP error fails the source."""

    def pages(urls: list[str]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import requests
            from requests.adapters import HTTPAdapter
            from urllib3.util.retry import Retry

            with requests.Session() as session:
                retry = Retry(total=3, connect=3, read=3, backoff_factor=0.5, status_forcelist=(429, 500, 502, 503, 504), allowed_methods=("GET",))
                for scheme in ("http://", "https://"):
                    session.mount(scheme, HTTPAdapter(max_retries=retry))
                for frame in frames:
                    html = []
                    for url in frame["url"]:
                        answer = session.get(url, timeout=timeout)
                        answer.raise_for_status()
                        html.append(answer.text)
                    yield frame.assign(html=html)

        return spark.createDataFrame([(u,) for u in urls], "url string").mapInPandas(run, "url string, html string")

    return pages
