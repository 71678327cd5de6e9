from datetime import datetime

import pytest

from siftline.cli import parser
from siftline.config import Rules, Source, expand, load, read_yaml
from siftline.sources.html import parse
from siftline.sources.scan import cards, empty_records, fetched, heading_blocks, json_object, landed, records_of, register, union
from siftline.sources.store import Store
from tests.records import records

T0 = datetime(2024, 1, 1)
LISTING = """<html><body><script>var x = "<h2>no</h2>";</script><!-- c -->
<h2><a href="/job/1">  Lead   Analyst </a></h2><div>Acme &amp; Co · Berlin</div><p>First <b>line</p><p>Second, full time $10 - $20k US$ $1 $2</p><a href="apply/1">Apply now</a>
<h2>No link</h2><p>skip</p>
<h2><a href="https://o.org/2">Two</a></h2><span>Latin America, worldwide</span></body></html>"""
CARDS = """<article class="job-card big" data-job-id="7"><a class="job-title" href="/a?x=1">Title</a><span class="company-name">Acme</span><p class="job-summary">Text  <br>here</p><span class="location"> </span><span class="salary">$5</span></article>
<article class="job-card"><a class="job-title"></a><span class="company-name">NoHref</span></article>
<article class="job-card"><span class="company-name">No title</span></article><article class="other"><a class="job-title" href="z">z</a><span class="company-name">q</span></article>"""
PARAMS = {"listing_selector": "article.job-card", "title_selector": "a.job-title", "company_selector": "span.company-name", "apply_selector": "a.job-title", "description_selector": "p.job-summary", "location_selector": "span.location", "salary_selector": "span.salary"}


def test_tree_and_selectors():
    root = parse('<div id=a class="x y"><p>one<p data-k="v,w">two</p></p></div><ul><li><a href=u>L</a></li></ul></b>tail')
    assert [n.text() for n in root.select('p[data-k="v,w"], li a[href]')] == ["two", "L"]
    assert root.select_one("div.x.y#a > p").text() == "one two" and root.select("ul > a") == [] and root.select_one("ul a").attrs == {"href": "u"}
    assert root.select("[data-k^='v']") and not root.select("p.q") and parse(None).text() == ""
    with pytest.raises(ValueError):
        root.select("p:first-child")


def test_references_that_are_named_and_closed():
    text = "a&amp;b &amp &lt;p&gt; &copy; &am &amp;lt; &"
    assert parse(f"<p>{text}</p>").text() == "a&b & <p> © &am &lt; &"
    assert parse(f"<p>{text}</p>", ("lt", "gt", "quot", "amp")).text() == "a&b &amp <p> &copy; &am &lt; &"
    assert parse(f"<p>{text}</p>", ()).text() == text and parse('<a href="?a=1&amp;b&c">', ("amp",)).select_one("a").attrs == {"href": "?a=1&b&c"}


def test_heading_blocks():
    a, b = heading_blocks("https://e.org/list/", LISTING)
    assert (a["title"], a["company"], a["original_url"], a["apply_url"], a["source_job_id"]) == ("Lead Analyst", "Acme & Co", "https://e.org/job/1", "https://e.org/list/apply/1", "/job/1")
    assert a["description_clean"] == "First line" and a["employment_type"] == "Full Time" and a["salary_text"] == "$10 $20k US$ $1" and a["location_text"] is None
    assert (b["company"], b["location_text"], b["apply_url"], b["description_raw"]) == ("Unknown", "Worldwide", "https://o.org/2", "Latin America, worldwide")


def test_cards():
    a, b = cards("https://e.org/c", CARDS, PARAMS)
    assert (a["title"], a["company"], a["source_job_id"], a["original_url"], a["apply_url"], a["description_clean"], a["location_text"], a["salary_text"]) == ("Title", "Acme", "7", "https://e.org/a?x=1", "https://e.org/a?x=1", "Text here", None, "$5")
    assert (b["title"], b["original_url"], b["description_raw"], b["source_job_id"]) == ("", "https://e.org/c", "", None)


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([("https://e.org/list/", LISTING), ("https://e.org/c", CARDS), ("https://e.org/null", None)], "url string, html string")
    got = records_of(spark, Source("l", "dailyremote", True, {"search_urls": ["https://e.org/list/", "https://e.org/null"]}), landed(pages), T0).collect()
    assert [r.title for r in got] == ["Lead Analyst", "Two"] and got[0].source == "l" and got[0].posted_at == T0 and got[0].source_metadata == {"listing_url": "https://e.org/list/"}
    (tmp_path / "w.yaml").write_text("companies:\n- {name: Acme, careers_url: 'https://e.org/c', bucket: top, %s}\n- {name: Off, enabled: false, careers_url: x, listing_selector: a, title_selector: a}\n" % ", ".join(f"{k}: '{v}'" for k, v in PARAMS.items()))
    got = records_of(spark, Source("w", "watchlist", True, {"watchlist_path": str(tmp_path / "w.yaml")}), landed(pages), T0).collect()
    assert [(r.source, r.company, r.source_metadata["watchlist_bucket"]) for r in got] == [("w:Acme", "Acme", "top")] * 2
    assert records_of(spark, Source("n", "dailyremote"), landed(pages), T0).count() == 0
    with pytest.raises(ValueError, match="Unsupported source adapter type: x"):
        records_of(spark, Source("n", "x"), landed(pages), T0)
    register("mine", lambda spark, source, pages, ts: empty_records(spark))
    assert union([records_of(spark, Source("n", "mine"), landed(pages), T0), records(spark, {"title": "t"})]).count() == 1
    assert json_object('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError):
        json_object("[1]")
    assert fetched(spark)([]).columns == ["url", "html"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("A_B", "1")
    assert expand({"${A_B}": ["${A_B}-${NONE_X:-d}", "${NONE_X}", 3]}) == {"${A_B}": ["1-d", "", 3]}
    (tmp_path / "c").mkdir()
    (tmp_path / ".env").write_text("FROM_FILE='f'\n# no\n")
    monkeypatch.delenv("FROM_FILE", raising=False)
    for name, text in (("rules.yaml", "closed_phrases: [gone]\n"), ("search_profiles.yaml", "threshold_a: 12\ntitle_weights: {a: 2}\n"), ("settings.yaml", "store: ${FROM_FILE}\nsources:\n- {name: n, type: html, enabled: false}\ntelegram: {enabled: true}\n")):
        (tmp_path / "c" / name).write_text(text)
    app = load(tmp_path / "c" / "settings.yaml")
    assert app.store == "f" and app.rules == Rules(closed_phrases=["gone"]) and app.profiles.threshold_a == 12.0 and app.profiles.threshold_b == 8.0 and not app.sources[0].enabled and app.chat.enabled
    (tmp_path / "c" / "llm_prompt.txt").write_text("{title}")
    (tmp_path / "c" / "settings.yaml").write_text("llm: {enabled: true, prompt_path: c/llm_prompt.txt}\n")
    assert load(tmp_path / "c" / "settings.yaml").rerank.prompt_path == str(tmp_path / "c" / "llm_prompt.txt")
    (tmp_path / "bad.yaml").write_text("- 1\n")
    (tmp_path / "empty.yaml").write_text("")
    assert read_yaml(tmp_path / "empty.yaml") == {}
    with pytest.raises(ValueError):
        read_yaml(tmp_path / "bad.yaml")


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.state().count() == 0 and store.feedback().count() == 0
    store.commit(store.state(), store.events())
    assert store.commit(store.state(), store.events()) == 2 and store.versions() == [1, 2]
    store.add_feedback("u", "good", "", T0)
    store.add_feedback("v", "bad", "n", T0)
    assert sorted(tuple(r) for r in store.feedback().collect()) == [("u", "good", "", T0), ("v", "bad", "n", T0)]


def test_commands():
    a = parser().parse_args(["--config", "c", "render-html", "--limit", "5"])
    assert (a.command, a.limit, a.output) == ("render-html", 5, "data/review.html")
    assert parser().parse_args(["digest"]).hours == 24 and parser().parse_args(["feedback", "u", "l", "--note", "n"]).note == "n"
