"""Sources and sinks over captured shapes with made-up content, versioned tables, streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators.merge import upsert
from tidewell.sources import boards, files, html
from tidewell.sources.registry import register
from tidewell.streaming.upserts import first_sightings, fresh_only, stream_into

CARD = """<li><div data-entity-urn="urn:li:jobPosting:{n}"><a href="https://x.example/job/name-{n}?a=b"></a><h3 class="base-search-card__title"> Tram <b>Welder</b> </h3>
<h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Fern Creek (Hybrid)</span><time class="job-search-card__listdate" datetime="2026-01-02">x</time><ul><li>in</li></ul></div></li>"""


def test_nested_elements():
    assert html.cards("<ul><li>a<ul><li>b</li></ul></li><li>c</li><li>open") == ["<li>a<ul><li>b</li></ul></li>", "<li>c</li>"]
    assert html.cards(None) == [] and html.marked_div(None, "x") is None and html.marked_div("<div id=x>never", "x") is None
    assert html.marked_div('<div><div data-m="1">a<div>b</div>c</div>d</div>', 'data-m="1"') == "a<div>b</div>c"


def test_json_inside_pages():
    ld = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"a":[{"@type":"JobPosting","title":"T"}]}</script>'
    assert json.loads(html.posting_ld(ld))["title"] == "T" and html.posting_ld("x") is None
    data = {"list": [{"id": "1", "content": "y" * 300 + " "}, {"id": "2", "content": "z" * 300 + " "}]}
    page = f'<script id="__NEXT_DATA__">{json.dumps(data)}</script>'
    assert html.embedded_description(page, "2")[0] == "z" and html.embedded_description(page, "9")[0] == "y" and html.embedded_description(None, "1") is None


def test_json_pages(spark):
    item = lambda i, **more: {"id": str(i), "title": f"T{i}", "locations": [{"label": "Fern Creek"}], **more}
    pages = [
        ("q", 1, json.dumps({"totalCount": 5, "data": [item(1, companyName="Acme"), item(2, advertiser={"description": "Birch"})]})),
        ("q", 2, json.dumps({"totalCount": 5, "data": [item(3), {"id": "4"}]})),
        ("q", 3, json.dumps({"totalCount": 5, "data": [item(5, location="L")]})),
        ("q", 4, json.dumps({"totalCount": 5, "data": [item(6)]})),
        ("r", 1, json.dumps({"data": []})), ("s", 1, None),
    ]
    got = boards.json_postings(spark.createDataFrame(pages, "search string, page int, body string"), page_size=2).orderBy("page", "row").collect()
    assert [(r.source_id, r.company) for r in got] == [("1", "Acme"), ("2", "Birch"), ("3", "Unknown"), ("5", "Unknown")]


def test_cards_and_details(spark):
    pages = spark.createDataFrame([("q", 0, CARD.format(n=11) + CARD.format(n=12)), ("q", 25, CARD.format(n=13))], "search string, start int, html string")
    got = boards.card_postings(pages, page_size=3).collect()
    assert [(r.source_id, r.title, r.company, r.location_raw, r.posted_at_raw, r.remote_hint) for r in got] == [(str(n), "Tram Welder", "Acme", "Fern Creek (Hybrid)", "2026-01-02", True) for n in (11, 12)]
    detail = '<div data-automation="jobAdDetails"><p>Do it</p></div>{"isLinkOut": true}'
    rows = spark.createDataFrame([("u1", "1", 200, detail), ("u2", "2", 404, detail), ("u3", "3", 200, None)], "url string, source_id string, status int, html string")
    out = {r.url: r for r in boards.detail_fields(rows).collect()}
    assert (out["u1"].description, out["u1"].apply_method, out["u2"].description, out["u3"].description) == ("Do it", "external", None, None)
    cards = spark.createDataFrame([("u1", None, "t"), ("u9", "own", "t")], "url string, description string, title string")
    assert {(r.url, r.description) for r in boards.enriched(cards, boards.detail_fields(rows)).collect()} == {("u1", "Do it"), ("u9", "own")}
    listed = '<h3 class="x criteria">Seniority <b>level</b></h3><span>Entry</span>'
    assert spark.createDataFrame([(listed,)], "h string").select(boards.criteria("h").alias("m")).first().m == {"seniority level": "Entry"}


def test_search_url(spark):
    url = spark.range(1).select(boards.search_url("https://x.example/s", {"keywords": F.lit("a b&c"), "page": F.lit(2), "where": F.lit("")}).alias("u")).first().u
    assert url == "https://x.example/s?keywords=a+b%26c&page=2"


def test_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"id": "1", "verdict": "good"}]')
    bad.write_text('[{"id": "1", "verdict": "good"}, {"id": "", "verdict": "so-so"}]')
    rules = {"id": None, "verdict": ["good", "bad"]}
    rows, faults = files.read_verdicts(spark, str(good), "id string, verdict string", rules)
    assert rows.count() == 1 and faults.count() == 0
    rows, faults = files.read_verdicts(spark, str(bad), "id string, verdict string", rules)
    assert rows.count() == 0 and faults.first().fault == "id is missing; verdict is not allowed: so-so"
    (tmp_path / "a.csv").write_text("ID,url,Applied\n1,,Yes\n,u2,no\n9,u2,true\n")
    jobs = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u2")], "id string, url string")
    marks = files.read_applied(spark, str(tmp_path / "a.csv"))
    assert {tuple(r) for r in files.applied_to(marks, jobs).collect()} == {("1", True, True), ("3", False, True), ("9", True, False)}
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert [r.id for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": [1]}, "d": 2}')
    (tmp_path / "local.json").write_text('{"a": {"c": [2]}}')
    assert files.read_settings(str(tmp_path / "base.json"), str(tmp_path / "local.json")) == {"a": {"b": 1, "c": [2]}, "d": 2}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi", you', True, ["a", "b"]), (None, None, None)], "t string, b boolean, l array<string>")
    ready = files.csv_ready(rows, {c: F.col(c) for c in rows.columns})
    files.write_csv(ready, str(tmp_path / "out"))
    back = spark.read.options(**files.CSV_OPTIONS).csv(str(tmp_path / "out"))
    assert {tuple(x or "" for x in r) for r in back.collect()} == {('say "hi", you', "yes", "a b"), ("", "no", "")}


def test_versions(spark, tmp_path):
    table = files.VersionedTable(spark, str(tmp_path / "t"), "id string")
    assert table.version() == 0 and table.read().count() == 0
    table.write(spark.createDataFrame([("a",)], "id string"))
    table.write(table.read().unionByName(spark.createDataFrame([("b",)], "id string")))
    (tmp_path / "t" / "v=3").mkdir()  # begun, never finished
    assert table.version() == 2 and table.read().count() == 2 and table.read(1).count() == 1


def test_pages_source(spark, tmp_path):
    (tmp_path / "q-x-1.json").write_text("{}")
    (tmp_path / "q-x-2.json").write_text("{}")
    register(spark, "posting_pages")
    got = spark.read.format("posting_pages").option("path", str(tmp_path)).load()
    assert {(r.search, r.page) for r in got.collect()} == {("q-x", 1), ("q-x", 2)}
    with pytest.raises(KeyError):
        register(spark, "nothing")


def test_stream_is_batch(spark, tmp_path):
    schema = "id string, t string, s int"
    parts = [[("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "2", 2)], [("b", None, 3)]]
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    state = files.VersionedTable(spark, str(tmp_path / "state"), schema + ", batch_id long")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    fold = lambda before, batch: upsert(before, batch.select(*before.columns), "id", keep=("s",))
    for _ in range(2):  # the second start finds nothing new
        stream_into(stream(), state, fold, str(tmp_path / "c")).awaitTermination(60)
    want = spark.createDataFrame([], schema)
    for part in parts:
        want = upsert(want, spark.createDataFrame(part, schema), "id", keep=("s",))
    assert {r.id for r in state.read().collect()} == {r.id for r in want.collect()} == {"a", "b", "c"}
    assert state.version() == 3


def test_first_sightings(spark, tmp_path):
    t = datetime(2026, 1, 1)
    spark.createDataFrame([("a", t, t), ("a", t + timedelta(hours=1), t), ("b", t, t + timedelta(days=40))], "id string, at timestamp, seen timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, at timestamp, seen timestamp").parquet(str(tmp_path / "in"))
    query = first_sightings(fresh_only(stream, "at", "seen", 30), "id", "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.id for r in spark.sql("select id from firsts").collect()] == ["a"]
