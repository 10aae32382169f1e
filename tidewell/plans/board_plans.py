"""Queries of sources, sinks and streams: captured pages with made-up content against what they say, and rows of the
posting tables written, read back and streamed."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.operators import writeback
from tidewell.operators.merge import upsert as fold_batch
from tidewell.plans import posting_plans as plans
from tidewell.plans.posting_plans import NOW, jobs, raw
from tidewell.session import scratch_path, table
from tidewell.sources import boards, files
from tidewell.streaming.upserts import first_sightings, fresh_only, stream_into

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pages of boards

_ITEMS = [
    {"id": 101, "title": " Tram Welder ", "companyName": "Acme", "locations": [{"label": "Fern Creek VIC"}], "salaryLabel": "$40 per hour", "workTypes": ["Full time"], "bulletPoints": ["a", "b"], "teaser": "t"},
    {"solMetadata": {"jobId": "102"}, "jobTitle": "Gas Nurse", "advertiser": {"description": "Birch"}, "area": "Nordhaven", "isRemote": True},
    {"id": "103"}, {"id": "104", "title": "Crane Editor", "workArrangements": "Hybrid (2 days)"},
]


def _json_pages(spark):
    body = lambda items, total: json.dumps({"totalCount": total, "data": items})
    rows = [("q", 1, body(_ITEMS[:2], 5)), ("q", 2, body(_ITEMS[2:], 5)), ("q", 3, body([], 5)), ("q", 4, body(_ITEMS[:1], 5)), ("r", 1, "no json"), ("s", 1, None)]
    return spark.createDataFrame(rows, "search string, page int, body string")


@query("""SELECT * FROM (VALUES ('101', 'Tram Welder', 'Acme', 'Fern Creek VIC', '$40 per hour', 'Full time', 't · a · b', false), ('102', 'Gas Nurse', 'Birch', 'Nordhaven', NULL, NULL, NULL, true),
  ('104', 'Crane Editor', 'Unknown', '', NULL, NULL, NULL, true)) v(source_id, title, company, location_raw, salary_raw, employment_type_raw, teaser, remote_hint)""")
def json_pages(spark, d):
    return boards.json_postings(_json_pages(spark), page_size=2).select("source_id", "title", "company", "location_raw", "salary_raw", "employment_type_raw", "teaser", "remote_hint")


_CARD = """<li><div data-entity-urn="urn:li:jobPosting:{n}"><a href="https://x.example/job/name-{n}?a=b"></a><h3 class="base-search-card__title"> Tram <b>Welder</b> </h3>
<h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Fern Creek (Hybrid)</span><time class="job-search-card__listdate" datetime="2026-01-02">x</time><ul><li>in</li></ul></div></li>"""


@query("""SELECT * FROM (VALUES ('11', 'https://x.example/job/name-11', 'Tram Welder', 'Acme', 'Fern Creek (Hybrid)', '2026-01-02', true), ('12', 'https://x.example/job/name-12', 'Tram Welder', 'Acme', 'Fern Creek (Hybrid)', '2026-01-02', true))
  v(source_id, url, title, company, location_raw, posted_at_raw, remote_hint)""")
def card_pages(spark, d):
    pages = spark.createDataFrame([("q", 0, _CARD.format(n=11) + _CARD.format(n=12)), ("q", 25, _CARD.format(n=13))], "search string, start int, html string")
    return boards.card_postings(pages, page_size=3).select("source_id", "url", "title", "company", "location_raw", "posted_at_raw", "remote_hint")


def _details(spark):
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "description": "<p>From data</p>", "employmentType": "CASUAL", "datePosted": "2026-02-03"}</script>'
    markup = '<div class="show-more-less-html__markup x"><p>Weld<div>trams</div></p></div><a data-x="public_jobs_apply-link-{}"></a><h3 class="criteria">Employment type</h3><span> Full-time </span>'
    rows = [
        ("u1", "1", 200, "<div data-automation='jobAdDetails'><p>Java<b>Script</b></p></div>{\"isLinkOut\": true}"), ("u2", "2", 404, "<div data-automation='jobAdDetails'>gone</div>"),
        ("u3", "3", 200, ld), ("u4", "4", 200, markup.format("offsite")), ("u5", "5", 200, markup.format("simple")), ("u6", "6", 200, None), ("u7", "7", 200, '{"isLinkOut": false}'),
    ]
    return spark.createDataFrame(rows, "url string, source_id string, status int, html string")


@query("""SELECT url, description, employment_type_raw, posted_at_raw, apply_method FROM (VALUES ('u1', 'JavaScript', NULL, NULL, 'external'), ('u2', NULL, NULL, NULL, NULL), ('u3', 'From data', 'CASUAL', '2026-02-03', NULL),
  ('u4', 'Weldtrams', 'Full-time', NULL, 'external'), ('u5', 'Weldtrams', 'Full-time', NULL, 'easy_apply'), ('u6', NULL, NULL, NULL, NULL), ('u7', NULL, NULL, NULL, 'quick_apply')) v(url, description, employment_type_raw, posted_at_raw, apply_method)""")
def detail_pages(spark, d):
    return boards.detail_fields(_details(spark))


@query("SELECT * FROM (VALUES ('u1', 'JavaScript', 'own'), ('u3', 'kept', 'x'), ('u9', NULL, 'y')) v(url, description, title)")
def enriched_rows(spark, d):
    rows = spark.createDataFrame([("u1", None, "own"), ("u3", "kept", "x"), ("u9", None, "y")], "url string, description string, title string")
    return boards.enriched(rows, boards.detail_fields(_details(spark)))


@query("SELECT run_id, concat('https://x.example/s?keywords=', replace(search_query, ' ', '+'), '&where=', replace(search_location, ' ', '+'), '&page=2') AS url FROM run_results")
def search_urls(spark, d):
    url = boards.search_url("https://x.example/s", {"keywords": F.col("search_query"), "where": F.col("search_location"), "page": F.lit(2), "sort": F.lit("")})
    return table(spark, d, "run_results").select("run_id", url.alias("url"))


@query("SELECT * FROM (VALUES (1, 'expired'), (2, 'open'), (3, 'unknown'), (4, 'open'), (5, 'expired'), (6, 'unknown')) v(n, verdict)")
def liveness_pages(spark, d):
    rows = [(1, "seek", '"isExpired": true'), (2, "seek", '"isExpired" : false'), (3, "seek", "nothing"), (4, "linkedin", '<a class="apply-button">'), (5, "linkedin", "No longer accepting applications"), (6, "other", '"isExpired": true')]
    return spark.createDataFrame(rows, "n int, source string, html string").select("n", P.liveness(F.col("source"), F.col("html")).alias("verdict"))


@query(f"""WITH p AS (SELECT id, CASE WHEN missed_runs > 2 THEN 404 WHEN missed_runs = 2 THEN 500 ELSE 200 END AS status, missed_runs = 1 AS gone FROM jobs)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN status IN (404, 410) THEN 'expired' WHEN status = 200 THEN CASE WHEN gone THEN 'expired' ELSE 'open' END ELSE 'unchecked' END AS verdict FROM p) GROUP BY 1""")
def check_counts(spark, d):
    """Listings by the verdict that a check writes back: gone pages and expired ones, open ones, pages that failed."""
    rows = jobs(spark, d).select("id", "missed_runs", F.lit(None).cast("timestamp").alias("checked_at"), F.lit(None).cast("timestamp").alias("expired_at"))
    status = F.when(F.col("missed_runs") > 2, 404).when(F.col("missed_runs") == 2, 500).otherwise(200)
    pages = rows.select("id", status.alias("status"), F.when(F.col("missed_runs") == 1, "expired").otherwise("open").alias("said"))
    done = writeback.mark_checked(rows, pages, "id", F.col("said"), F.lit(NOW).cast("timestamp"))
    verdict = F.when(F.col("expired_at").isNotNull(), "expired").when(F.col("checked_at").isNotNull(), "open").otherwise("unchecked")
    return done.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- files, versions, streams


@query("""WITH m AS (SELECT CASE WHEN id < '8' THEN id END AS id, url, closed AS applied FROM jobs),
u AS (SELECT url, max(id) AS url_id FROM jobs WHERE url IS NOT NULL GROUP BY 1)
SELECT coalesce(m.id, u.url_id) AS id, applied, coalesce(m.id, u.url_id) IS NOT NULL AS found FROM m LEFT JOIN u ON u.url = m.url""")
def applied_marks(spark, d):
    """Marks by id, or by url where they have none; they are written as a file and read back."""
    path = scratch_path(spark, "marks")
    marks = jobs(spark, d).select(F.when(F.col("id") < "8", F.col("id")).alias("id"), "url", F.when(F.col("closed"), "Yes").otherwise("no").alias("Applied"))
    files.write_csv(marks, path)
    return files.applied_to(files.read_applied(spark, path), jobs(spark, d))


@query("SELECT id FROM jobs WHERE closed")
def id_files(spark, d):
    path = scratch_path(spark, "ids")
    jobs(spark, d).filter("closed").select(F.concat(F.lit("  "), "id", F.lit(" "))).write.text(path)
    return files.read_ids(spark, path)


@query("SELECT id, pipeline_status AS verdict FROM jobs WHERE pipeline_status IN ('fit_good', 'fit_bad') AND coalesce(trim(company), '') <> ''")
def verdict_files(spark, d):
    path, schema = scratch_path(spark, "verdicts"), "id string, verdict string, company string"
    good = jobs(spark, d).filter(F.col("pipeline_status").isin("fit_good", "fit_bad") & (F.trim("company") != "")).select("id", F.col("pipeline_status").alias("verdict"), "company")
    files.write_json(good, path)
    rows, _ = files.read_verdicts(spark, path, schema, {"id": None, "verdict": ["fit_good", "fit_bad"], "company": None}, lines=True)
    return rows.select("id", "verdict")


@query("SELECT id, min(company) AS company, count(*) AS n FROM jobs GROUP BY 1")
def table_versions(spark, d):
    """A table written twice: the latest whole version is read."""
    store = files.VersionedTable(spark, scratch_path(spark, "versions"), "id string, company string, n long")
    rows = jobs(spark, d).groupBy("id").agg(F.min("company").alias("company"), F.count(F.lit(1)).alias("n"))
    store.write(rows.limit(0))
    store.write(rows)
    return store.read()


@query("""SELECT id, arg_max(title, batch_no) AS title, min(batch_no) AS first_batch FROM (
  SELECT id, batch_no, max(title) AS title FROM (SELECT *, sha1(concat(source, ':', source_id)) AS id FROM raw_jobs) GROUP BY 1, 2) WHERE title IS NOT NULL GROUP BY 1""")
def stream_state(spark, d):
    """Batches as a stream, each folded into a state of its own version: the same as all of them at once."""
    ids = raw(spark, d).select(P.make_id(F.col("source"), F.col("source_id")).alias("id"), "batch_no", "title")
    each = ids.groupBy("id", "batch_no").agg(F.max("title").alias("title")).filter("title is not null").select("id", "title", F.col("batch_no").alias("first_batch"))
    path, schema = scratch_path(spark, "stream"), "id string, title string, first_batch int"
    half = each.agg(F.max("first_batch")).first()[0] // 2
    for holds in (F.col("first_batch") <= half, F.col("first_batch") > half):
        each.filter(holds).coalesce(1).write.mode("append").parquet(f"{path}/in")
    state = files.VersionedTable(spark, f"{path}/state", schema + ", batch_id long")
    last = lambda rows: rows.groupBy("id").agg(F.max_by("title", "first_batch").alias("title"), F.min("first_batch").alias("first_batch"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream_into(stream, state, lambda before, batch: fold_batch(before, last(batch), "id", keep=("first_batch",)), f"{path}/c").awaitTermination()
    return state.read().select("id", "title", "first_batch")


@query("SELECT DISTINCT sha1(concat(source, ':', source_id)) AS id FROM raw_jobs WHERE scraped_at IS NOT NULL")
def stream_sightings(spark, d):
    """Each posting once, however often it comes within the time that state is kept for; late ones are counted too,
    for that time is longer than the table spans."""
    path = scratch_path(spark, "sightings")
    rows = raw(spark, d).select(P.make_id(F.col("source"), F.col("source_id")).alias("id"), "scraped_at", F.col("scraped_at").alias("seen"))
    rows.filter("scraped_at is not null").write.parquet(f"{path}/in")
    stream = fresh_only(spark.readStream.schema("id string, scraped_at timestamp, seen timestamp").parquet(f"{path}/in"), "scraped_at", "seen", 30)
    query = first_sightings(stream, "id", "scraped_at", "3650 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("id string").parquet(f"{path}/out")


# ---------------------------------------------------------------- checks and logs


@query(f"""WITH c AS (SELECT sha1(url) AS key, arg_max(id, {{'t': last_seen_at, 'i': id}}) AS body FROM jobs WHERE url IS NOT NULL AND epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last_seen_at) BETWEEN 0 AND 60 * 86400000000 GROUP BY 1)
SELECT a.url, sha1(a.url) AS key, c.body FROM (SELECT DISTINCT url FROM raw_jobs WHERE url IS NOT NULL) a LEFT JOIN c ON c.key = sha1(a.url)""")
def cache_hits(spark, d):
    """Urls asked for, with what a cache of sixty days holds of them (here the id of the job it stands for)."""
    cache = jobs(spark, d).filter("url is not null").select(F.sha1("url").alias("key"), F.col("id").alias("body"), F.col("last_seen_at").alias("fetched_at"))
    return writeback.cached(raw(spark, d).filter("url is not null"), cache, F.lit(NOW).cast("timestamp"), 60 * 1440)


@query("""SELECT run_id, source FROM (SELECT *, coalesce(max(CAST(NOT ok AS int)) OVER (PARTITION BY source ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM run_results) WHERE stopped = 0""")
def source_isolation(spark, d):
    """Runs of each source up to its first failed one; a source that is blocked stops alone."""
    return writeback.until_blocked(table(spark, d, "run_results"), "source", ["started_at", "run_id"], ~F.col("ok")).select("run_id", "source")


_DUE = f"(SELECT * FROM jobs WHERE NOT closed AND expired_at IS NULL AND epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last_seen_at) >= 720 * 3600000000)"


def _due(spark, d):
    return writeback.due(jobs(spark, d), "last_seen_at", F.lit(NOW).cast("timestamp"), 720, ~F.col("closed") & F.col("expired_at").isNull())


@query(f"SELECT id FROM {_DUE} QUALIFY row_number() OVER (PARTITION BY source ORDER BY last_seen_at, id) <= 10")
def budgeted_checks(spark, d):
    """The ten listings of each source that have waited longest for a check."""
    return writeback.budgeted(_due(spark, d), "source", ["last_seen_at", "id"], 10)[0].select("id")


@query(f"SELECT source, greatest(count(*) - 10, 0) AS remaining FROM {_DUE} GROUP BY 1")
def remaining_checks(spark, d):
    return writeback.budgeted(_due(spark, d), "source", ["last_seen_at", "id"], 10)[1]


@query(f"""WITH {plans._VERDICTS} SELECT 'r1' AS run, job_id AS id, to_status, CASE WHEN reason IS NULL THEN 'taken' ELSE 'refused' END AS outcome, reason FROM j""")
def audit_log(spark, d):
    """The verdicts of a run appended to a log of JSON lines, and read back."""
    path = scratch_path(spark, "audit")
    lines = writeback.audit(plans._judged(spark, d), "id", "to_status", "r1")
    for half in (F.col("line") < '{"id":"8', F.col("line") >= '{"id":"8'):
        lines.filter(half).write.mode("append").partitionBy("run").text(path)
    read = spark.read.option("basePath", path).text(path).select("run", F.from_json("value", "id string, to_status string, outcome string, reason string").alias("v"))
    return read.select("run", "v.*")
