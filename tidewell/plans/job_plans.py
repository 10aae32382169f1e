"""Queries of typed jobs, their resolution in order of arrival and the merged state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.operators import jobs as J
from tidewell.operators import resolve
from tidewell.plans import posting_plans as plans
from tidewell.plans.posting_plans import FLAT, raw

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Rows are gone through one by one within each firm (nothing meets across firms): `known` lists the leaders so far.
_FOLD = """d AS (SELECT id, arg_min({'seq': seq, 'source': source, 'fp': fp, 'ck': ck, 'tk': tk}, seq) AS r FROM k GROUP BY id),
f AS (SELECT id, r.seq AS seq, r.source AS source, r.fp AS fp, r.ck AS ck, r.tk AS tk, row_number() OVER (PARTITION BY r.ck ORDER BY r.seq) AS n FROM d),
w(ck, n, known, seq, lead) AS (
  SELECT DISTINCT ck, CAST(0 AS bigint), CAST([] AS STRUCT(seq bigint, source varchar, fp varchar, tk varchar[])[]), CAST(NULL AS bigint), CAST(NULL AS bigint) FROM f
  UNION ALL
  SELECT ck, n, CASE WHEN met IS NULL THEN list_append(known, {'seq': seq, 'source': source, 'fp': fp, 'tk': tk}) ELSE known END, seq, coalesce(met, seq)
  FROM (SELECT f.*, w.known, coalesce(list_filter(w.known, lambda x: x.fp = f.fp)[1].seq,
      list_filter(w.known, lambda x: x.source <> f.source AND len(list_intersect(x.tk, f.tk)) > 0 AND len(list_intersect(x.tk, f.tk)) >= 0.8 * (len(x.tk) + len(f.tk) - len(list_intersect(x.tk, f.tk))))[1].seq) AS met
    FROM w JOIN f ON f.ck = w.ck AND f.n = w.n + 1)),
led AS (SELECT k.seq, w.lead AS leader, CASE WHEN k.seq <> f.seq THEN 'updated' WHEN w.lead = f.seq THEN 'new' ELSE 'merged' END AS status FROM k JOIN f USING (id) JOIN w ON w.seq = f.seq)"""
_IN_ORDER = f"WITH RECURSIVE {plans._KEYED}, {_FOLD}"


@query(f"{_IN_ORDER} SELECT seq, leader, status FROM led")
def resolve_in_order(spark, d):
    return resolve.resolve_in_order(resolve.keyed(raw(spark, d), "raw_id", "source", "source_id", "title", "company", F.col("location_raw")))


@query(f"{_IN_ORDER} SELECT status, count(*) AS n FROM led GROUP BY 1")
def upsert_counts(spark, d):
    return resolve_in_order(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# A typed job of each raw row, from the rules of the single columns.
_TYPED = f"""place AS ({plans.SQL['parse_location']}), land AS ({plans.SQL['detect_country']}), pay AS ({plans.SQL['parse_salary']}),
base AS (SELECT *, {FLAT('title')} AS t, {FLAT('company')} AS c, {FLAT('location_raw')} AS flat, CASE WHEN nullif(teaser, '') IS NOT NULL THEN {FLAT('teaser')} END AS tease, {plans._html_sql('description')} AS body FROM raw_jobs),
said AS (SELECT *, lower(t) AS h, lower(concat_ws(' ' || chr(10) || ' ', nullif(t, ''), nullif(tease, ''), nullif(body, ''), nullif(employment_type_raw, ''))) AS w FROM base),
j AS (SELECT b.raw_id, sha1(concat(b.source, ':', b.source_id)) AS id, b.source, b.url, b.t AS title, b.c AS company, b.flat AS place_raw, p.city, p.state, l.country, coalesce(b.remote_hint, false) OR p.remote AS remote,
    sha1(concat({plans.T('t')}, '|', {plans.C('c')}, '|', trim(lower(coalesce(p.city, b.flat))))) AS fingerprint, y.pay_min, y.pay_max, y.period, y.salary_raw IS NOT NULL AS paid,
    nullif(b.category, '') AS category, b.tease AS teaser, b.body AS description, nullif(b.apply_method, '') AS apply_method, b.raw, b.scraped_at, e.kind AS employment_type,
    {plans._tags_sql('h', 'w')} AS tags
  FROM said b LEFT JOIN place p ON p.location_raw IS NOT DISTINCT FROM b.location_raw LEFT JOIN land l ON l.location_raw IS NOT DISTINCT FROM b.location_raw
  LEFT JOIN pay y ON y.salary_raw = b.salary_raw JOIN ({plans.SQL['employment_type'].replace("coalesce(title, '')", FLAT('title'))}) e ON e.raw_id = b.raw_id)"""


def _typed(spark, d):
    return J.to_jobs(raw(spark, d))


@query(f"""WITH {_TYPED} SELECT raw_id, id, fingerprint, title, company, place_raw, city, state, country, remote, employment_type, tags, pay_min, pay_max, period, category, teaser, md5(description) AS digest, apply_method FROM j""")
def to_job(spark, d):
    return _typed(spark, d).select(
        "raw_id", "id", "fingerprint", "title", "company", F.col("location.raw").alias("place_raw"), "location.city", "location.state", "location.country", "location.remote", "employment_type",
        F.array_join("tags", ",").alias("tags"), "salary.pay_min", "salary.pay_max", "salary.period", "category", "teaser", F.md5(F.col("description").cast("binary")).alias("digest"), "apply_method",
    )


def _merged_sql(key: str, rows: str) -> str:
    """What a left fold over the sightings of a key leaves, by aggregates over the order of arrival. Arrays and
    maps are united in tables of their own, an element once by its first place."""
    return f"""g AS ({rows}),
tag AS (SELECT key, string_agg(e, ',' ORDER BY fst) AS tags FROM (SELECT key, e, min(raw_id * 1000 + pos) AS fst FROM (SELECT key, raw_id, unnest(string_split(tags, ',')) AS e, unnest(range(len(string_split(tags, ',')))) AS pos FROM g WHERE tags <> '') GROUP BY 1, 2) GROUP BY 1),
src AS (SELECT key, string_agg(source, ',' ORDER BY fst) AS seen_on, md5(string_agg(coalesce(body, ''), '|' ORDER BY source)) AS raws FROM (SELECT key, source, min(raw_id) AS fst, arg_max({{'r': raw}}, raw_id).r AS body FROM g GROUP BY 1, 2) GROUP BY 1),
one AS (SELECT key, count(*) AS n_seen, coalesce(arg_min(title, raw_id) FILTER (title <> ''), '') AS title, coalesce(arg_min(company, raw_id) FILTER (company <> ''), '') AS company,
  coalesce(arg_min(url, raw_id) FILTER (coalesce(url, '') <> ''), arg_max({{'u': url}}, raw_id).u) AS url, arg_min(teaser, raw_id) FILTER (teaser IS NOT NULL) AS teaser, arg_min(category, raw_id) FILTER (category IS NOT NULL) AS category,
  arg_max(apply_method, raw_id) FILTER (apply_method IS NOT NULL) AS apply_method, CAST(max(coalesce(length(description), 0)) AS bigint) AS n_longest,
  arg_min({{'a': pay_min, 'b': pay_max, 'c': period}}, raw_id) FILTER (paid) AS pay, coalesce(arg_min(employment_type, raw_id) FILTER (employment_type <> 'unknown'), 'unknown') AS employment_type,
  coalesce(arg_min({{'a': city, 'b': state, 'c': country}}, raw_id) FILTER (coalesce(city, '') <> ''), arg_max({{'a': city, 'b': state, 'c': country}}, raw_id)) AS place, arg_min(id, raw_id) AS first_id
  FROM g GROUP BY key)
SELECT {key}, n_seen, title, company, url, teaser, category, apply_method, n_longest, pay.a AS pay_min, pay.b AS pay_max, pay.c AS period, employment_type, place.a AS city, place.b AS state, place.c AS country,
  coalesce(tags, '') AS tags, seen_on, raws FROM one LEFT JOIN tag USING (key) LEFT JOIN src USING (key)"""


def _shown(merged, key: Column):
    body = F.array_join(F.transform(F.array_sort(F.map_keys("raw")), lambda k: F.coalesce(F.col("raw")[k], F.lit(""))), "|")
    return merged.select(
        key, "n_seen", "title", "company", "url", "teaser", "category", "apply_method", F.coalesce(F.length("description"), F.lit(0)).cast("long").alias("n_longest"), "salary.pay_min", "salary.pay_max", "salary.period",
        "employment_type", "location.city", "location.state", "location.country", F.array_join("tags", ",").alias("tags"), F.array_join("seen_on", ",").alias("seen_on"), F.md5(body.cast("binary")).alias("raws"),
    )


@query(f"WITH {_TYPED}, {_merged_sql('key AS id', 'SELECT *, id AS key FROM j')}")
def merge_fold(spark, d):
    """All sightings of one id folded in order of arrival, by every rule of a merge."""
    return _shown(J.merged_jobs(_typed(spark, d).withColumn("key", F.col("id")), "key"), F.col("key").alias("id"))


_UPSERT = _IN_ORDER.replace(plans._KEYED, _TYPED + f""", k AS (SELECT raw_id AS seq, source, id, fingerprint AS fp, {plans.C('company')} AS ck, {plans.TOKENS('title')} AS tk FROM j)""")


@query(f"{_UPSERT}, {_merged_sql('first_id AS id', 'SELECT j.*, led.leader AS key FROM j JOIN led ON led.seq = j.raw_id')}")
def upsert_state(spark, d):
    """The later half of the batches taken into the store that the first half left: merged state by leader."""
    jobs = _typed(spark, d)
    rows = raw(spark, d).select("raw_id", "batch_no")
    half = rows.agg((F.max("batch_no").cast("double") / 2).alias("half"))
    marked = rows.join(F.broadcast(half)).select("raw_id", (F.col("batch_no") > F.col("half")).alias("late"))  # one row
    split = jobs.join(marked, "raw_id")
    state, _, _ = J.upsert_batch(split.filter("not late").drop("late"), split.filter("late").drop("late"))
    return _shown(state, F.col("id"))


_LATE = "(SELECT raw_id, batch_no, source, coalesce(epoch_us(max(scraped_at) OVER (PARTITION BY batch_no)) - epoch_us(scraped_at) > 21 * 86400000000, false) AS late FROM raw_jobs)"


@query(f"""{_IN_ORDER.replace("FROM raw_jobs)", f"FROM raw_jobs WHERE raw_id IN (SELECT raw_id FROM {_LATE} WHERE NOT late))")}
SELECT a.batch_no, a.source, count(*) AS fetched, count(*) FILTER (status = 'new') AS created, count(*) FILTER (status <> 'new') AS updated, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (late) AS skipped_old
FROM {_LATE} a LEFT JOIN led ON a.raw_id = led.seq GROUP BY 1, 2""")
def search_counts(spark, d):
    """Counters of each batch and source; rows scraped over three weeks before the newest of their batch are left out."""
    rows = raw(spark, d)
    newest = rows.groupBy("batch_no").agg(F.max("scraped_at").alias("newest"))  # a row for each batch
    marked = rows.join(newest, "batch_no").withColumn("late", F.coalesce(P.days_since(F.col("scraped_at"), F.col("newest")) > 21, F.lit(False)))
    kept = resolve.keyed(marked.filter("not late"), "raw_id", "source", "source_id", "title", "company", F.col("location_raw"))
    return J.run_counts(resolve.resolve_in_order(kept), marked.select(F.col("raw_id").alias("seq"), "batch_no", "source", "late"), ["batch_no", "source"], F.col("late"))
