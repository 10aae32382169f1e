"""Raw postings to typed jobs, and a batch of them into the store: one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.functions.text import collapse, strip_html
from tidewell.operators import merge, resolve
from tidewell.operators.time_forms import normalise_times
from tidewell.session import staged

LOCATION = ("raw", "city", "state", "country", "remote")


def to_jobs(raw: DataFrame, settings: DataFrame | None = None, query: Column | None = None) -> DataFrame:
    """Typed jobs of raw postings, one row each, with raw_id. Every job starts as 'scraped', seen on its own source,
    matched by `query` if that is not empty. Null or blank fields give null (title, company and place of a row ''),
    a description that holds markup only none. posted_at is read where `settings` (of sources) are given, else null.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    typed = raw.select(
        "raw_id", "source", "source_id", "url", collapse(F.col("title")).alias("title"), collapse(F.col("company")).alias("company"), P.location(F.col("location_raw"), F.col("remote_hint")).alias("location"),
        P.salary_label(F.col("salary_raw")).alias("salary"), "employment_type_raw", text("category").alias("category"), F.when(text("teaser").isNotNull(), collapse(F.col("teaser"))).alias("teaser"),
        strip_html(F.col("description")).alias("description"), text("apply_method").alias("apply_method"), F.col("raw").alias("body"), "scraped_at",
        (F.lit(None).cast("string") if query is None else query).alias("query"),
    )
    jobs = typed.select(
        "raw_id", P.make_id(F.col("source"), F.col("source_id")).alias("id"),
        P.fingerprint(F.col("title"), F.col("company"), F.coalesce("location.city", "location.raw")).alias("fingerprint"),
        "source", "source_id", "url", "title", "company", "location", "scraped_at", F.col("scraped_at").alias("last_seen_at"), F.lit(0).alias("missed_runs"), F.lit(False).alias("closed"),
        P.employment_type(F.col("employment_type_raw"), F.col("title")).alias("employment_type"), P.tags(F.col("title"), F.col("teaser"), F.col("description"), F.col("employment_type_raw")).alias("tags"),
        F.array("source").alias("seen_on"), F.array_compact(F.array(F.nullif("query", F.lit("")))).alias("matched_queries"), F.lit("scraped").alias("pipeline_status"), "salary", "category", "teaser", "description",
        "apply_method", F.create_map("source", "body").alias("raw"),
    )
    if settings is None:
        return jobs.withColumn("posted_at", F.lit(None).cast("timestamp"))
    return jobs.join(normalise_times(raw, settings, ["raw_id"], "posted_at_raw", "scraped_at").select("raw_id", "posted_at"), "raw_id", "left")


def merged_jobs(jobs: DataFrame, key: str, order: str = "raw_id") -> DataFrame:
    """One job of each key from its sightings in order: what was there first stays, what is richer wins, the apply
    method is the freshest, and tags, sources, queries and raw records are united. The status stays that of the
    first sighting, whatever comes later; missed runs start again and the job is open."""
    jobs = staged(jobs, "sightings")  # read once for the fold, for lists and maps, and for what the first one keeps
    folded = merge.merge_fold(
        jobs.withColumn("seq", F.col(order)), key, first_text=("title", "company", "url"), first_value=("teaser", "salary", "posted_at", "category"), longest=("description",),
        latest=("apply_method", "last_seen_at"), known={"employment_type": "unknown"}, first_filled={"location": "city"}, unions=("tags", "seen_on", "matched_queries"), maps=("raw",),
    )
    firsts = jobs.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("id", "fingerprint", "source", "source_id", "scraped_at", "pipeline_status"), order).alias("_f"))
    return folded.join(firsts, F.col(key) == F.col("_k")).select(key, "n_seen", "_f.*", *(c for c in folded.columns if c not in (key, "n_seen")), F.lit(0).alias("missed_runs"), F.lit(False).alias("closed"))


def taken_in(jobs: DataFrame, order: str = "raw_id", least: float = 0.8) -> DataFrame:
    """(seq, leader, status) of jobs taken into the store one by one: by id, by fingerprint, by a similar title of
    another source at the same firm."""
    keyed = jobs.select(
        F.col(order).alias("seq"), "source", "id", F.col("fingerprint").alias("fp"), P.normal_company(F.col("company")).alias("company_key"), F.array_sort(P.title_tokens(F.col("title"))).alias("tokens")
    )
    return resolve.resolve_in_order(keyed, least)


def upsert_batch(stored: DataFrame, batch: DataFrame, order: str = "raw_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, log, aliases). stored and batch: jobs as to_jobs gives them, `order` unique and higher in the batch.

    state: a merged job for each leader. log: (seq, leader, status) of the rows of the batch. aliases: (id, leader
    id), every id that rows were merged under, the leaders' own included. The same batch taken in twice changes
    n_seen only.
    """
    both = staged(stored.unionByName(batch), "postings")
    told = taken_in(both, order)
    led = both.join(told.select(F.col("seq").alias(order), "leader"), order)
    state = merged_jobs(led, "leader", order)
    log = told.join(batch.select(F.col(order).alias("seq")), "seq", "left_semi")
    aliases = led.select("id", "leader").distinct().join(state.select("leader", F.col("id").alias("leader_id")), "leader").select("id", "leader_id")
    return state, log, aliases


def run_counts(log: DataFrame, rows: DataFrame, by: list[str], late: Column) -> DataFrame:
    """Counters of a run by search: fetched, created, updated (merged ones too), merged, skipped_old. rows: seq and
    `by`; log as upsert_batch gives it; `late` marks rows that were left out for their age."""
    seen = rows.withColumn("_late", F.coalesce(late, F.lit(False))).join(log.select("seq", "status"), "seq", "left")
    had = lambda *s: F.count_if(~F.col("_late") & F.col("status").isin(*s))
    return seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fetched"), had("new").alias("created"), had("updated", "merged").alias("updated"), had("merged").alias("merged"), F.count_if("_late").alias("skipped_old")
    )
