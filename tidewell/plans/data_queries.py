"""Queries of the general data problems (p1, p4, p6) on the posting tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.snapshot_diff import diff_snapshots, trimmed
from tidewell.operators.time_forms import normalise_times, utc_text
from tidewell.operators.units import convert_pay
from tidewell.session import table

KEYS = ["rec", "rec_key"]


def stamped_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_jobs").select(F.lit("raw_jobs").alias("rec"), F.col("raw_id").cast("string").alias("rec_key"), "source", F.col("posted_at_raw").alias("stamp"), "scraped_at")
    jobs = table(spark, d, "jobs").select(F.lit("jobs").alias("rec"), F.col("id").alias("rec_key"), "source", F.col("posted_at").alias("stamp"), "scraped_at")
    return raw.unionByName(jobs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = stamped_rows(spark, d).filter(F.col("stamp").isNotNull())
    found = normalise_times(rows, table(spark, d, "source_settings"), KEYS, "stamp", "scraped_at")
    return found.filter(F.col("posted_at").isNotNull()).select(*KEYS, utc_text("posted_at").alias("posted_utc"))


def p1_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """How sure each source's readings are: rows, unread and ambiguous ones by form of date."""
    found = normalise_times(stamped_rows(spark, d), table(spark, d, "source_settings"), KEYS, "stamp", "scraped_at")
    return found.groupBy("rec", "source", F.coalesce("date_form", F.lit("none")).alias("date_form")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ambiguous").alias("n_ambiguous")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    raw = table(spark, d, "raw_jobs").filter(F.col("salary_raw").isNotNull()).select(
        F.lit("raw_jobs").alias("rec"), F.col("raw_id").cast("string").alias("rec_key"), "source", F.lit("text").alias("kind"), F.col("salary_raw").alias("raw"),
        null("double").alias("low"), null("double").alias("high"), null("string").alias("currency"), null("string").alias("period"),
    )
    jobs = table(spark, d, "jobs").filter(F.col("salary").isNotNull()).select(
        F.lit("jobs").alias("rec"), F.col("id").alias("rec_key"), "source", F.lit("fields").alias("kind"), F.col("salary.raw").alias("raw"),
        F.col("salary.pay_min").alias("low"), F.col("salary.pay_max").alias("high"), F.col("salary.currency").alias("currency"), F.col("salary.period").alias("period"),
    )
    yearly = convert_pay(raw.unionByName(jobs), table(spark, d, "pay_units"), table(spark, d, "source_settings"), KEYS)
    return yearly.select(*KEYS, "year_min", "year_max")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    digest = F.xxhash64(
        *(trimmed(c) for c in ("company", "title", "location_raw", "salary_raw", "pipeline_status")),
        F.coalesce(F.col("closed").cast("string"), F.lit("")), F.coalesce(F.unix_micros("expired_at"), F.lit(0)),
    )
    return diff_snapshots(table(spark, d, "job_snapshots"), "snapshot_no", "delivery_no", "id", "last_seen_at", digest)


QUERIES = {"p1_found": p1_found, "p1_ambiguity": p1_ambiguity, "p4_found": p4_found, "p6_found": p6_found}

_AGO = r"^(about |over |around )?(\d+|an?|one)\s*\+?\s*(months?|mths?|mos?|minutes?|mins?|seconds?|secs?|hours?|hrs?|days?|weeks?|wks?|years?|yrs?|[hdwms])\s*\+?\s*(ago)?$"


def _times_sql() -> str:
    """Every notation by its pattern. Instants of local times: DuckDB takes the later one of a time that occurs twice
    and moves a skipped one on; one hour before is taken where that is the same local time."""
    clock = r"(?:(?:[T,]|\s|\bat\b)+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?)?\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_/]+)?(?:\s*\[([A-Za-z_/+-]+)\])?)?$"
    form = lambda head, order: f"regexp_extract(t, '(?i)^{head}{clock}', {order})"
    rest = ", 'h', 'mi', 's', 'f', 'half', 'zone', 'zone2']"
    day, month = r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4})", r"(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    forms = {
        "ymd": form(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "['y', 'm', 'd'" + rest), "dmy": form(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})", "['d', 'm', 'y'" + rest),
        "dm": form(day, "['d', 'm', 'y'" + rest), "md": form(month, "['m', 'd', 'y'" + rest),
    }
    compact = r"regexp_extract(t, '^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?())?$', ['y', 'm', 'd'" + rest + ")"
    blank = "{" + ", ".join(f"'{k}': ''" for k in ("y", "m", "d", "h", "mi", "s", "f", "half", "zone", "zone2")) + "}"
    swap = "{'y': x.y, 'm': x.d, 'd': x.m, 'h': x.h, 'mi': x.mi, 's': x.s, 'f': x.f, 'half': x.half, 'zone': x.zone, 'zone2': x.zone2}"
    same = "{'y': x.y, 'm': x.m, 'd': x.d, 'h': x.h, 'mi': x.mi, 's': x.s, 'f': x.f, 'half': x.half, 'zone': x.zone, 'zone2': x.zone2}"
    letters = "CASE upper(z) " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in (("UTC", 0), ("GMT", 0), ("Z", 0), ("UT", 0), ("BST", 60), ("AWST", 480), ("ACST", 570), ("ACDT", 630), ("AEST", 600), ("AEDT", 660), ("NZST", 720), ("NZDT", 780))) + " END"
    return rf"""
WITH r AS (SELECT 'raw_jobs' AS rec, CAST(raw_id AS varchar) AS rec_key, source, posted_at_raw AS stamp, scraped_at FROM raw_jobs UNION ALL SELECT 'jobs', id, source, posted_at, scraped_at FROM jobs),
a AS (SELECT rec, rec_key, coalesce(tz, 'UTC') AS tz, date_order, scraped_at,
  regexp_replace(trim(regexp_replace(stamp, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')), '(?i)^((re-?)?(posted|listed|published|added|updated|date|advertised)(\s+(on|at))?\s*:?\s+|(posted|listed)\s*:\s*)', '') AS t
  FROM r LEFT JOIN source_settings USING (source) WHERE stamp IS NOT NULL),
b AS (SELECT *, CASE WHEN regexp_matches(t, '^(\d{{10}}|\d{{13}}|\d{{16}})$') THEN {blank} WHEN {forms['ymd']}.y <> '' THEN {forms['ymd']} WHEN {compact}.y <> '' THEN {compact}
    WHEN {forms['dmy']}.y <> '' THEN {forms['dmy']}
    WHEN {forms['dm']}.y <> '' THEN {forms['dm']} WHEN {forms['md']}.y <> '' THEN {forms['md']} ELSE {blank} END AS x FROM a),
c AS (SELECT *, regexp_matches(t, '^\d{{1,2}}/') AS slash, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(lower(x.m), 3)) AS named FROM b),
d AS (SELECT rec, rec_key, tz, scraped_at, t, v, z.z AS z FROM (
  SELECT *, CASE WHEN slash AND x.y <> '' AND date_order = 'MDY' AND try_cast(x.d AS int) BETWEEN 1 AND 12 AND try_cast(x.m AS int) <= 31 THEN {swap} WHEN slash AND x.y <> '' AND try_cast(x.m AS int) > 12 THEN {swap} ELSE {same} END AS v FROM c), LATERAL (SELECT coalesce(nullif(v.zone, ''), nullif(v.zone2, '')) AS z) z),
e AS (SELECT *, CASE WHEN v.y <> '' THEN try_cast(concat(CASE WHEN length(v.y) = 2 THEN '20' || v.y ELSE v.y END, '-', CASE WHEN regexp_matches(v.m, '^\d') THEN v.m ELSE CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(lower(v.m), 3)) AS varchar) END, '-', v.d, ' ',
    CASE WHEN v.h = '' THEN '0' WHEN v.half = '' THEN v.h ELSE CAST(try_cast(v.h AS int) % 12 + CASE WHEN lower(left(v.half, 1)) = 'p' THEN 12 ELSE 0 END AS varchar) END, ':', coalesce(nullif(v.mi, ''), '00'), ':', coalesce(nullif(v.s, ''), '00'), '.', left(v.f || '000000', 6)) AS timestamp) END AS civil FROM d),
f AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN left(z, 1) = '-' THEN -1 ELSE 1 END) * (try_cast(substr(z, 2, 2) AS int) * 60 + coalesce(try_cast(right(rpad(replace(substr(z, 2), ':', ''), 4, '0'), 2) AS int), 0)) ELSE {letters} END AS off, CASE WHEN z IS NULL THEN tz WHEN contains(z, '/') THEN z END AS region FROM e),
g AS (SELECT *, timezone(coalesce(region, 'UTC'), civil) AS late FROM f),
h AS (SELECT rec, rec_key, CASE WHEN civil IS NOT NULL THEN CASE WHEN off IS NOT NULL THEN epoch_us(civil) - CAST(off AS bigint) * 60000000 WHEN region IS NOT NULL THEN CASE WHEN timezone(region, late - INTERVAL 1 HOUR) = civil THEN epoch_us(late) - 3600000000 ELSE epoch_us(late) END END
    WHEN regexp_matches(t, '^\d{{10}}$') THEN try_cast(t AS bigint) * 1000000 WHEN regexp_matches(t, '^\d{{13}}$') THEN try_cast(t AS bigint) * 1000 WHEN regexp_matches(t, '^\d{{16}}$') THEN try_cast(t AS bigint)
    WHEN regexp_matches(lower(t), '^(just now|just posted|just listed|just|now|today|new|moments ago)$') THEN epoch_us(scraped_at) WHEN lower(t) = 'yesterday' THEN epoch_us(scraped_at) - 86400000000
    ELSE epoch_us(scraped_at) - 1000000 * try_cast(CASE WHEN regexp_matches(n, '^\d') THEN n ELSE '1' END AS bigint) * CASE WHEN regexp_matches(u, '^(mo|mth)') THEN 2592000 WHEN regexp_matches(u, '^(mi|m$)') THEN 60 WHEN u LIKE 's%' THEN 1 WHEN u LIKE 'h%' THEN 3600 WHEN u LIKE 'd%' THEN 86400 WHEN u LIKE 'w%' THEN 604800 WHEN u LIKE 'y%' THEN 31536000 END END AS us
  FROM (SELECT *, regexp_extract(lower(t), '{_AGO}', 2) AS n, regexp_extract(lower(t), '{_AGO}', 3) AS u FROM g))
SELECT rec, rec_key, strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS posted_utc FROM h WHERE us IS NOT NULL
"""


SQL = {
    "p1_found": _times_sql(),
    "p6_found": r"""
WITH latest AS (
  SELECT * FROM job_snapshots s WHERE delivery_no = (SELECT max(delivery_no) FROM job_snapshots t WHERE t.snapshot_no = s.snapshot_no)),
kept AS (
  SELECT snapshot_no, id,
    concat_ws('|', coalesce(trim(company, E' \t\n\r'), ''), coalesce(trim(title, E' \t\n\r'), ''), coalesce(trim(location_raw, E' \t\n\r'), ''),
      coalesce(trim(salary_raw, E' \t\n\r'), ''), coalesce(trim(pipeline_status, E' \t\n\r'), ''), closed, coalesce(CAST(expired_at AS varchar), '')) AS state,
    row_number() OVER (PARTITION BY snapshot_no, id ORDER BY last_seen_at DESC) AS nth
  FROM latest),
one AS (SELECT snapshot_no, id, state FROM kept WHERE nth = 1)
SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no, coalesce(a.id, b.id) AS id,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT * FROM one WHERE snapshot_no < 10) a FULL JOIN (SELECT * FROM one WHERE snapshot_no > 1) b ON a.id = b.id AND b.snapshot_no = a.snapshot_no + 1
WHERE a.id IS NULL OR b.id IS NULL OR a.state <> b.state
""",
}
