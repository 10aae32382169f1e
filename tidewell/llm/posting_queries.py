"""Queries over postings: p2 (places), p3 (near-duplicates), p5 (matching across boards), p7 (repeats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import places as L
from tidewell.llm.history import repeats
from tidewell.llm.matching import match_across, matched
from tidewell.llm.near import expand_pairs, near_duplicates
from tidewell.llm.places import map_places
from tidewell.llm.vacancies import vacancy_fields
from tidewell.session import scratch_path, staged, table


def raw_places(raw: DataFrame, places: DataFrame) -> DataFrame:
    """(location_raw, place_id) of each distinct spelling."""
    spelled = raw.filter(F.trim(F.regexp_replace("location_raw", r"(?U)\s+", " ")) != "").select("location_raw").distinct()
    texts = spelled.select(F.col("location_raw").alias("whole"), F.lit("raw").alias("part"), F.col("location_raw").alias("txt"))
    return map_places(texts, places).select(F.col("whole").alias("location_raw"), "place_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "places")
    raw, jobs = table(spark, d, "raw_jobs"), table(spark, d, "jobs")
    place = F.to_json(F.struct(*(F.coalesce(F.col(f"job_location.{c}"), F.lit("")).alias(c) for c in ("raw", "city", "state", "country"))))
    rows = (
        raw.filter(F.trim(F.regexp_replace("location_raw", r"(?U)\s+", " ")) != "")
        .select(F.lit("raw_jobs").alias("rec"), F.col("raw_id").cast("string").alias("rec_key"), F.to_json(F.struct(F.col("location_raw").alias("raw"))).alias("whole"))
        .unionByName(jobs.select(F.lit("jobs").alias("rec"), F.col("id").alias("rec_key"), place.alias("whole")))
    )
    said = F.from_json("whole", "raw string, city string, state string, country string")
    texts = rows.select("whole").distinct().select("whole", said.alias("s")).selectExpr(
        "whole", "stack(4, 'raw', s.raw, 'city', s.city, 'state', s.state, 'country', s.country) AS (part, txt)"
    )
    mapped = map_places(texts.filter("part = 'raw' or txt <> ''").withColumn("txt", F.coalesce("txt", F.lit(""))), places)
    return rows.join(mapped, "whole").select("rec", "rec_key", "place_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "raw_jobs").select(F.col("raw_id").alias("id"), F.col("title").alias("lead"), F.col("description").alias("body"))
    pairs, members = near_duplicates(texts, size=3, least=0.6, least_words=30)
    return expand_pairs(pairs, members).select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"))


FIELDS = ("title", "company", "location_raw", "posted_at_raw", "scraped_at")


def first_rows(raw: DataFrame, key: Column) -> DataFrame:
    """The lowest raw_id of each (source, key), with the columns a vacancy is told by."""
    first = F.min_by(F.struct(*FIELDS), "raw_id").alias("r")
    return raw.groupBy("source", key.alias("_key")).agg(F.min("raw_id").alias("id"), first).select("id", "source", *(f"r.{c}" for c in FIELDS))


def p5_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = staged(first_rows(table(spark, d, "raw_jobs"), F.col("source_id")), "first-rows")
    fields = staged(vacancy_fields(rows, table(spark, d, "places"), table(spark, d, "source_settings")), "vacancies")
    return match_across(fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return matched(p5_scored(spark, d)).select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"))


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares a block or is implied, with its posterior and its similarities in twentieths."""
    scored = p5_scored(spark, d)
    return scored.select(F.col("a").alias("raw_id_a"), F.col("b").alias("raw_id_b"), F.round("confidence", 4).alias("confidence"), *(c for c in scored.columns if c.startswith("f_")))


def posting_key() -> Column:
    """The board's number of a posting, whatever is written around it; else the number in its url; else the
    row stands alone."""
    number = lambda c, rx: F.nullif(F.regexp_replace(F.regexp_extract(c, rx, 1), "^0+", ""), F.lit(""))
    return F.coalesce(number(F.col("source_id"), r"(\d{3,})"), number(F.col("url"), r"/job/(?:[^/?#]*-)?(\d{3,})"), F.nullif(F.trim("source_id"), F.lit("")), F.concat(F.lit("row "), F.col("raw_id").cast("string")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries, cut between batches at half of the rows: the second is held against what the first left."""
    raw = table(spark, d, "raw_jobs")
    rows = raw.select(F.col("raw_id").alias("id"), "source", posting_key().alias("key"), *FIELDS, F.coalesce("batch_no", F.lit(-1)).alias("batch_no"))
    middle = rows.agg(F.percentile_approx("batch_no", 0.5)).first()[0] or 0
    found = repeats(rows, table(spark, d, "places"), table(spark, d, "source_settings"), [F.col("batch_no") <= middle, F.col("batch_no") > middle], scratch_path(spark, "history"))
    return found.select(F.col("root").alias("raw_id_a"), F.col("id").alias("raw_id_b"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_confidence": p5_confidence, "p7_found": p7_found}



def _words_sql(column: str, groups: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '\\b({words})\\b') THEN '{code}'" for code, words in groups.items()) + " END"


def _places_sql() -> str:
    """Brute force: every written name against every reference string."""
    plain = lambda c: f"trim(regexp_replace(regexp_replace(translate(lower({c}), '{L.ACCENTED[0]}', '{L.ACCENTED[1]}'), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    words = sorted("|".join([*L.STATES.values(), *L.COUNTRIES.values(), L.NOISE, "[0-9]+"]).split("|"), key=lambda w: (-len(w), w))
    name = f"regexp_replace(regexp_replace(t, '\\b({'|'.join(words)})\\b', ' ', 'g'), '^ *pt\\b', 'port')"
    for short, full in L.ABBREVIATIONS.items():
        name = f"regexp_replace({name}, '\\b{short}\\b', '{full}', 'g')"
    return rf"""
WITH rows AS (
  SELECT 'raw_jobs' AS rec, CAST(raw_id AS varchar) AS rec_key, [location_raw] AS parts FROM raw_jobs WHERE trim(regexp_replace(location_raw, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')) <> ''
  UNION ALL SELECT 'jobs', id, [coalesce(job_location.raw, ''), job_location.city, job_location.state, job_location.country] FROM jobs),
texts AS (SELECT DISTINCT part, {plain('part')} AS t FROM (SELECT unnest(parts) AS part FROM rows) WHERE part IS NOT NULL),
parsed AS (SELECT part, {_words_sql('t', L.STATES)} AS st, {_words_sql('t', L.COUNTRIES)} AS co, trim(regexp_replace({name}, ' +', ' ', 'g')) AS name FROM texts),
refs AS (SELECT DISTINCT place_id, state, country, {plain('written')} AS ref FROM (SELECT place_id, state, country, unnest(list_concat([city], coalesce(aliases, []))) AS written FROM places)),
names AS (SELECT DISTINCT name FROM parsed WHERE name <> ''),
near AS (SELECT name, place_id, min(levenshtein(name, ref)) AS edits FROM names, refs WHERE levenshtein(name, ref) <= 2 GROUP BY ALL),
said AS (SELECT r.rec, r.rec_key, max(p.st) AS st, max(p.co) AS co FROM (SELECT rec, rec_key, unnest(parts) AS part FROM rows) r JOIN parsed p USING (part) GROUP BY ALL),
fits AS (SELECT r.rec, r.rec_key, n.place_id, min(n.edits) AS edits FROM (SELECT rec, rec_key, unnest(parts) AS part FROM rows) r JOIN parsed p USING (part) JOIN near n USING (name) GROUP BY ALL),
ranked AS (
  SELECT f.*, rank() OVER (PARTITION BY f.rec, f.rec_key ORDER BY f.edits, CASE WHEN s.st IS NOT NULL THEN CASE WHEN q.state = s.st THEN 2 ELSE 0 END WHEN s.co IS NOT NULL THEN CASE WHEN q.country = s.co THEN 1 ELSE 0 END ELSE 0 END DESC) AS nth
  FROM fits f JOIN said s USING (rec, rec_key) JOIN (SELECT place_id, state, country FROM places) q USING (place_id)),
best AS (SELECT rec, rec_key, CASE WHEN count(*) = 1 THEN max(place_id) ELSE -1 END AS place_id FROM ranked WHERE nth = 1 GROUP BY ALL)
SELECT rec, rec_key, coalesce(place_id, -1) AS place_id FROM rows LEFT JOIN best USING (rec, rec_key)
"""


SQL = {
    "p2_found": _places_sql(),
    "p3_found": r"""
WITH d AS (SELECT raw_id, regexp_extract_all(lower(concat(coalesce(title, ''), ' ', description)), '[a-z0-9]+') AS w FROM raw_jobs WHERE len(regexp_extract_all(lower(description), '[a-z0-9]+')) >= 30),
s AS (SELECT raw_id, list_distinct(list_transform(range(1, len(w) - 1), lambda k: hash(array_to_string(w[k:k + 2], ' ')))) AS g FROM d),
e AS (SELECT raw_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.raw_id AS raw_id_a, b.raw_id AS raw_id_b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.raw_id < b.raw_id GROUP BY ALL)
SELECT raw_id_a, raw_id_b FROM p WHERE c >= 0.6 * (na + nb - c)
""",
}
