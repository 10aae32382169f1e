"""Verdicts from outside written back into a state table: joined, guarded, refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.postings import company_key, folder_name


def judge(state: DataFrame, verdicts: DataFrame, key: str, field: str, value: str, edges: list[tuple[str, str]]) -> DataFrame:
    """(key, value, reason) for each verdict: reason is null where the step from the state's field is one of
    edges, else 'unknown id', 'already X' or 'cannot move from X to Y'. state has one row a key; a verdict
    given twice is judged twice against the same state."""
    s = state.select(F.col(key).alias("_key"), F.col(field).alias("_from"))
    joined = verdicts.select(key, F.coalesce(F.col(value), F.lit("")).alias(value)).join(s, F.col(key) == F.col("_key"), "left")
    steps = [f"{a}>{b}" for a, b in edges]
    now = F.coalesce("_from", F.lit(""))
    reason = (
        F.when(F.col("_key").isNull(), "unknown id").when(now == F.col(value), F.concat(F.lit("already "), F.col(value)))
        .when(~F.concat(now, F.lit(">"), F.col(value)).isin(*steps), F.concat(F.lit("cannot move from "), now, F.lit(" to "), F.col(value)))
    )
    return joined.select(key, value, reason.alias("reason"))


def write_back(state: DataFrame, judged: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """State with the field of accepted verdicts set; of several for one key the alphabetically first counts."""
    taken = judged.filter("reason is null").groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_to"))
    joined = state.join(taken, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce("_to", field).alias(c) if c == field else F.col(c) for c in state.columns))


def due(rows: DataFrame, checked: str, now: Column, hours: float, alive: Column) -> DataFrame:
    """Rows that are alive and were never checked, or not for so many hours."""
    age = (F.unix_micros(now) - F.unix_micros(checked)) / F.lit(3_600_000_000.0)
    return rows.filter(alive & (F.col(checked).isNull() | (age >= hours)))


def mark_checked(rows: DataFrame, pages: DataFrame, key: str, verdict: Column, now: Column) -> DataFrame:
    """rows: with checked_at and expired_at. pages: key, status and what `verdict` reads. Gone pages (404, 410)
    and expired ones set expired_at once; other error statuses leave the row as it is."""
    seen = F.when(F.col("status").isin(404, 410), "expired").when(F.col("status") == 200, verdict)
    told = pages.groupBy(F.col(key).alias("_key")).agg(F.max(seen).alias("_seen"))
    joined = rows.join(told, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({
        "checked_at": F.when(F.col("_seen").isNotNull(), now).otherwise(F.col("checked_at")),
        "expired_at": F.coalesce("expired_at", F.when(F.col("_seen") == "expired", now)),
    }).select(*rows.columns)


def resolve_folders(companies: DataFrame, folders: DataFrame) -> DataFrame:
    """(company, folder): a folder of the name that the company would give, in any case; else the first by name of
    the same company; else that name, as a new folder."""
    exact = folders.groupBy(F.lower("folder").alias("_low")).agg(F.min("folder").alias("_exact"))
    same = folders.groupBy(company_key(F.col("folder")).alias("_key")).agg(F.min("folder").alias("_same"))
    asked = companies.select("company", folder_name(F.col("company")).alias("_wanted"), company_key(F.col("company")).alias("_key"))
    joined = asked.join(exact, F.lower("_wanted") == F.col("_low"), "left").join(same, "_key", "left")
    return joined.select("company", F.coalesce("_exact", "_same", "_wanted").alias("folder"))


def planned(searches: DataFrame, sources: DataFrame, max_pages: int) -> DataFrame:
    """(search_query, search_location, source, max_pages): enabled searches on each of their sources; sources not
    known or not enabled are left out. A search's own number of pages goes before the default."""
    each = searches.filter("enabled").select("search_query", "search_location", "max_pages", F.explode("sources").alias("source"))
    on = sources.filter("enabled").select("source")
    return each.join(on, "source", "left_semi").select("search_query", "search_location", "source", F.coalesce("max_pages", F.lit(max_pages).cast("long")).alias("max_pages"))


def cached(asked: DataFrame, cache: DataFrame, now: Column, minutes: float) -> DataFrame:
    """(url, key, body) of asked urls: body from the cache where the page was fetched within so many minutes (the latest
    such fetch), null where it is to be fetched. cache: key (sha1 of a url), body, fetched_at."""
    age = (F.unix_micros(now) - F.unix_micros("fetched_at")) / F.lit(60_000_000.0)
    held = cache.filter((age >= 0) & (age <= minutes)).groupBy("key").agg(F.max_by("body", F.struct("fetched_at", "body")).alias("body"))
    return asked.select("url").distinct().withColumn("key", F.sha1("url")).join(held, "key", "left").select("url", "key", "body")


def until_blocked(rows: DataFrame, source: str, order: list[str], blocked: Column) -> DataFrame:
    """Rows of each source up to its first blocked one, that one included; other sources go on. Ties are broken by the
    further columns of `order`, which must make rows distinct."""
    before = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_stopped", F.coalesce(F.max(blocked.cast("int")).over(before), F.lit(0))).filter("_stopped = 0").drop("_stopped")


def budgeted(rows: DataFrame, source: str, order: list[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """(rows to work on now, the first `budget` of each source by `order`; how many are left of each source). What is left
    comes up again in the next run, for it is still due."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    left = rows.groupBy(source).agg(F.greatest(F.count(F.lit(1)) - budget, F.lit(0)).alias("remaining"))
    return ranked.filter(F.col("_nth") <= budget).drop("_nth"), left


def audit(judged: DataFrame, key: str, value: str, run: str) -> DataFrame:
    """(run, line): a JSON line for each verdict of a run, taken or refused with its reason, to be appended to a log."""
    line = F.to_json(F.struct(F.col(key), F.col(value), F.when(F.col("reason").isNull(), "taken").otherwise("refused").alias("outcome"), "reason"))
    return judged.select(F.lit(run).alias("run"), line.alias("line"))
