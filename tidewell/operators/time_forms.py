"""Mixed time notations to one UTC instant, by expectation-maximisation over forms of dates.

Every value gets all its valid readings. Most have one. For the others (dates with slashes) each source is
a mixture of the forms DMY, MDY and, with years of two digits, YMD; EM learns its weights, and a density over the
age at scraping that all sources share. What a source declares counts as so many rows, no more: its values overrule
it. A local time that occurs twice has two instants that nothing tells apart; the earlier one is taken and marked.
Readings are pre-aggregated to counts of (source, age bins), so EM itself works on a table
whose size depends on the number of sources only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.stamps import FORMS, SURE, YMD, readings, twice, unsaid_zone

DAY = 86_400_000_000
#: Upper edges, in days, of the bins of age at scraping; the first bin is the future, the last unknown.
AGE_EDGES = (-1.0, 2.0, 7.0, 30.0, 90.0, 400.0)
BINS = len(AGE_EDGES) + 2
#: Weight, in rows, of the declared date order of a source.
PRIOR_ROWS = 50.0
#: Rows that each form counts with anyway; years first are hardly ever written with two digits.
LEAST_ROWS = {form: 0.05 if form == YMD else 1.0 for form in FORMS}
#: Below this posterior a choice is marked as ambiguous.
SURE_AT = 0.9

READ = "source string, value string, scraped_us long, tz string"


def _age_bin(moment: int | None, scraped: int | None) -> int:
    if moment is None:
        return -1
    if scraped is None:
        return BINS - 1
    age = (scraped - moment) / DAY
    return next((i for i, edge in enumerate(AGE_EDGES) if age < edge), len(AGE_EDGES))


def _signature(found: dict[str, int], scraped: int | None) -> str | None:
    """Ages of the readings by form, None where the value has but one reading whatever its form."""
    if not found or SURE in found:
        return None
    return ",".join(str(_age_bin(found.get(form), scraped)) for form in FORMS)


AT = [f"at_{form.lower()}" for form in FORMS]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        times, sig, doubled = [], [], []
        for value, scraped, tz in zip(batch["value"], batch["scraped_us"], batch["tz"]):
            value, tz = value if isinstance(value, str) else None, tz if isinstance(tz, str) else None
            at = None if scraped != scraped or scraped is None else int(scraped)
            found = readings(value, at, tz)
            times.append([found.get(SURE), *map(found.get, FORMS)])
            sig.append(_signature(found, at))
            doubled.append(bool(found) and unsaid_zone(value) and any(twice(t, tz) for t in found.values()))
        out = batch.drop(columns=["value", "scraped_us", "tz"])
        for i, name in enumerate(("at_sure", *AT)):
            out[name] = pd.array([t[i] for t in times], dtype="Int64")
        out["sig"] = pd.array(sig, dtype="string")
        out["doubled"] = doubled
        yield out


def fit_orders(counts: list[tuple[str, str, int]], declared: dict[str, str | None], rounds: int = 50) -> dict[tuple[str, str], tuple[str, float]]:
    """EM on (source, signature, rows). Returns the chosen order and its posterior for each pair."""
    names = sorted({c[0] for c in counts})
    prior = {s: {k: LEAST_ROWS[k] + PRIOR_ROWS * (declared.get(s) == k) for k in FORMS} for s in names}
    weight = {s: {k: v / sum(LEAST_ROWS.values()) for k, v in LEAST_ROWS.items()} for s in names}
    density = [1.0 / BINS] * BINS
    density[0] = 0.02  # a listing is hardly ever posted after it was seen

    def posterior(source: str, sig: str) -> dict[str, float]:
        bins = dict(zip(FORMS, map(int, sig.split(","))))
        score = {k: weight[source][k] * density[b] if b >= 0 else 0.0 for k, b in bins.items()}
        total = sum(score.values())
        return {k: v / total if total else 0.0 for k, v in score.items()}

    for _ in range(rounds):
        mass = {s: dict(prior[s]) for s in names}
        ages = [1.0] * BINS
        for source, sig, rows in counts:
            post = posterior(source, sig)
            bins = dict(zip(FORMS, map(int, sig.split(","))))
            for k, p in post.items():
                mass[source][k] += p * rows
                if bins[k] >= 0:
                    ages[bins[k]] += p * rows
        weight = {s: {k: v / sum(m.values()) for k, v in m.items()} for s, m in mass.items()}
        density = [max(a / sum(ages), 1e-3) for a in ages]
        density[0] = max(density[0], 0.02)
    out = {}
    for source, sig, _ in counts:
        post = posterior(source, sig)
        best = max(post, key=lambda k: (post[k], k))
        out[source, sig] = (best, post[best])
    return out


def normalise_times(rows: DataFrame, settings: DataFrame, keys: list[str], value: str, scraped: str) -> DataFrame:
    """rows: keys, `source`, a text column `value` and a timestamp `scraped`; settings: source, tz, date_order.

    Returns keys, source, posted_at (timestamp, null if the value states no valid time), date_form
    (sure, DMY, MDY, YMD), confidence (half for a local time that occurs twice), ambiguous. One row per input row, repeats included. Null or blank values
    and sources give null; a source without settings reads in UTC with an order learnt from its own values;
    relative values without scraped_at give null. Extra columns of rows are ignored, whatever their names.
    """
    spark = rows.sparkSession
    zones = settings.groupBy("source").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    slim = rows.select(*keys, "source", F.col(value).cast("string").alias("value"), F.unix_micros(scraped).alias("scraped_us"))
    ready = slim.join(zones.select("source", "tz"), "source", "left").select(*keys, "source", "value", "scraped_us", "tz")
    types = dict(ready.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "source string, at_sure long", *(f"{c} long" for c in AT), "sig string, doubled boolean"])
    # The first pass parses only what can be ambiguous; its result is a few rows for each source.
    doubtful = ready.filter(F.col("value").rlike(r"\d{1,2}/\d{1,2}/\d{2}")).mapInPandas(_read, schema)
    counts = [tuple(r) for r in doubtful.filter("sig is not null and source is not null").groupBy("source", "sig").count().collect()]
    declared = {r[0]: r[1] for r in zones.filter("source is not null").select("source", "date_order").collect()}
    chosen = [(s, g, k, p) for (s, g), (k, p) in fit_orders(counts, declared).items()]
    posteriors = spark.createDataFrame(chosen, "source string, sig string, form string, posterior double")
    read = ready.mapInPandas(_read, schema).join(posteriors, ["source", "sig"], "left")
    # Without a posterior (null source) the only valid reading counts, else none.
    several = F.size(F.array_compact(F.array(*AT))) > 1
    only = F.coalesce(*(F.when(F.col(c).isNotNull(), form) for c, form in zip(AT, FORMS)))
    form = F.coalesce(F.when(F.col("at_sure").isNotNull(), SURE), F.col("form"), F.when(~several, only))
    at = F.coalesce(F.when(form == SURE, F.col("at_sure")), *(F.when(form == f, F.col(c)) for c, f in zip(AT, FORMS)))
    sure = F.when(form == SURE, F.lit(1.0)).otherwise(F.coalesce(F.col("posterior"), F.lit(1.0))) * F.when(F.col("doubled"), 0.5).otherwise(1.0)
    return read.select(
        *keys, "source", F.timestamp_micros(at).alias("posted_at"), F.when(at.isNotNull(), form).alias("date_form"), F.when(at.isNotNull(), sure).alias("confidence"),
        ((F.col("sig").isNotNull() & at.isNull()) | (at.isNotNull() & (sure < SURE_AT))).alias("ambiguous"),
    )


def utc_text(at: Column | str) -> Column:
    """`yyyy-MM-ddTHH:mm:ss.SSSZ` of a timestamp, finer digits cut off. Needs a session in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
