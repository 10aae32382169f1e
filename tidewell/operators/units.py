"""Quantities in different units, in text or in fields, to one unit: yearly amounts of one currency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.pay import CURRENCY, PERIOD, parse_pay, period_by_size, unit_of

_OUT = "low double, high double, currency string, period string"


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for kind, raw, low, high, currency, period, default in zip(b["kind"], b["raw"], b["low"], b["high"], b["currency"], b["period"], b["fallback"]):
            pay = parse_pay(_text(raw))
            if kind == "text":
                if pay is None or (pay.low is None and pay.high is None):
                    rows.append((None, None, None, None, False))
                    continue
                low, high, currency, period = pay.low, pay.high, pay.currency, pay.period
            else:
                low, high = _number(low), _number(high)
                currency = unit_of(CURRENCY, _text(currency)) or (pay and pay.currency)
                period = unit_of(PERIOD, _text(period)) or (pay and pay.period)
                if pay and pay.thousands:
                    low, high = (x * 1000 if x is not None and abs(x) < 1000 else x for x in (low, high))
            largest = max((x for x in (low, high) if x is not None), default=None)
            rows.append((low, high, currency or _text(default), period or period_by_size(largest), True))
        out = b.drop(columns=["kind", "raw", "low", "high", "currency", "period", "fallback"])
        for i, name in enumerate(("low", "high")):
            out[name] = pd.array([r[i] for r in rows], dtype="Float64")
        for i, name in enumerate(("currency", "period"), 2):
            out[name] = pd.array([r[i] for r in rows], dtype="string")
        yield out[[r[4] for r in rows]]


def convert_pay(rows: DataFrame, factors: DataFrame, settings: DataFrame, keys: list[str]) -> DataFrame:
    """Yearly pay in the common currency.

    rows: keys, source, kind ('text': all is in raw; 'fields': low, high, currency, period are given, raw
    helps where they fail), raw, low, high, currency, period. factors: unit_kind, unit_code, factor.
    settings: source, currency (of amounts that name none).

    Returns keys, low, high, currency, period, year_min, year_max (bigint, half up; -1 where open). Texts
    without an amount of pay give no row; 'fields' rows always give one, -1 for what is not given or has no
    factor. A period neither stated nor decided by size (over 250, under 300) counts as a day in fields and
    gives no row in texts. Extra columns of rows are ignored.
    """
    types = dict(rows.dtypes)
    fallback = settings.groupBy("source").agg(F.min("currency").alias("fallback"))
    asked = rows.select(*keys, "source", "kind", "raw", "low", "high", "currency", "period")
    slim = asked.join(fallback, "source", "left").select(
        *keys, "kind", F.col("raw").cast("string").alias("raw"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"),
        F.col("currency").cast("string").alias("currency"), F.col("period").cast("string").alias("period"), "fallback",
    )
    kept = F.col("kind") != "text"
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "is_field boolean", _OUT])
    read = (
        slim.filter(kept | F.col("raw").rlike(r"\d"))
        .select(*keys, kept.alias("is_field"), "kind", "raw", "low", "high", "currency", "period", "fallback")
        .mapInPandas(_read, schema)
    )
    unit = lambda kind, name: factors.filter(F.col("unit_kind") == kind).groupBy("unit_code").agg(F.max("factor").cast("decimal(12,6)").alias(name))
    read = read.filter("is_field or period is not null").withColumn("period", F.coalesce("period", F.lit("day")))
    joined = read.join(unit("currency", "_cf").withColumnRenamed("unit_code", "currency"), "currency", "left").join(
        unit("period", "_pf").withColumnRenamed("unit_code", "period"), "period", "left"
    )

    def yearly(x: str) -> Column:
        exact = F.col(x).cast("decimal(16,4)") * F.col("_cf") * F.col("_pf").cast("decimal(8,2)")
        return F.coalesce(F.round(exact, 0).cast("long"), F.lit(-1).cast("long"))

    return joined.select(*keys, "low", "high", "currency", "period", yearly("low").alias("year_min"), yearly("high").alias("year_max"))
