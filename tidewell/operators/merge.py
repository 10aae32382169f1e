"""Merging of sightings into one record, and upsert of a batch into a state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(value: Column, holds: Column) -> Column:
    """By order of arrival, the first value for which holds."""
    return F.min_by(value, F.when(holds, F.col("seq")))


def _gathered(rows: DataFrame, key: str, unions: tuple[str, ...], maps: tuple[str, ...]) -> DataFrame:
    """(key, arrays, maps): elements are brought down to one row each before they are gathered, so that a key of
    very many sightings gathers its distinct elements only."""
    none = F.lit(None).cast("string")
    parts = [rows.select(key, "seq", F.lit(c).alias("_c"), F.posexplode(c).alias("_at", "_e")).withColumn("_v", none) for c in unions]
    parts += [rows.select(key, "seq", F.lit(c).alias("_c"), F.posexplode(c).alias("_at", "_e", "_v")) for c in maps]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    once = each.groupBy(key, "_c", "_e").agg(F.min(F.struct("seq", "_at")).alias("_first"), F.max_by("_v", "seq").alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", "_c", "_e", "_v")))
    of = lambda c: F.filter(F.col("_all"), lambda x: x["_c"] == c)
    cells = [F.transform(of(c), lambda x: x["_e"]).alias(c) for c in unions]
    cells += [F.map_from_entries(F.transform(of(c), lambda x: F.struct(x["_e"], x["_v"]))).alias(c) for c in maps]
    return once.groupBy(key).agg(ordered.alias("_all")).select(F.col(key).alias("_key"), *cells)


def merge_fold(
    rows: DataFrame, key: str, first_text: tuple[str, ...] = (), first_value: tuple[str, ...] = (), longest: tuple[str, ...] = (), latest: tuple[str, ...] = (),
    known: dict[str, str] | None = None, unions: tuple[str, ...] = (), first_filled: dict[str, str] | None = None, maps: tuple[str, ...] = (),
) -> DataFrame:
    """One record of each key from its sightings in order of `seq`, as a left fold would leave it.

    first_text: first non-empty text, else the last value. first_value: first non-null value. longest: longest
    text, the earlier of equals. latest: last non-null value. known: column -> placeholder; the first value
    other than the placeholder, else the last one. first_filled: struct -> its field that must not be empty; the
    first such struct, else the last one. unions: arrays of strings, elements once, in order of arrival. maps:
    of strings, all keys, the last value of each. Null arrays and maps are empty ones. Adds n_seen. All is
    aggregated partially, so that a hot key does not move all its rows.
    """
    last = lambda c: F.max_by(F.col(c), "seq")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = [F.count(F.lit(1)).alias("n_seen")]
    out += [F.coalesce(_first(F.col(c), ~empty(c)), last(c)).alias(c) for c in first_text]
    out += [_first(F.col(c), F.col(c).isNotNull()).alias(c) for c in first_value]
    out += [F.max_by(F.col(c), F.struct(F.coalesce(F.length(c), F.lit(0)), -F.col("seq"))).alias(c) for c in longest]
    out += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in latest]
    out += [F.coalesce(_first(F.col(c), F.coalesce(F.col(c), F.lit(blank)) != blank), last(c)).alias(c) for c, blank in (known or {}).items()]
    out += [F.coalesce(_first(F.col(c), ~empty(f"{c}.{inner}")), last(c)).alias(c) for c, inner in (first_filled or {}).items()]
    folded = rows.groupBy(key).agg(*out)
    if not unions and not maps:
        return folded
    lists = _gathered(rows.filter(F.col(key).isNotNull()), key, unions, maps)
    blank = {**{c: F.array().cast("array<string>") for c in unions}, **{c: F.create_map().cast("map<string,string>") for c in maps}}
    joined = folded.join(lists, F.col(key) == F.col("_key"), "left")
    return joined.select(*folded.columns, *(F.coalesce(c, b).alias(c) for c, b in blank.items()))


def upsert(state: DataFrame, batch: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """State after a batch with one row a key: columns in `keep` stay as they were for known keys, the others
    come from the batch where it has a value. All keys of both sides are there; columns are those of state."""
    s, b = state.alias("s"), batch.alias("b")
    joined = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full")
    known = F.col(f"s.{key}").isNotNull()
    cells = []
    for c in state.columns:
        if c == key:
            cells.append(F.coalesce(f"s.{c}", f"b.{c}").alias(c))
        elif c in keep:
            cells.append(F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cells.append(F.coalesce(f"b.{c}", f"s.{c}").alias(c))
    return joined.select(*cells)
