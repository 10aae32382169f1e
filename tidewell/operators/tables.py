"""Comparison of a table with an outside copy: append, three-way cells, incremental work, names in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_append(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table does not have; each key once, so a second call appends nothing."""
    return rows.dropDuplicates([key]).join(there.select(key).distinct(), key, "left_anti")


def decide_cell(ours: Column, theirs: Column, agreed: Column) -> Column:
    """'push', 'pull' or 'none' for a text that both sides may have edited since they last agreed: an empty
    cell takes ours; equal texts (but for blanks at the ends) need nothing; a cell nobody touched takes ours;
    any other edit of theirs wins."""
    o, t, a = (F.trim(F.coalesce(c, F.lit(""))) for c in (ours, theirs, agreed))
    return (
        F.when(t == "", F.when(o != "", "push").otherwise("none")).when(o == t, "none")
        .when((o != "") & agreed.isNotNull() & (t == a), "push").otherwise("pull")
    )


def cell_actions(ours: DataFrame, theirs: DataFrame, agreed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, action, value), a row for each cell of rows that both sides have and that needs one."""
    o, t, a = ours.alias("o"), theirs.alias("t"), agreed.alias("a")
    joined = o.join(t, F.col(f"o.{key}") == F.col(f"t.{key}")).join(a, F.col(f"o.{key}") == F.col(f"a.{key}"), "left")
    cells = F.array(*(
        F.struct(F.lit(c).alias("column_name"), decide_cell(F.col(f"o.{c}"), F.col(f"t.{c}"), F.col(f"a.{c}")).alias("action"), F.col(f"o.{c}").alias("ours"), F.col(f"t.{c}").alias("theirs"))
        for c in columns
    ))
    return (
        joined.select(F.col(f"o.{key}").alias(key), F.explode(cells).alias("c")).filter("c.action <> 'none'")
        .select(key, "c.column_name", "c.action", F.when(F.col("c.action") == "push", F.col("c.ours")).otherwise(F.col("c.theirs")).alias("value"))
    )


def rebuild_actions(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): 'carry' what is built from the same inputs, 'build' what is new or changed, 'drop' the rest."""
    a, b = now.select(key, F.col(digest).alias("_now")), before.select(key, F.col(digest).alias("_before"))
    action = F.when(F.col("_now").isNull(), "drop").when(F.col("_now") == F.col("_before"), "carry").otherwise("build")
    return a.join(b, key, "full").select(key, action.alias("action"))


def numbered_names(rows: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Adds `file_name`: the name, with _2, _3 ... where others in the folder had it before (case ignored)."""
    nth = F.row_number().over(Window.partitionBy(F.lower(folder), F.lower(name)).orderBy(order))
    return rows.withColumn("file_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), nth.cast("string"))))
