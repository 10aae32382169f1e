"""Files of verdicts, ids and marks in, tables out."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE = r"(?i)^(true|yes|1|y)$"


def read_verdicts(spark: SparkSession, path: str, schema: str, required: dict[str, list[str] | None], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of verdicts, a JSON array, or an object a line. required: column -> allowed values, None for any that is
    not blank. A file with a fault is rejected whole: rows is empty then."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    fault = F.concat_ws("; ", *(
        F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c} is missing"))
        .when(F.lit(allowed is not None) & ~F.col(c).isin(allowed or [""]), F.concat(F.lit(f"{c} is not allowed: "), F.col(c)))
        for c, allowed in required.items()
    ))
    faults = rows.withColumn("fault", fault).filter("fault <> ''")
    # One row says whether any fault is there.
    any_fault = faults.agg(F.count(F.lit(1)).alias("faults"))
    return rows.join(F.broadcast(any_fault), F.col("faults") == 0, "left_semi"), faults


def read_applied(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, applied boolean) of a CSV file with a header in any case, or a JSON array."""
    if path.endswith(".json"):
        rows = spark.read.schema("id string, url string, applied string").option("multiLine", True).json(path)
        return rows.select("id", "url", (F.coalesce(F.lower("applied"), F.lit("")).isin("", "0") == F.lit(False)).alias("applied"))
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    if "applied" not in rows.columns:
        raise ValueError("the column applied is missing")
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(text("id").alias("id"), text("url").alias("url"), F.coalesce(F.trim("applied").rlike(TRUE), F.lit(False)).alias("applied"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def applied_to(marks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, applied, found): marks by id, else by url (the last job of it by id); a mark with an unknown id does
    not fall back to its url."""
    by_url = jobs.filter("url is not null").groupBy("url").agg(F.max("id").alias("url_id"))
    ids = jobs.select(F.col("id").alias("known")).distinct()
    named = marks.join(by_url, "url", "left").select(F.coalesce("id", "url_id").alias("id"), "applied")
    return named.join(ids, F.col("id") == F.col("known"), "left").select("id", "applied", F.col("known").isNotNull().alias("found"))


CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}


def csv_ready(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns as CSV cells: booleans yes or no, arrays joined by a space, nulls ''."""
    out = rows.select(*(c.alias(n) for n, c in columns.items()))
    cells = []
    for f in out.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "yes").otherwise("no")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, " ")
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return out.select(*cells)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


class VersionedTable:
    """A table as Parquet folders v=1, v=2 ...; a version counts once its success mark is written. A table
    without any version is empty; one whose files cannot be read fails."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._root):
            return 0
        names = [s.getPath() for s in self._fs.listStatus(self._root)]
        jvm = self.spark._jvm
        done = [int(m[1]) for p in names if (m := re.fullmatch(r"v=(\d+)", p.getName())) and self._fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={at}") if at else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        at = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={at}")
        return at


def merged_settings(base: dict, local: dict) -> dict:
    """Settings with a local file's put over them: objects merge, all else replaces."""
    return {**base, **{k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in local.items()}}


def read_settings(path: str, local: str | None = None) -> dict:
    with open(path) as f:
        base = json.load(f)
    if local:
        with open(local) as f:
            return merged_settings(base, json.load(f))
    return base
