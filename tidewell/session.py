"""Session helpers: a builder for local work, table loading, and lineage cuts."""

from __future__ import annotations

import atexit
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a test directory; Parquet carries the schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; where that is unset, a run
    in one process (tests, local work) makes a temporary folder, and a cluster is an error: its executors would
    each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewell/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted with all that the application staged."""
    return f"{_tables_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, keeps
    columns prunable. Use it where a result is read more than once and costs more than its bytes. What an
    application staged stands in one folder of its own, see clear_staged."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; other frames are passed over."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application staged. Results of queries not yet read are lost with it."""
    _delete(spark, _tables_dir(spark))


def relieve(spark: SparkSession) -> None:
    """Free the driver's memory of plans that ran. Their garbage else stays until the JVM's heap has grown to its limit,
    and what the heap took it hardly gives back; a query of many plans calls this between them. It changes no result."""
    gc.collect()  # frames in cycles hold their plans
    spark._jvm.System.gc()


def bench_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that Python workers can import it
    wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidewell-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "tidewell_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, root: str) -> DataFrame:
        ship(spark)
        return query(spark, root)

    return run
