"""Queries of many plans free what the driver no longer needs while they run."""

from pyspark.sql import functions as F

from tidewell.llm import history as H
from tidewell.llm import matching as M
from tidewell.session import relieve

SCHEMA = "id long, source string, title string, rank string, company string, place_id long, place string, at long"


def _fields(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], "crane driver", "", "amber steel", 1, "fern creek", i) for i in range(6)], SCHEMA)


def test_garbage_of_the_jvm_is_freed(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) / 1e6
    relieve(spark)
    before = used()
    held = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 300_000_000)]
    held.append(held)
    assert used() > before + 250
    del held
    relieve(spark)
    assert used() < before + 150


def test_a_delivery_frees_memory_between_its_plans(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(H, "relieve", calls.append)
    monkeypatch.setattr(H, "vacancy_fields", lambda rows, *_: _fields(spark).join(rows.select("id"), "id"))
    rows = _fields(spark).withColumns({"key": F.concat(F.lit("k"), "id"), "location_raw": F.col("place"), "posted_at_raw": F.lit(None).cast("string"), "scraped_at": F.timestamp_micros("at")})
    found = H.repeats(rows, None, None, [F.lit(True)], f"{tmp_path}/h")
    assert {(r.id, r.root) for r in found.collect()} == {(2, 0), (4, 0), (3, 1), (5, 1)} and len(calls) >= 3


def test_matching_frees_memory_between_its_plans(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(M, "relieve", calls.append)
    assert M.match_across(_fields(spark)).count() == 9 and len(calls) >= 4
