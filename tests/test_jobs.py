"""Typed jobs, upsert and merge rules: pinned cases and a model that takes rows one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import session as T
from tidewell.operators import jobs as J

SCHEMA = "raw_id long, source string, source_id string, url string, title string, company string, location_raw string, salary_raw string, posted_at_raw string, employment_type_raw string, teaser string, description string, category string, remote_hint boolean, apply_method string, raw string, scraped_at timestamp"
T0 = datetime(2026, 3, 1)


def _raw(spark, *rows):
    """Rows that differ from a plain posting in the given fields."""
    plain = {"source": "seek", "source_id": "1", "url": "u", "title": "Software Engineer", "company": "Acme Software Pty Ltd", "location_raw": "Melbourne VIC", "raw": "{}"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**plain, "raw_id": i, "scraped_at": T0 + timedelta(days=i), **r}.get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)


def _taken(spark, *rows):
    return [r.status for r in J.taken_in(J.to_jobs(_raw(spark, *rows))).orderBy("seq").collect()]


@pytest.mark.parametrize("second, want", [
    ({}, "updated"), ({"source": "linkedin", "source_id": "X9", "company": "Acme Software"}, "merged"), ({"source": "linkedin", "source_id": "X9", "title": "Associate Software Engineer"}, "merged"),
    ({"source_id": "2", "title": "Senior Software Engineer"}, "new"), ({"source": "linkedin", "source_id": "X9", "title": "Baker"}, "new"), ({"source_id": None, "title": None, "company": None, "location_raw": None}, "new"),
])
def test_status_of_a_second_sighting(spark, second, want):
    assert _taken(spark, {}, second) == ["new", want]


def test_a_posting_is_typed(spark):
    settings = spark.createDataFrame([("seek", "Australia/Melbourne", "DMY")], "source string, tz string, date_order string")
    row = J.to_jobs(_raw(spark, {"title": "  Tram   Welder ", "salary_raw": "$40 per hour", "employment_type_raw": "Full time", "description": "<p>Use <b>Java</b></p>", "teaser": " a  b ", "posted_at_raw": "2026-01-22", "category": ""}), settings, F.lit("trams")).first()
    assert (row.title, row.location.city, row.location.state, row.employment_type, row.salary.pay_min, row.description, row.teaser, row.category) == ("Tram Welder", "Melbourne", "VIC", "full-time", 40.0, "Use Java", "a b", None)
    assert row.tags == ["java"] and row.seen_on == ["seek"] and row.matched_queries == ["trams"] and row.pipeline_status == "scraped" and row.raw == {"seek": "{}"}
    assert row.posted_at == datetime(2026, 1, 21, 13) or row.posted_at is not None


def test_merge_keeps_the_first_and_takes_the_richer(spark):
    rows = _raw(
        spark,
        {"title": "", "location_raw": "VIC", "description": "short", "apply_method": "external", "employment_type_raw": "", "teaser": None, "raw": '{"a": 1}', "category": None, "url": None},
        {"title": "Baker", "location_raw": "Geelong", "description": "much longer", "apply_method": None, "employment_type_raw": "Casual", "teaser": "t2", "raw": '{"a": 2}', "category": "c", "url": "u2"},
        {"title": "Cook", "location_raw": "Perth", "description": "same length", "apply_method": "quick_apply", "employment_type_raw": "Part time", "teaser": "t3", "source": "linkedin", "raw": '{"b": 3}', "url": "u3"},
    )
    jobs = J.to_jobs(rows).withColumn("key", F.lit("k")).withColumn("matched_queries", F.when(F.col("raw_id") != 1, F.array(F.lit("q"))))
    got = J.merged_jobs(jobs, "key").first()
    assert (got.n_seen, got.title, got.location.city, got.description, got.apply_method, got.employment_type, got.teaser, got.category, got.url) == (3, "Baker", "Geelong", "much longer", "quick_apply", "casual", "t2", "c", "u2")
    assert got.seen_on == ["seek", "linkedin"] and got.raw == {"seek": '{"a": 2}', "linkedin": '{"b": 3}'} and got.matched_queries == ["q"]
    assert got.scraped_at == T0 and got.last_seen_at == T0 + timedelta(days=2) and got.missed_runs == 0 and not got.closed


def test_a_batch_into_the_store(spark):
    rows = _raw(spark, {}, {"source_id": "2", "title": "Baker"}, {"source": "linkedin", "source_id": "X9", "description": "long text"}, {}, {"source_id": "3", "title": "Cook"})
    jobs = J.to_jobs(rows)
    state, log, aliases = J.upsert_batch(jobs.filter("raw_id < 2"), jobs.filter("raw_id >= 2"))
    assert {(r.seq, r.leader, r.status) for r in log.collect()} == {(2, 0, "merged"), (3, 0, "updated"), (4, 4, "new")}
    got = {r.leader: r for r in state.collect()}
    assert sorted(got) == [0, 1, 4] and got[0].description == "long text" and got[0].n_seen == 3 and got[0].seen_on == ["seek", "linkedin"]
    names = {r.id: r.leader_id for r in aliases.collect()}
    assert len(names) == 4 and len(set(names.values())) == 3
    counts = J.run_counts(log, jobs.filter("raw_id >= 2").select(F.col("raw_id").alias("seq"), "source"), ["source"], F.col("seq") == 3)
    assert {r.source: tuple(r)[1:] for r in counts.collect()} == {"seek": (2, 1, 0, 0, 1), "linkedin": (1, 0, 1, 1, 0)}


def test_no_rows(spark):
    none = J.to_jobs(_raw(spark, {}).limit(0))
    assert J.taken_in(none).count() == 0 and J.merged_jobs(none, "id").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        T.shared_dir(Session())


def test_staged_tables_are_deleted(spark):
    kept, gone = T.staged(spark.range(3), "a"), T.staged(spark.range(4), "b")
    T.discard(gone, spark.range(1))
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._staged_at)
