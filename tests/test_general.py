"""Times, pay and snapshots: rules, brute force and odd tables."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.pay import parse_pay, unit_of
from tidewell.functions.stamps import readings
from tidewell.operators import snapshot_diff as S
from tidewell.operators.time_forms import fit_orders, normalise_times, utc_text
from tidewell.operators.units import convert_pay

SCRAPED = int(datetime(2026, 3, 10, 12, 0, 0, 500000, tzinfo=timezone.utc).timestamp() * 1e6)


def iso(us):
    return datetime.fromtimestamp(us / 1e6, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@pytest.mark.parametrize(
    "raw, tz, want",
    [
        ("2026-01-22T00:28:03Z", "Australia/Melbourne", "2026-01-22T00:28:03.000Z"),
        ("2026-01-22 06:43", "Australia/Melbourne", "2026-01-21T19:43:00.000Z"),
        ("2026-01-22", "Pacific/Auckland", "2026-01-21T11:00:00.000Z"),
        ("1769050195167", "UTC", "2026-01-22T02:49:55.167Z"),
        ("1769050195", "UTC", "2026-01-22T02:49:55.000Z"),
        ("20260122T103212Z", "UTC", "2026-01-22T10:32:12.000Z"),
        ("Fri, 01 May 2026 14:07:43 +0800", "UTC", "2026-05-01T06:07:43.000Z"),
        ("2026-01-23T20:45:20+08:00[Australia/Perth]", "UTC", "2026-01-23T12:45:20.000Z"),
        ("2026-01-28 17:01:43 Australia/Adelaide", "UTC", "2026-01-28T06:31:43.000Z"),
        ("2026-04-04 15:11:28 BST", "UTC", "2026-04-04T14:11:28.000Z"),
        ("11 February 2026, 2:28 pm AEDT", "UTC", "2026-02-11T03:28:00.000Z"),
        ("March 10, 2026 at 12:40 AM", "UTC", "2026-03-10T00:40:00.000Z"),
        ("10.3.2026 23:07", "UTC", "2026-03-10T23:07:00.000Z"),
        ("2026-04-05 02:30", "Australia/Melbourne", "2026-04-04T15:30:00.000Z"),  # twice: the earlier
        ("2026-10-04 02:30", "Australia/Melbourne", "2026-10-03T16:30:00.000Z"),  # skipped: moved on
        ("Posted 2 days ago", "UTC", "2026-03-08T12:00:00.500Z"),
        ("30+ days ago", "UTC", "2026-02-08T12:00:00.500Z"),
        ("2h ago", "UTC", "2026-03-10T10:00:00.500Z"),
        ("1 month ago", "UTC", "2026-02-08T12:00:00.500Z"),
        ("Yesterday", "UTC", "2026-03-09T12:00:00.500Z"),
        ("Just posted", "UTC", "2026-03-10T12:00:00.500Z"),
        ("  Listed 2026-03-24 12:47 ", "UTC", "2026-03-24T12:47:00.000Z"),
    ],
)
def test_one_reading(raw, tz, want):
    found = readings(raw, SCRAPED, tz)
    assert {iso(v) for v in found.values()} == {want}


@pytest.mark.parametrize("raw", [None, "", "  ", "soon", "TBA", "0000-00-00", "2026-02-30", "31/02/2026", "2026-13-40", "1/1", "undefined", "Invalid Date", "x" * 5000])
def test_no_reading(raw):
    assert readings(raw, SCRAPED, "UTC") == {}


def test_relative_needs_scraped_at():
    assert readings("2 days ago", None, "UTC") == {}


def test_orders_follow_declared_and_learn_where_none_is():
    counts = [("a", "2,0", 50), ("a", "-1,2", 3), ("b", "2,-1", 400), ("b", "2,2", 10)]
    chosen = fit_orders(counts, {"a": "DMY", "b": None})
    assert chosen["a", "2,0"][0] == "DMY"
    assert chosen["a", "-1,2"][0] == "MDY"
    assert chosen["b", "2,2"][0] == "DMY"


def test_times_over_odd_rows(spark):
    at = datetime(2026, 3, 10, 12)
    rows = spark.createDataFrame(
        [(1, "a", "03/04/2026", at, "x"), (2, "b", "03/04/2026", at, "x"), (3, None, "13/04/2026", at, "x"), (4, "a", None, at, "x"), (5, "zz", "2026-01-01", None, "x"), (5, "zz", "2026-01-01", None, "x")],
        "id int, source string, stamp string, scraped_at timestamp, at_sure string",
    )
    settings = spark.createDataFrame([("a", "UTC", "DMY"), ("b", "UTC", "MDY"), (None, None, None)], "source string, tz string, date_order string")
    out = normalise_times(rows, settings, ["id"], "stamp", "scraped_at").select("id", utc_text("posted_at").alias("t")).collect()
    assert sorted((r.id, r.t) for r in out if r.t) == [(1, "2026-04-03T00:00:00.000Z"), (2, "2026-03-04T00:00:00.000Z"), (3, "2026-04-13T00:00:00.000Z"), (5, "2026-01-01T00:00:00.000Z"), (5, "2026-01-01T00:00:00.000Z")]
    assert len(out) == 6
    assert normalise_times(rows.limit(0), settings, ["id"], "stamp", "scraped_at").count() == 0
    clash = rows.withColumns({c: F.lit("x") for c in ("tz", "date_order", "value", "sig", "form", "posted_at", "scraped_us")})
    assert normalise_times(clash, settings, ["id"], "stamp", "scraped_at").count() == 6


@pytest.mark.parametrize(
    "raw, want",
    [
        ("$110,000 - $130,000 + super", (110000, 130000, None, None)),
        ("120k - 140k", (120000, 140000, None, None)),
        ("$74-90 k pa incl. leave loading 17.5%", (74000, 90000, None, "year")),
        ("between €19,45 and €21,50, 38 hour roster", (19.45, 21.5, "EUR", None)),
        ("AU$4 300 – AU$5350 per month (4 days on, 3 off)", (4300, 5350, "AUD", "month")),
        ("Band 6: AU$91,500 - AU$104,500 a year - 2 positions", (91500, 104500, "AUD", "year")),
        ("up to $98,000", (None, 98000, None, None)),
        ("nzd 62 k+ + bonuses", (62000, None, "NZD", None)),
        ("$1,930 - $2 090 AUD a week - 2 positions", (1930, 2090, "AUD", "week")),
        ("S$2,300+ p.w. plus 12% super", (2300, None, "SGD", "week")),
        ("405/day incl. leave loading 17.5%", (405, 405, None, "day")),
    ],
)
def test_pay(raw, want):
    p = parse_pay(raw)
    assert (p.low, p.high, p.currency, p.period) == want


@pytest.mark.parametrize("raw", [None, "", "Level 5", "5 years experience", "DOE", "$$$", "Great bonuses + super", "12% super"])
def test_no_pay(raw):
    p = parse_pay(raw)
    assert p is None or (p.low is None and p.high is None)


def test_units_of_fields():
    assert [unit_of("currency", w) for w in ("Aus dollars", "$", "nzd", "", None)] == ["AUD", None, "NZD", None, None]
    assert [unit_of("period", w) for w in ("p.a.", "unknown", "YEAR", "/hr", "per diem", "fn", None)] == ["year", None, "year", "hour", "day", "fortnight", None]


def test_convert_pay(spark):
    rows = spark.createDataFrame(
        [
            ("1", "s", "text", "$50 an hour", None, None, None, None), ("2", "s", "text", "Level 5", None, None, None, None), ("3", "nz", "text", "$100,000", None, None, None, None),
            ("4", "s", "fields", "£81k–£88k", 81.0, 88.0, "gbp", "pa"), ("5", "s", "fields", None, None, 7750.0, "$", "month"), ("6", None, "fields", None, None, None, None, None),
            ("7", "s", "text", "up to $260", None, None, None, None), ("8", "s", "text", None, None, None, None, None),
        ],
        "k string, source string, kind string, raw string, low double, high double, currency string, period string",
    )
    factors = spark.createDataFrame([("currency", "AUD", 1.0), ("currency", "NZD", 0.9174), ("currency", "GBP", 1.9468), ("period", "year", 1.0), ("period", "hour", 1976.0), ("period", "month", 12.0)], "unit_kind string, unit_code string, factor double")
    settings = spark.createDataFrame([("s", "AUD"), ("nz", "NZD")], "source string, currency string")
    out = {r.k: (r.year_min, r.year_max) for r in convert_pay(rows, factors, settings, ["k"]).collect()}
    assert out == {"1": (98800, 98800), "3": (91740, 91740), "4": (157691, 171318), "5": (-1, 93000), "6": (-1, -1)}
    assert convert_pay(rows.limit(0), factors, settings, ["k"]).count() == 0
    clash = rows.withColumns({c: F.lit("x") for c in ("fallback", "year_min", "_cf", "unit_code", "is_field")})
    assert convert_pay(clash, factors, settings, ["k"]).count() == 5


def test_hash_is_sparks(spark):
    rows = spark.range(-50, 50).select(F.col("id").alias("a"), (F.col("id") * 7919).alias("b")).withColumn("h", F.xxhash64("a", "b", F.lit(7))).toPandas()
    assert (S.spark_hash(rows["a"].to_numpy(), rows["b"].to_numpy(), 7).view(np.int64) == rows["h"].to_numpy()).all()


def _snapshots(spark, seed, n):
    rng = np.random.RandomState(seed)
    rows = []
    for no in range(1, 5):
        for delivery in range(1, 1 + (no == 2) + 1):
            for i in range(n):
                if rng.rand() < 0.8:
                    rows.append((no, delivery, f"id{i}", int(rng.randint(0, 3)), " v" if rng.rand() < 0.2 else "v"))
    return spark.createDataFrame(rows * 2, "no int, delivery int, id string, v int, w string").withColumn("seen", F.lit("2026-01-01").cast("timestamp"))


def _brute(rows):
    state = {}
    last = {}
    for r in rows:
        last[r.no] = max(last.get(r.no, 0), r.delivery)
    for r in rows:
        if r.delivery == last[r.no]:
            state.setdefault(r.no, {})[r.id] = (r.v, r.w.strip())
    out = set()
    for a, b in zip(sorted(state), sorted(state)[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.add((b, k, "added"))
            elif k not in state[b]:
                out.add((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                out.add((b, k, "changed"))
    return out


@pytest.mark.parametrize("bucket_rows, share", [(16, 1.5), (64, 0.2), (64, 0.02)])
def test_snapshot_diff_is_brute_force(spark, bucket_rows, share):
    rows = _snapshots(spark, 3, 60)
    digest = F.xxhash64("v", S.trimmed("w"))
    got = S.diff_snapshots(rows, "no", "delivery", "id", "seen", digest, bucket_rows, share).collect()
    assert {tuple(r) for r in got} == _brute(rows.collect()) and len(got) == len({tuple(r) for r in got})


def test_snapshot_diff_odd_tables(spark):
    rows = _snapshots(spark, 4, 5)
    digest = F.xxhash64("v")
    assert S.diff_snapshots(rows.limit(0), "no", "delivery", "id", "seen", digest).count() == 0
    assert S.diff_snapshots(rows.filter("no = 1"), "no", "delivery", "id", "seen", digest).count() == 0
    holes = rows.limit(3).select("no", "delivery", F.lit(None).cast("string").alias("id"), "v", "w", "seen")
    assert S.diff_snapshots(holes, "no", "delivery", "id", "seen", digest).count() == 0


def test_snapshot_tables_subtract_and_peel():
    rng = np.random.RandomState(1)
    now, prior = (rng.randint(-(2**62), 2**62, (2, 400)).astype(np.int64) for _ in range(2))
    shared = rng.randint(-(2**62), 2**62, (2, 3000)).astype(np.int64)
    now, prior = np.hstack([shared, now]), np.hstack([shared, prior])
    m = S.cells_for(800)
    left = S.subtracted(S.table_of(*now, m), S.table_of(*prior, m))
    *found, done = S.peel(left)
    assert done and 600 < S.expected_elements(left) < 1000
    key = lambda f: sorted(zip(*(x.tolist() for x in f)))
    assert key(found) == key(S.compared(now, prior)) and len(found[0]) == 800
    assert not S.peel(S.subtracted(S.table_of(*now, 300), S.table_of(*prior, 300)))[3]


def test_unfounded_elements_send_their_bucket_to_exact_comparison(spark, monkeypatch):
    """A recovered element that no row of its snapshot has is not believed."""
    rows = _snapshots(spark, 6, 40)
    real = S.subtract_tables
    wrong = "kind <> 'failed' AND pmod(kh, 2) = 0"
    monkeypatch.setattr(S, "subtract_tables", lambda *a: real(*a).withColumn("digest", F.when(F.expr(wrong), F.col("digest") + 1).otherwise(F.col("digest"))))
    got = S.diff_snapshots(rows, "no", "delivery", "id", "seen", F.xxhash64("v", S.trimmed("w")), 64, 4.0).collect()
    assert {tuple(r) for r in got} == _brute(rows.collect())


def test_a_snapshot_without_rows_of_a_bucket(spark):
    """Few ids over many buckets, one snapshot nearly empty, and one id that makes up most rows."""
    rows = [(1, f"a{i}", 0) for i in range(30)] + [(2, "a1", 0)] + [(3, f"a{i}", i % 2) for i in range(30)] + [(3, "a5", 1)] * 300
    table = spark.createDataFrame(rows, "no int, id string, v int").withColumns({"delivery": F.lit(None).cast("int"), "seen": F.lit(None).cast("timestamp")})
    got = sorted(tuple(r) for r in S.diff_snapshots(table, "no", "delivery", "id", "seen", F.xxhash64("v"), 2, 1.0).collect())
    want = [(2, f"a{i}", "removed") for i in range(30) if i != 1] + [(3, f"a{i}", "added") for i in range(30) if i != 1] + [(3, "a1", "changed")]
    assert got == sorted(want)


def test_values_overrule_the_declared_order(spark):
    """A source declared day first whose values can only be month first: what could be both is read month first."""
    rows = [("s", f"{1 + i % 9:02d}/{13 + i % 15}/2026") for i in range(600)] + [("s", "03/04/2026"), ("t", "03/04/2026")]
    table = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "id long, source string, v string").withColumn("seen", F.lit("2026-12-01").cast("timestamp"))
    settings = spark.createDataFrame([("s", "UTC", "DMY"), ("t", "UTC", "DMY")], "source string, tz string, date_order string")
    got = {r.id: r for r in normalise_times(table, settings, ["id"], "v", "seen").collect()}
    assert (got[600].date_form, str(got[600].posted_at)[:10], got[600].ambiguous) == ("MDY", "2026-03-04", False)
    assert (got[601].date_form, str(got[601].posted_at)[:10]) == ("DMY", "2026-04-03")
    assert all(got[i].date_form == "MDY" for i in range(600))


def test_times_that_occur_twice_are_marked(spark):
    """Melbourne puts its clocks back on 5 April 2026 at 3: half past two comes twice, the earlier one is taken."""
    cases = {"2026-04-05 02:30": ("2026-04-04 15:30:00", True), "2026-04-05 02:30 AEST": ("2026-04-04 16:30:00", False), "2026-04-05 04:30": ("2026-04-04 18:30:00", False), "2026-04-05 2:30 am": ("2026-04-04 15:30:00", True), "2026-04-05": ("2026-04-04 13:00:00", False)}
    table = spark.createDataFrame([(v, "s", v) for v in cases], "id string, source string, v string").withColumn("seen", F.lit(None).cast("timestamp"))
    settings = spark.createDataFrame([("s", "Australia/Melbourne", "DMY")], "source string, tz string, date_order string")
    out = normalise_times(table, settings, ["id"], "v", "seen")
    got = {r.id: (r.at, r.ambiguous, r.confidence) for r in out.select("id", "ambiguous", "confidence", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    assert got == {v: (at, twice, 0.5 if twice else 1.0) for v, (at, twice) in cases.items()}


def test_long_ago_is_no_time_before_the_first_year(spark):
    assert readings("1000000 days ago", 1_700_000_000_000_000, None) == {} and readings("150000 hours ago", 1_700_000_000_000_000, None) != {}


def test_two_digit_years_may_come_first(spark):
    assert set(readings("26/11/05", None, None)) == {"DMY", "YMD"} and set(readings("01/02/03", None, None)) == {"DMY", "MDY", "YMD"}
    assert set(readings("04/04/2026", None, None)) == {"sure"}
