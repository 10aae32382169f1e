"""Repeats against brute force: spellings one or two edits apart, places missing or spelled otherwise."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewell.llm import history as H
from tidewell.llm.vacancies import better_words

DAY = 86_400_000_000
SCHEMA = "id long, source string, title string, rank string, company string, place_id long, place string, at long"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _mistyped(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("xyz") + text[k + 1 :], text[:k] + rng.choice("xyz") + text[k:]])
    return " ".join(sorted(text.split()))


def _same(a, b):
    if a[1] != b[1] or a[3] != b[3] or abs(a[7] - b[7]) > 10 * DAY or _edits(a[2], b[2]) > 2 or _edits(a[4], b[4]) > 2:
        return False
    if a[5] >= 0 and b[5] >= 0:
        return a[5] == b[5]
    return a[6] is None or b[6] is None or _edits(a[6], b[6]) <= 2


def _rows(seed, n):
    """Couples of postings of one vacancy, far from all others in title; the second is spelled otherwise."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 8)))
    rows = []
    for k in range(n):
        title, company = (" ".join(sorted(word() for _ in range(rng.randint(1, 2)))) for _ in range(2))
        listed, place, at = rng.choice([3, -1]), word(), rng.randint(0, 60) * DAY
        rows.append((2 * k, "a", title, "", company, listed, place, at))
        other = (listed, place) if listed >= 0 else (-1, _mistyped(rng, place, rng.randint(0, 2)))
        other = rng.choice([other, other, (-1, None)])
        rows.append((2 * k + 1, "a", _mistyped(rng, title, rng.randint(0, 2)), "", _mistyped(rng, company, rng.randint(0, 2)), *other, at + rng.randint(0, 9) * DAY))
    return rows


def _raw(postings):
    """Rows as delivered; without a column key each is a posting of its own."""
    none = F.lit(None).cast("string")
    return postings.select("id", "source", F.col("key" if "key" in postings.columns else "id").cast("string").alias("key"), "title", "company", none.alias("location_raw"), none.alias("posted_at_raw"), F.lit(None).cast("timestamp").alias("scraped_at"))


@pytest.fixture
def fields_as_they_are(monkeypatch, tmp_path):
    """Postings whose fields are read as they are given; they are kept as files, for sessions of any number."""

    def use(postings):
        _raw(postings).write.parquet(f"{tmp_path}/raw")
        postings.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(f"{tmp_path}/fields")
        monkeypatch.setattr(H, "vacancy_fields", lambda rows, *more: rows.sparkSession.read.parquet(f"{tmp_path}/fields").join(rows.select("id"), "id", "left_semi"))
        return postings.sparkSession.read.parquet(f"{tmp_path}/raw")

    return use


@pytest.mark.parametrize("seed", [1])
def test_other_spellings_are_found_as_by_brute_force(spark, seed, fields_as_they_are, tmp_path):
    rows = _rows(seed, 100)
    want = {}
    for i, b in enumerate(rows):
        want[b[0]] = min([want[a[0]] for a in rows[:i] if _same(a, b)], default=b[0])
    assert sum(i != first for i, first in want.items()) >= 80
    raw = fields_as_they_are(spark.createDataFrame(rows, SCHEMA))
    for n, deliveries in enumerate(([F.lit(True)], [F.col("id") % 2 == 0, F.col("id") % 2 == 1])):
        got = {r.id: r.root for r in H.repeats(raw, None, None, deliveries, f"{tmp_path}/{n}").collect()}
        assert got == {i: first for i, first in want.items() if i != first}


def _postings(spark):
    """Few contents in three spells of ten days; two in five postings are scraped again under the same number."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        again = rng.choice(rows) if rows and rng.random() < 0.4 else None
        key = again[8] if again else f"k{i}"
        source = again[1] if again else rng.choice("ab")
        day = rng.choice([0, 40, 80]) + rng.randint(0, 9)
        rows.append((i, source, rng.choice(["baker tram", "diver gas", "nurse crane tower"]), rng.choice(["", "senior"]), rng.choice(["amber steel", "birch foods"]), rng.choice([1, -1]), rng.choice(["fern creek", None]), day * DAY, key))
    rows += [(300, "a", "", "", "", -1, None, None, "x"), (301, None, "baker tram", "", "amber steel", 1, "fern creek", 0, None), (302, None, "", "", "", 1, None, None, None), (303, "a", "", "", "", -1, None, None, "x")]
    return spark.createDataFrame(rows, SCHEMA + ", key string"), rows


def test_three_sessions_give_what_one_gives(spark, fields_as_they_are, tmp_path, monkeypatch):
    """Each delivery is taken in by a session that knows only the path; partitions are so small that the store grows."""
    monkeypatch.setattr(H, "PER_PART", 150)
    postings, rows = _postings(spark)
    raw = fields_as_they_are(postings)
    whole = {r.id: r.root for r in H.repeats(raw, None, None, [F.lit(True)], f"{tmp_path}/one").collect()}
    cuts = [F.col("id") < 80, (F.col("id") >= 80) & (F.col("id") < 200), F.col("id") >= 200]
    got, parts = {}, []
    for holds in cuts:
        session = spark.newSession()
        history = H.History.open(session, f"{tmp_path}/three")
        found = history.accept(session.read.parquet(f"{tmp_path}/raw").filter(holds), None, None)
        got |= {r.id: r.root for r in found.collect()}
        parts.append(history.state["parts"])
        assert history.asked_parts[0] <= history.asked_parts[1]
    assert got == whole and parts[0] < parts[-1] and history.state["version"] == 3
    assert whole[302] == 301 and whole[303] == 300
    first = {}
    for r in rows:
        key = (r[1], r[8])
        assert first.setdefault(key, r[0]) == r[0] or whole[r[0]] <= first[key]
    # A version whose record is missing was never taken in: the delivery comes again.
    shutil.rmtree(tmp_path / "three" / "state" / "v=3")
    again = H.History.open(spark, f"{tmp_path}/three")
    assert again.state["version"] == 2
    assert {r.id: r.root for r in again.accept(raw.filter(cuts[2]), None, None).collect()} == {i: a for i, a in got.items() if i >= 200}
    assert again.accept(raw.limit(0), None, None).count() == 0 and again.state["version"] == 3


def test_few_partitions_are_read_for_a_small_delivery(spark, fields_as_they_are, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "PER_PART", 40)
    raw = fields_as_they_are(spark.createDataFrame(_rows(2, 80), SCHEMA))
    H.repeats(raw, None, None, [F.col("id") < 159], f"{tmp_path}/h")
    history = H.History.open(spark, f"{tmp_path}/h")
    history.accept(raw.filter("id = 159"), None, None)
    assert history.state["parts"] >= 8 and 1 <= history.asked_parts[0] <= history.asked_parts[1] // 2


def test_mending_depends_on_ratios_only(spark):
    counts = [("title", "software", 5000), ("title", "sofware", 40), ("title", "sofwae", 3), ("title", "baker", 20), ("title", "bakr", 1), ("title", "tram", 90), ("company", "sofwae", 3), ("title", "hatter", 9)]
    make = lambda times: spark.createDataFrame([(k, w, n * times) for k, w, n in counts], "kind string, word string, n long")
    got = [{(r.kind, r.word): r.better for r in better_words(make(times)).collect()} for times in (1, 1000)]
    assert got[0] == got[1] == {("title", "sofware"): "software", ("title", "sofwae"): "software", ("title", "bakr"): "baker"}


def test_near_spellings_are_brute_force(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab+ ") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    asked, known = texts[::2], texts[::3]
    make = lambda words: spark.createDataFrame([("title", w) for w in words], "kind string, text string")
    got = {(r.text, r.near) for r in H.near_spellings(make(asked), make(known)).collect()}
    assert got == {(x, y) for x in asked for y in known if _edits(x, y) <= 2}
