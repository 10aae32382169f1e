"""Places, near-duplicates, matching and history against brute force and known cases."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.llm.matching import match_across, matched
from tidewell.llm.near import expand_pairs, near_duplicates
from tidewell.llm.places import map_places, match_names
from tidewell.llm.vacancies import vacancy_fields

PLACES = [
    (1, "Fern Creek", "WA", "AU", ["Old Gully"]), (2, "Twin Hill", "VIC", "AU", []), (3, "Twin Hill", "TAS", "AU", None), (4, "Nordhaven", None, "DE", []), (5, None, "NSW", "AU", ["Port Ellan"]),
]
SCHEMA = "place_id long, city string, state string, country string, aliases array<string>"


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, SCHEMA)


@pytest.mark.parametrize("k", [1])
def test_place_names(spark, places, k):
    cases = {
        "Fern Ck WA": 1, "fern  creek, West Australia": 1, "FRN CREEEK": 1, "Fern Brook": -1, "Old Gulli": 1, "Twin Hill": -1, "Twin Hill, Vic.": 2, "Remote / Twin Hil Tasmania": 3,
        "Nordhaven (Deutschland)": 4, "Northern Suburbs, Nordhaven": 4, "Remote": -1, "  ": -1, "": -1, "Pt Ellan NSW": 5, "x" * 4000: -1, "Fern Creek | Hybrid": 1, "Férn Creek 6111": 1,
    }
    texts = spark.createDataFrame([(c, "raw", c) for c in cases] + [("none", "raw", None)], "whole string, part string, txt string")
    got = {r.whole: r.place_id for r in map_places(texts, places).collect()}
    assert got == {**cases, "none": -1}


def test_fields_are_read_together(spark, places):
    texts = spark.createDataFrame([("a", "city", "Twin Hill"), ("a", "state", "TAS"), ("b", "city", "Twin Hill"), ("b", "raw", "Twin Hill Victoria"), ("c", "state", "WA")], "whole string, part string, txt string")
    assert {r.whole: r.place_id for r in map_places(texts, places).collect()} == {"a": 3, "b": 2, "c": -1}
    assert map_places(texts.limit(0), places).count() == 0
    assert {r.place_id for r in map_places(texts, places.limit(0)).collect()} == {-1}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pigeonhole_join_loses_nothing(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    refs, names = sorted({make() for _ in range(60)}), sorted({make() for _ in range(200)})
    table = spark.createDataFrame([(i, r, None, None, []) for i, r in enumerate(refs)], SCHEMA)
    got = {(r.name, r.ref, r.edits) for r in match_names(spark.createDataFrame([(n,) for n in names], "name string"), table).collect()}
    assert got == {(n, r, _edits(n, r)) for n in names for r in refs if _edits(n, r) <= 2}


def _texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(80)]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[20:] + words[:20]
            rows.append((len(rows), rng.choice(["Title One", None, ""]), " ".join(words)))
    rows += [(900, "t", None), (901, "t", ""), (902, "t", "few words only"), (903, None, rows[0][2]), (904, None, rows[0][2].upper() + " !")]
    return rows


def _pairs(rows, size, least, least_words):
    sets = {}
    for i, t, d in rows:
        w = re.findall("[a-z0-9]+", (d or "").lower())
        if len(w) >= least_words:
            w = re.findall("[a-z0-9]+", (t or "").lower()) + w
            sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_near_duplicates_are_brute_force(spark):
    rows = _texts(11)
    texts = spark.createDataFrame(rows, "id long, lead string, body string").repartition(3)
    pairs, members = near_duplicates(texts, size=3, least=0.6, least_words=30)
    got = [(r.a, r.b) for r in expand_pairs(pairs, members).collect()]
    want = _pairs(rows, 3, 0.6, 30)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.97 * len(want)
    empty, none = near_duplicates(texts.limit(0))
    assert empty.count() == 0 and none.count() == 0


RAW = "id long, source string, title string, company string, location_raw string, posted_at_raw string, scraped_at timestamp"
T0 = datetime(2026, 3, 1)


def _vacancies():
    """Made-up vacancies on two boards, with decoys that differ in one thing; returns rows and true pairs."""
    rng = random.Random(9)
    jobs = ["Tram Welder", "Tax Carer", "Crane Editor", "Gas Nurse", "Library Baker", "Museum Diver", "Kitchen Planner", "Orchard Fitter"]
    firms = ["Amber Steel", "Birch Foods", "Cedar Print", "Dune Health", "Ember Rail", "Flint Homes"]
    rows, same, n = [], set(), 0
    for k in range(150):
        title, firm, place = rng.choice(jobs), rng.choice(firms), rng.choice(["Fern Creek WA", "Nordhaven"])
        at = T0 + timedelta(days=40 * k)
        spelled = rng.choice([title, f"URGENT: {title}", f"{title} | Hybrid", title.upper(), title.replace("r", "rr", 1)])
        rows.append((n, "a", title, firm + " Pty Ltd", place, at.isoformat() + "Z", at))
        kind = k % 4
        rows.append((n + 1, "b", f"Senior {title}" if kind == 1 else spelled, firm.lower() + " group", place if kind != 2 else "Twin Hill VIC", (at + timedelta(days=3 if kind != 3 else 29)).isoformat() + "Z", at))
        if kind == 0:
            same.add((n, n + 1))
        n += 2
    return rows + [(n, None, None, None, None, None, None), (n + 1, "a", "", " ", "", "soon", T0)], same


def test_matching_across_boards(spark, places):
    rows, same = _vacancies()
    settings = spark.createDataFrame([("a", "UTC", "DMY"), ("b", "UTC", "DMY")], "source string, tz string, date_order string")
    fields = vacancy_fields(spark.createDataFrame(rows, RAW), places, settings)
    assert fields.count() == len(rows)
    got = {(r.a, r.b) for r in matched(match_across(fields)).collect()}
    assert got <= same and len(got) >= 0.95 * len(same)
    assert match_across(fields.limit(0)).count() == 0


FIELDS = "id long, source string, title string, rank string, company string, place_id long, place string, at long"
DAY = 86_400_000_000


def _fields(spark, more):
    """150 vacancies far apart in time, two in three on two boards, and `more` rows."""
    rng = random.Random(2)
    rows = []
    for k in range(150):
        title, firm = rng.choice(["baker tram", "diver gas", "crane nurse"]), rng.choice(["amber steel", "birch foods", "cedar print"])
        rows.append((2 * k, "a", title, "", firm, 1, "fern creek", 40 * k * DAY))
        if k % 3:
            rows.append((2 * k + 1, "b", title, "", firm, 1, "fern creek", (40 * k + rng.randint(0, 9)) * DAY))
        else:
            rows.append((2 * k + 1, "b", title, "senior", firm, 2, "nordhaven", (40 * k + 5) * DAY))
    return spark.createDataFrame(rows + more, FIELDS)


def test_implied_pairs_without_a_block_are_candidates(spark):
    at = 9000 * DAY
    more = [(900, "a", "glass painter", "", "dune health", 3, "nordhaven", at), (901, "b", "glass painter", "", "dune heath", 3, "nordhaven", at + DAY), (902, "c", "glass paintr", "", "dune heath", 3, "nordhaven", at + 2 * DAY)]
    got = {(r.a, r.b): r.confidence for r in match_across(_fields(spark, more)).collect()}
    assert all(got[p] >= 0.5 for p in ((900, 901), (901, 902), (900, 902)))


def test_constraints_move_all_three_posteriors(spark):
    """A row without a place agrees with rows of two places that cannot both be it."""
    at = 9000 * DAY
    more = [(900, "a", "glass painter", "", "dune health", 3, "nordhaven", at), (901, "b", "glass painter", "", "dune health", -1, None, at), (902, "c", "glass painter", "", "dune health", 4, "twin hill", at)]
    got = {(r.a, r.b): r.confidence for r in match_across(_fields(spark, more)).collect()}
    assert got[900, 902] < 0.5 and max(got[900, 901], got[901, 902]) < 0.9
    assert got[900, 901] + got[901, 902] - 1 <= got[900, 902] + 1e-6
