"""Posting functions and operators: pinned pairs, models in plain Python, odd tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.functions import text as X
from tidewell.operators import corpus, merge, resolve, runs, status, tables, writeback
from tidewell.operators.connect import lowest_linked


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [("Acme Pty Ltd", "acme"), ("A & B Group", "a and b"), (None, ""), ("Globex (Australia) Limited", "globex")])
def test_company(spark, raw, want):
    assert one(spark, raw, P.normal_company) == want


@pytest.mark.parametrize(
    "raw, want",
    [("URGENT: Engineer (Remote)", "engineer"), ("Tester | Hybrid", "tester"), ("C# Developer — Full Time", "c# developer"), ("Associate Software Engineer", "software engineer"), ("Nurse - Night", "nurse night"), (None, "")],
)
def test_title(spark, raw, want):
    assert one(spark, raw, P.normal_title) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("$110,000 – $130,000 + super", (110000, 130000, "year")), ("120k - 140k", (120000, 140000, "year")), ("$750 - $850 per day", (750, 850, "day")), ("$65 p.h.", (65, None, "hour")),
        ("Up to $150,000", (None, 150000, "year")), ("AUD 38.89 per hour", (38.89, None, "hour")), ("$70,000 + super + salary up to $18,550!", (18550, 70000, "year")), ("", None), (None, None),
    ],
)
def test_salary(spark, raw, want):
    r = one(spark, raw, P.salary_label)
    assert (None if r is None else (r.pay_min, r.pay_max, r.period)) == want


def test_location(spark):
    rows = spark.createDataFrame([("Sydney, New South Wales",), ("Brisbane",), ("CBD & Inner Suburbs, Melbourne VIC",), ("Auckland, New Zealand",), ("Remote",), (None,)], "v string")
    got = [tuple(r.l)[1:] for r in rows.select(P.location(F.col("v"), F.lit(None).cast("boolean")).alias("l")).collect()]
    assert got == [("Sydney", "NSW", "AU", False), ("Brisbane", "QLD", "AU", False), ("Melbourne", "VIC", "AU", False), ("Auckland", None, "NZ", False), ("Remote", None, "AU", True), (None, None, "AU", False)]


@pytest.mark.parametrize("raw, title, want", [("Full time", "", "full-time"), ("Contract/Temp", "", "contract"), ("Casual", "", "casual"), ("Part time", "", "part-time"), (None, "Graduate Program", "internship"), ("", "Nurse", "unknown")])
def test_employment(spark, raw, title, want):
    assert spark.createDataFrame([(raw, title)], "a string, b string").select(P.employment_type(F.col("a"), F.col("b")).alias("r")).first().r == want


def test_tags(spark):
    rows = spark.createDataFrame([("Senior Java Developer", "mentored by juniors, javascript and React"), ("Nurse", "with senior staff; go engineer"), (None, None)], "t string, b string")
    got = [r.x for r in rows.select(P.tags(F.col("t"), F.col("b")).alias("x")).collect()]
    assert got == [["java", "javascript", "react", "senior"], ["go"], []]


def test_names(spark):
    rows = spark.createDataFrame([("Acme", "Data Analyst, Night - Remote"), ("A Very Long Company Name Of Many Words", "Engineer " * 20), ("X", "")], "c string, t string")
    stems = [r.s for r in rows.select(P.file_stem("CV", F.col("c"), F.col("t"), "2026").alias("s")).collect()]
    assert all(len(s) <= 75 for s in stems) and stems[0] == "CV_Acme_Data_Analyst_Night_Remote_2026" and stems[2] == "CV_X_Role_2026" and "AVLCNOMW" in stems[1]
    assert one(spark, "con", P.folder_name) == "con Co" and one(spark, " .. ", P.folder_name) == "Unknown company" and one(spark, 'a/b:c*"d. ', P.folder_name) == "a b c d"


def test_texts(spark):
    assert one(spark, "2,000+ tests, three cycles, SIT331, Vue3, ~35s", X.numbers_in) == ["2000", "35", "3"]
    assert one(spark, "One. Two!  Three?\n\nFour", X.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, "a b", X.trigrams) == [] and one(spark, "a b c d", X.trigrams) == ["a b c", "b c d"]
    assert one(spark, "<p>Hi&nbsp;<b>you</b></p><ul><li>x</li></ul><script>z</script>", X.strip_html) == "Hi you\n- x"
    assert one(spark, None, X.collapse) == "" and one(spark, "a  b\n", X.collapse) == "a b" and one(spark, " ", X.word_count) == 0


def test_liveness(spark):
    rows = spark.createDataFrame([("seek", '{"isExpired": true}'), ("seek", '{"isExpired":false}'), ("linkedin", "<a class='apply-button'>"), ("linkedin", "No longer accepting applications"), ("other", "x"), ("seek", None)], "s string, h string")
    assert [r.x for r in rows.select(P.liveness(F.col("s"), F.col("h")).alias("x")).collect()] == ["expired", "open", "open", "expired", "unknown", "unknown"]


def _model(rows, least=0.8):
    """One by one, over everything: what the operator must equal."""
    ids, fps, leaders, out = {}, {}, [], {}
    for seq, source, key, fp, firm, tokens in sorted(rows):
        words = set(tokens)
        if key in ids:
            out[seq] = (ids[key], "updated")
            continue
        lead, kind = fps.get(fp), "merged"
        if lead is None:
            for number, s, f, theirs in leaders:
                both = len(words & theirs)
                if s != source and f == firm and both and both >= least * len(words | theirs):
                    lead = number
                    break
        if lead is None:
            lead, kind = seq, "new"
            fps[fp] = seq
            leaders.append((seq, source, firm, words))
        ids[key] = lead
        out[seq] = (lead, kind)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolution_in_order_is_one_by_one(spark, seed):
    rng = random.Random(seed)
    words = ["tram", "welder", "senior", "night", "lead", "x"]
    rows = []
    for i in range(400):
        tokens = sorted({rng.choice(words) for _ in range(rng.randint(0, 6))})
        firm = rng.choice(["", "acme", "birch"])
        rows.append((i, rng.choice("ab"), f"id{rng.randint(0, 250)}", f"{' '.join(tokens)}|{firm}|{rng.choice('12')}", firm, tokens))
    df = spark.createDataFrame(rows, "seq long, source string, id string, fp string, company_key string, tokens array<string>")
    got = {r.seq: (r.leader, r.status) for r in resolve.resolve_in_order(df).collect()}
    assert got == _model(rows)
    assert resolve.resolve_in_order(df.limit(0)).count() == 0


def test_links(spark):
    df = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (3, 9)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.id: r.root for r in lowest_linked(df).collect()}
    assert got == {**{i: 3 for i in (3, 7, 8, 9)}, 20: 20, 21: 20, 5: 5, **{i: 100 for i in range(100, 141)}}
    assert lowest_linked(df.limit(0)).count() == 0


def test_merge_fold(spark):
    rows = [(1, "k", "", None, "aa", None, "unknown", ["x", "y"]), (2, "k", "T", 5, "bbb", "m1", "full", ["z", "x"]), (3, "k", "U", 6, "ccc", None, "part", None), (4, "n", None, None, None, None, None, [])]
    df = spark.createDataFrame(rows, "seq long, id string, t string, v int, d string, m string, e string, tags array<string>").repartition(3)
    out = {r.id: r for r in merge.merge_fold(df, "id", ("t",), ("v",), ("d",), ("m",), {"e": "unknown"}, ("tags",)).collect()}
    assert tuple(out["k"])[1:] == (3, "T", 5, "bbb", "m1", "full", ["x", "y", "z"])
    assert out["n"].n_seen == 1 and out["n"].t is None and out["n"].tags == []


def test_upsert_twice_is_upsert_once(spark):
    state = spark.createDataFrame([("a", "old", 1), ("b", None, 2)], "id string, t string, s int")
    batch = spark.createDataFrame([("a", "new", 9), ("c", "c", 3), ("b", None, None)], "id string, t string, s int")
    once = merge.upsert(state, batch, "id", keep=("s",))
    want = {("a", "new", 1), ("b", None, 2), ("c", "c", 3)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in merge.upsert(once, batch, "id", keep=("s",)).collect()}


def test_status(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", 1, t, "good"), ("a", 1, t, "good"), ("a", 3, t + timedelta(1), "done"), ("a", 2, t + timedelta(2), "good"), ("b", 1, t, None), ("c", 1, t, "done")]
    df = spark.createDataFrame(rows, "job_id string, seq int, event_at timestamp, to_status string")
    got = {tuple(r) for r in status.fold_status(df, [("new", "good"), ("good", "done")], "new").collect()}
    assert got == {("a", "done", 2, 1), ("b", "new", 0, 1), ("c", "new", 0, 1)}
    assert {(r.job_id, r.to_status) for r in status.last_event(df).collect()} == {("a", "good"), ("b", None), ("c", "done")}


def test_missed_runs(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, "s", t, ["a", "b", None]), (2, "s", t + timedelta(1), ["b"]), (3, "s", t + timedelta(2), []), (4, "s", t + timedelta(3), None), (5, "q", t, ["a"])]
    df = spark.createDataFrame(rows, "run_id long, source string, finished_at timestamp, seen_ids array<string>")
    assert {tuple(r) for r in status.missed_runs(df).collect()} == {("a", "s", 3, True), ("b", "s", 2, False), ("a", "q", 0, False)}
    hits = spark.createDataFrame([("k", i, h) for i, h in enumerate([True, False, False, True, False])], "k string, at int, hit boolean")
    assert [r.streak for r in status.miss_streaks(hits, "k", "at", "hit").orderBy("at").collect()] == [0, 1, 2, 0, 1]


def test_expected_fetch(spark):
    t = datetime(2026, 1, 1)
    rows = [(i, "s", "q", "l", t + timedelta(i), f) for i, f in enumerate([60, 62, 66, 1, 70])]
    df = spark.createDataFrame(rows, "run_id long, source string, search_query string, search_location string, finished_at timestamp, fetched int")
    assert [r.expected and round(r.expected, 2) for r in runs.expected_fetch(df).orderBy("run_id").collect()] == [None, None, None, 62.67, 43.0]
    assert [r.run_id for r in runs.below_floor(df).collect()] == [3]


def test_cells(spark):
    cases = [("", "x", None, "push"), (None, None, None, "none"), ("x ", "x", None, "none"), ("old", "new", "old", "push"), ("edit", "new", "old", "pull"), ("edit", "new", None, "pull"), ("edit", "", "x", "pull")]
    df = spark.createDataFrame([(t, o, a) for t, o, a, _ in cases], "t string, o string, a string")
    assert [r.x for r in df.select(tables.decide_cell(F.col("o"), F.col("t"), F.col("a")).alias("x")).collect()] == [c[3] for c in cases]


def test_similar_sentences_are_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(30)]
    base = [[rng.choice(vocab) for _ in range(14)] for _ in range(15)]

    def edited(words):
        words = list(words)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return " ".join(words)

    docs = [(i, ". ".join(edited(rng.choice(base)) for _ in range(3))) for i in range(30)] + [(99, None), (98, "short.")]
    items = [(i, " ".join(b)) for i, b in enumerate(base)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in corpus.similar_sentences(a, b, "doc_id", "item_id").collect()}
    grams = lambda s: {tuple(s.split()[i : i + 3]) for i in range(len(s.split()) - 2)}
    want = set()
    for i, t in docs:
        for s in (t or "").split(". "):
            for j, u in items:
                x, y = grams(s), grams(u)
                if len(s.split()) >= 10 and len(x & y) >= 0.5 * len(x | y):
                    want.add((i, j, round(len(x & y) / len(x | y), 6)))
    assert got == want


def test_unfounded_numbers(spark):
    texts = spark.createDataFrame([(1, "Cut build times by 40 percent. Led 7 nurses."), (2, "no numbers"), (3, None)], "doc_id long, text string")
    facts = spark.createDataFrame([("reduced the build time by 40",), ("7 apples",)], "fact string")
    assert {tuple(r) for r in corpus.unfounded_numbers(texts, facts, "doc_id").collect()} == {(1, "7")}


def test_write_back(spark):
    state = spark.createDataFrame([("a", "new", 1), ("b", None, 2), ("c", "good", 3)], "id string, st string, n int")
    said = spark.createDataFrame([("a", "good"), ("b", "good"), ("c", "good"), ("z", "good"), ("a", None)], "id string, v string")
    judged = writeback.judge(state, said, "id", "st", "v", [("new", "good")])
    assert {tuple(r) for r in judged.collect()} == {
        ("a", "good", None), ("b", "good", "cannot move from  to good"), ("c", "good", "already good"), ("z", "good", "unknown id"), ("a", "", "cannot move from new to "),
    }
    assert {tuple(r) for r in writeback.write_back(state, judged, "id", "st", "v").collect()} == {("a", "good", 1), ("b", None, 2), ("c", "good", 3)}


def test_checks(spark):
    now, old = datetime(2026, 1, 2), datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", None, None), ("b", now, None), ("c", old, None), ("d", old, old)], "id string, checked_at timestamp, expired_at timestamp")
    at = F.lit(now)
    assert {r.id for r in writeback.due(rows, "checked_at", at, 6, F.col("expired_at").isNull()).collect()} == {"a", "c"}
    pages = spark.createDataFrame([("a", 404, None), ("b", 500, None), ("c", 200, "open")], "id string, status int, html string")
    got = {r.id: (r.checked_at, r.expired_at) for r in writeback.mark_checked(rows, pages, "id", F.lit("open"), at).collect()}
    assert got == {"a": (now, now), "b": (now, None), "c": (now, None), "d": (old, old)}
