"""Wording functions: pinned pairs."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.functions import text as X
from tidewell.functions import wording as W
from tidewell.sources import boards


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("Junior Welder - Fern Bank, QLD", "Junior Welder"), ("Welder (Casual) [Perth]", "Welder"), ("Welder | Melbourne", "Welder"), ("Welder - Trams", "Welder - Trams"), (None, ""), ("Welder -", "Welder"),
    ("Welder of very long seams and of very short seams, nights", "Welder of very long seams and of very short seams"),
])
def test_headline(spark, raw, want):
    assert one(spark, raw, W.headline) == want


@pytest.mark.parametrize("raw, want", [("Acme Limited", "Acme"), ("Acme Pty. Ltd.", "Acme"), ("Group", "Group"), ("Acmegroup", "Acmegroup"), (None, None)])
def test_prose_name(spark, raw, want):
    assert one(spark, raw, W.prose_name) == want


@pytest.mark.parametrize("text, term, want", [
    ("C# and c#, C#", "C#", 3), ("C and C# and C++", "C", 1), ("uses .NET, ASP.NET", ".NET", 1), ("Node.js Node.js", "Node.js", 2), ("CI/CD", "CI/CD", 1), ("careful care. care", "care", 2), (None, "care", 0), ("", "care", 0),
])
def test_terms_as_words(spark, text, term, want):
    assert one(spark, text, lambda c: W.term_count(c, term)) == want


def test_titles_mentioned(spark):
    rows = [("We want a sales assistant now", "Sales Assistant - Fern Creek (Casual)", True), ("We want a sales person", "Sales Assistant", False), (None, "Baker", False), ("x", None, True)]
    got = [r.r for r in spark.createDataFrame(rows, "t string, title string, w boolean").select(W.mentions_title(F.col("t"), F.col("title")).alias("r")).collect()]
    assert got == [w for *_, w in rows]


def test_verbs_in_any_form(spark):
    words = {"built": "build", "owns": "own", "owned": "own", "applied": "apply", "applies": "apply", "shipped": "ship", "driving": "drive", "debugging": "debug", "analysed": "analyse", "co-author": "co-author", "baker": None, "led": "lead", "sets": "set"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", W.verb_of(F.col("w")).alias("v")).collect()
    assert {r.w: r.v for r in rows} == words


def test_apply_methods(spark):
    pages = {'{"isLinkOut":true}': "external", '{"isLinkOut": false}': "quick_apply", "public_jobs_apply-link-onsite": "easy_apply", "public_jobs_apply-link-simple": "easy_apply", "public_jobs_apply-link-offsite": "external", "none": None}
    for page, want in pages.items():
        assert one(spark, page, P.apply_method) == want
    assert [one(spark, m, P.apply_label) for m in ("easy_apply", "external", None)] == ["Easy Apply", "External", ""]


def test_json_values(spark):
    body = '{"t": " x ", "n": 12, "f": 1.5, "b": true, "o": {"a": 1}, "l": [1], "z": null, "y": "YES", "one": "1", "no": "no"}'
    text = lambda k: one(spark, body, lambda c: boards.as_text(c, f"$.{k}"))
    assert [text(k) for k in ("t", "n", "f", "b", "o", "l", "z", "none")] == ["x", "12", "1.5", "true", "", "", "", ""]
    flag = lambda k: one(spark, body, lambda c: boards.as_bool(c, f"$.{k}"))
    assert [flag(k) for k in ("b", "y", "one", "no", "n", "o", "none")] == [True, True, True, False, False, False, False]
    assert one(spark, "no json", lambda c: boards.as_text(c, "$.t")) == "" and one(spark, None, lambda c: boards.as_bool(c, "$.t")) is False


@pytest.mark.parametrize("html, want", [
    ("Java<b>Script</b>", "JavaScript"), ("a< br / >b</ p >c", "a\nb\nc"), ("<ul>< li>x</li><li class='a'>y</li></ul>", "- x\n- y"), ("a<script>b</script>c<style>d</style>e", "ace"), ("&amp;lt; &#39;&apos;&quot;", "< ''\""), ("<p> </p>", None), (None, None),
])
def test_markup(spark, html, want):
    assert one(spark, html, X.strip_html) == want
