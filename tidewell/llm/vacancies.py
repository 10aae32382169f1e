"""Postings brought to comparable form: words of title and company, place and time.

Spelling is mended by the corpus itself: a word within two edits of one that is far more frequent is taken as
that one, and as what that one is mended to in turn. Only the ratio of their counts decides, so that the same
words are mended however often each occurs. Words meet by the pigeonhole join of the place list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.places import ACCENTED, map_places, match_names
from tidewell.operators.time_forms import normalise_times
from tidewell.session import relieve, staged

# Short forms in titles.
SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "grad": "graduate", "princ": "principal", "prin": "principal",
    "advisor": "adviser", "offr": "officer", "rep": "representative", "eng": "engineer", "engr": "engineer", "spec": "specialist",
    "admin": "administrator", "mgr": "manager", "asst": "assistant", "coord": "coordinator", "tech": "technician", "dev": "developer", "exec": "executive",
}
RANKS = ["senior", "lead", "principal", "junior", "graduate", "head", "chief"]
TITLE_NOISE = ["urgent", "immediate", "start", "hiring", "now", "apply", "remote", "hybrid", "contract", "the", "and", "a", "of", "for"]
COMPANY_NOISE = ["pty", "ltd", "limited", "group", "holdings", "holding", "services", "australia", "aus", "inc", "llc", "plc", "corp", "company", "co", "the", "and", "nz"]
#: A word is mended to one that is at least so many times as frequent.
RATIO = 8


def _folded(c: str) -> Column:
    return F.translate(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), *ACCENTED)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, "[^a-z0-9+#]+", " ")), " "), lambda w: w != "")


def title_words(c: str) -> Column:
    """Words of a title without decoration: brackets, what follows a bar or dash, counts and calls to apply."""
    t = F.regexp_replace(_folded(c), r"(?s)\[[^\]]*\]|\s*[|–—].*$", " ")
    t = F.regexp_replace(t, r"\([^)]*(?:\d|contract|remote|hybrid|time|perm|temp|casual|wfh|ref)[^)]*\)|\bnew!|\b(?:full|part)[ -]time\b|\bx\s?\d+\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\bco-ord", "coord"), r"[.'’]", "")
    short = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    return F.transform(F.filter(_words(t), lambda w: ~w.rlike("^[0-9]+$")), lambda w: F.coalesce(F.try_element_at(short, w), w))


def company_words(c: str) -> Column:
    return _words(F.regexp_replace(F.regexp_replace(_folded(c), "&", " and "), r"[.'’]", ""))


def spellings_of(rows: DataFrame) -> DataFrame:
    """(kind, raw, rows, words) of the distinct titles and companies of rows; null is ''."""
    titles = rows.groupBy(F.coalesce("title", F.lit("")).alias("raw")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("title").alias("kind"), "raw", "rows", title_words("raw").alias("words"))
    firms = rows.groupBy(F.coalesce("company", F.lit("")).alias("raw")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("company").alias("kind"), "raw", "rows", company_words("raw").alias("words"))
    return titles.unionByName(firms)


def word_counts(values: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(kind, word, n) of spellings, on top of the counts of what came before."""
    now = values.select("kind", F.explode("words").alias("word"), F.col("rows").alias("n"))
    return (now if before is None else now.unionByName(before)).groupBy("kind", "word").agg(F.sum("n").alias("n"))


def better_words(counts: DataFrame) -> DataFrame:
    """(kind, word, better) of misspelled words: a word of the same kind within two edits (one below six letters; a
    swap of neighbours counts as one) that is RATIO times as frequent; the nearest first, then the most frequent.
    Where that one is mended itself, what it is mended to. Words of three letters stay as they are."""
    none = F.lit(None).cast("string")
    refs = counts.filter(F.col("n") >= RATIO).select(F.hash("word").cast("long").alias("place_id"), none.alias("state"), none.alias("country"), F.col("word").alias("city"), F.array().cast("array<string>").alias("aliases"))
    near = match_names(counts.filter(F.length("word") >= 4).select(F.col("word").alias("name")), refs).filter("name <> ref")
    swapped = F.expr("edits = 2 and length(name) = length(ref) and array_sort(split(name, '')) = array_sort(split(ref, ''))")
    near = near.withColumn("edits", F.when(swapped, 1).otherwise(F.col("edits"))).filter((F.col("edits") == 1) | (F.length("name") >= 6))
    a, b = counts.alias("a"), counts.alias("b")
    best = staged(
        near.join(a, F.col("a.word") == F.col("name")).join(b, (F.col("b.word") == F.col("ref")) & (F.col("a.kind") == F.col("b.kind")))
        .filter(F.col("b.n") >= F.col("a.n") * RATIO)
        .groupBy(F.col("a.kind").alias("kind"), F.col("name").alias("word"))
        .agg(F.max_by("ref", F.struct(-F.col("edits"), F.col("b.n"), F.col("ref"))).alias("better")), "better-words"
    )
    # Every step is RATIO times as frequent, so chains are short; each turn halves them.
    while True:
        on = best.select("kind", F.col("word").alias("better"), F.col("better").alias("far"))
        if best.join(on, ["kind", "better"], "left_semi").isEmpty():
            return best
        best = staged(best.join(on, ["kind", "better"], "left").select("kind", "word", F.coalesce("far", "better").alias("better")), "better-words")


def mended(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, raw, words) of spellings, misspelled words mended by the counts of words."""
    spread = values.select("kind", "raw", F.posexplode("words").alias("at", "word")).join(better_words(counts), ["kind", "word"], "left")
    return spread.groupBy("kind", "raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("better", "word").alias("w")))), lambda x: x["w"]).alias("words"))


def vacancy_fields(rows: DataFrame, places: DataFrame, settings: DataFrame, values: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """rows: id (bigint, unique), source, title, company, location_raw, posted_at_raw, scraped_at.

    One row for each: id, source, title (words without rank, sorted, one blank between), rank ('' if none),
    company, place_id (-1 where none is meant), place (city meant, else what is written, null for nothing),
    at (microseconds: posted, else scraped; null without either). Nulls and blanks give '' and null. values and
    counts: spellings of rows and the words by which they are mended, where these are more than the rows' own.
    """
    values = staged(spellings_of(rows), "spellings") if values is None else values
    counts = staged(word_counts(values), "words") if counts is None else counts
    fixed = staged(mended(values, counts), "mended")
    relieve(rows.sparkSession)
    lits = lambda words: F.array(*(F.lit(w) for w in words))
    joined = lambda words: F.concat_ws(" ", F.array_sort(F.array_distinct(words)))
    title = fixed.filter("kind = 'title'").select(
        F.col("raw").alias("_t"), joined(F.array_except("words", lits(TITLE_NOISE + RANKS))).alias("t"), joined(F.array_intersect(F.col("words"), lits(RANKS))).alias("rank")
    )
    firm = fixed.filter("kind = 'company'").select(F.col("raw").alias("_c"), joined(F.array_except("words", lits(COMPANY_NOISE))).alias("c"))
    spelled = rows.filter(F.trim("location_raw") != "").select(F.col("location_raw").alias("whole")).distinct().select("whole", F.lit("raw").alias("part"), F.col("whole").alias("txt"))
    place = map_places(spelled, places).select(F.col("whole").alias("_l"), "place_id", F.col("named").alias("place"))
    times = normalise_times(rows, settings, ["id"], "posted_at_raw", "scraped_at").select("id", F.unix_micros("posted_at").alias("_at"))
    slim = rows.select("id", "source", F.coalesce("title", F.lit("")).alias("_t"), F.coalesce("company", F.lit("")).alias("_c"), F.col("location_raw").alias("_l"), F.unix_micros("scraped_at").alias("_seen"))
    return (
        slim.join(title, "_t", "left").join(firm, "_c", "left").join(place, "_l", "left").join(times, "id", "left")
        .select("id", "source", F.coalesce("t", F.lit("")).alias("title"), F.coalesce("rank", F.lit("")).alias("rank"), F.coalesce("c", F.lit("")).alias("company"),
                F.coalesce("place_id", F.lit(-1)).alias("place_id"), "place", F.coalesce("_at", "_seen").alias("at"))
    )


def same_place(x: str, y: str) -> Column:
    """1 same, 0 another, 0.5 where one of them is not known."""
    p = lambda side: F.col(f"{side}_place_id")
    n = lambda side: F.col(f"{side}_place")
    both = (p(x) >= 0) & (p(y) >= 0)
    return F.when(both, (p(x) == p(y)).cast("double")).when(n(x).isNull() | n(y).isNull(), 0.5).otherwise((F.levenshtein(n(x), n(y)) <= 2).cast("double"))
