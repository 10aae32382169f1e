"""Queries of wording, numbers, selection and planning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.functions import text as X
from tidewell.functions import wording as W
from tidewell.operators import corpus, writeback
from tidewell.plans import posting_plans as plans
from tidewell.plans.posting_plans import FLAT, NOW, SENT, B, C, jobs, raw
from tidewell.sources import boards
from tidewell.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---------------------------------------------------------------- titles, firms, terms, verbs

_ENDS = "NSW|VIC|QLD|WA|SA|TAS|ACT|NT|Remote|Hybrid|Sydney|Melbourne|Brisbane|Perth|Adelaide|Canberra|Hobart|Darwin|Auckland|Wellington|London|Dublin|Singapore"
_BARE = r"regexp_replace(coalesce(title, ''), '\([^)]*\)|\[[^\]]*\]', ' ', 'g')"
_PLACED = rf"(?i){B}+[-–—|]{B}+([^-–—|]*[^A-Za-z0-9_–—|-])?({_ENDS})([^A-Za-z0-9_–—|-][^-–—|]*)?$"
_HEAD = FLAT(f"regexp_replace({_BARE}, '{_PLACED}', '')")


@query(rf"""SELECT title, CASE WHEN length(t) <= 45 THEN t ELSE trim(regexp_replace(t, '( - | – | — |[,/(:;|])(?s:.*)$', '')) END AS headline
FROM (SELECT DISTINCT title, regexp_replace({_HEAD}, '[ ,–—|:-]+$', '') AS t FROM raw_jobs)""")
def headline_titles(spark, d):
    return raw(spark, d).select("title").distinct().select("title", W.headline(F.col("title")).alias("headline"))


@query(rf"""SELECT company, CASE WHEN short <> '' THEN short ELSE company END AS name FROM (
  SELECT DISTINCT company, {FLAT(r"regexp_replace(company, '(?i)\b(pty|ltd|limited|inc|llc|group|australia|holdings|corporation|corp|banking)\b\.?', '', 'g')")} AS short FROM raw_jobs)""")
def prose_names(spark, d):
    return raw(spark, d).select("company").distinct().select("company", W.prose_name(F.col("company")).alias("name"))


_CLAUSES = rf"list_filter(list_transform(string_split_regex(clean, ' [-–—|] |[,/:;|]'), lambda c: trim(c)), lambda c: regexp_matches(c, '(?i)[a-z]{{3}}'))"


@query(rf"""WITH t AS (SELECT raw_id, lower(coalesce(description, '')) AS low, {FLAT(_BARE)} AS clean FROM raw_jobs)
SELECT raw_id, contains(low, lower(clean)) OR len(list_filter({_CLAUSES}, lambda c: contains(low, lower(c)))) > 0 AS named FROM t""")
def title_mentions(spark, d):
    return raw(spark, d).select("raw_id", W.mentions_title(F.col("description"), F.col("title")).alias("named"))


#: Terms looked for; marks are parts of words.
TERMS = ("training", "roster", "C#", ".NET", "Node.js", "CI/CD", "care")


def _term_sql(term: str) -> str:
    literal = "".join(c if c.isalnum() else "\\" + c for c in term)
    return f"len(regexp_extract_all(wide, '(?i)(^|[^A-Za-z0-9_#+.]){literal}([^A-Za-z0-9_#+]|$)'))"


@query("WITH w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([^A-Za-z0-9_#+.])', '\\1\\1', 'g') AS wide FROM documents), c AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS term, {_term_sql(t)} AS n FROM w" for t in TERMS) + ") SELECT * FROM c WHERE n > 0")
def term_mentions(spark, d):
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), W.term_count(F.col("text"), t).cast("long").alias("n")) for t in TERMS)))
    return documents(spark, d).select("doc_id", each.alias("t")).select("doc_id", "t.term", "t.n").filter("n > 0")


_ODD = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in W.IRREGULAR.items())
_DOUBLED = "CASE WHEN regexp_matches(w, '(ing|ed)$') AND right(regexp_replace(w, '(ing|ed)$', ''), 1) = left(right(regexp_replace(w, '(ing|ed)$', ''), 2), 1) AND length(w) > 4 THEN left(regexp_replace(w, '(ing|ed)$', ''), -1) ELSE w END"
_FORMS = f"[CASE w {_ODD} END, w, regexp_replace(w, '(ies|ied)$', 'y'), regexp_replace(w, '(ing|ed|es|s)$', ''), regexp_replace(w, '[ds]$', ''), {_DOUBLED}, regexp_replace(w, 'ing$', 'e')]"


@query(rf"""WITH t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]*')) AS w FROM documents) GROUP BY 1, 2),
v AS (SELECT doc_id, n, list_filter({_FORMS}, lambda c: list_contains([{', '.join(f"'{v}'" for v in W.VERBS)}], c))[1] AS verb FROM t)
SELECT doc_id, verb, CAST(sum(n) AS bigint) AS n FROM v WHERE verb IS NOT NULL GROUP BY 1, 2 HAVING sum(n) > 2""")
def verb_counts(spark, d):
    """Verbs that a document uses more than twice, in whatever form; each form is looked at once, not once a document."""
    tokens = documents(spark, d).select("doc_id", F.explode(W.verb_tokens(F.col("text"))).alias("w"))
    forms = tokens.select("w").distinct().select("w", W.verb_of(F.col("w")).alias("verb")).filter("verb is not null")
    return tokens.join(forms, "w").groupBy("doc_id", "verb").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


# ---------------------------------------------------------------- numbers and words of texts

_WORD_NUMBERS = "{'two': '2', 'three': '3', 'four': '4', 'five': '5', 'six': '6', 'seven': '7', 'eight': '8', 'nine': '9', 'ten': '10', 'eleven': '11', 'twelve': '12', 'twenty': '20', 'thirty': '30', 'fifty': '50', 'hundred': '100', 'thousand': '1000'}"
_AS_NUMBER = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.NUMBER_WORDS.items()) + " END"
_NUMBERS = (
    r"list_concat(list_transform(regexp_extract_all({0}, '(^|[^A-Za-z#.\d])(\d[\d,]*(\.\d+)?)', 2), lambda n: replace(n, ',', '')), "
    r"list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: " + _AS_NUMBER + "), lambda n: n IS NOT NULL))"
)
NUMBERS = lambda c: _NUMBERS.replace("{0}", c)
_CONTENT = (
    r"list_distinct(list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z][a-z+#.-]{2,}'), lambda w: regexp_replace(regexp_replace(w, '[.-]+$', ''), '^(.{2,}?)(ing|ed|es|s)$', '\1')), "
    "lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS.split()) + "], w)))"
)
CONTENT = lambda c: _CONTENT.replace("{0}", c)


@query(f"SELECT doc_id, array_to_string({NUMBERS('text')}, ',') AS numbers FROM documents WHERE text IS NOT NULL")
def numbers_in_texts(spark, d):
    return documents(spark, d).filter("text is not null").select("doc_id", F.array_join(X.numbers_in(F.col("text")), ",").alias("numbers"))


@query(f"SELECT doc_id, CAST(len(list_distinct({NUMBERS('text')})) AS int) AS n FROM documents WHERE text IS NOT NULL")
def distinct_numbers(spark, d):
    return documents(spark, d).filter("text is not null").select("doc_id", W.distinct_numbers(F.col("text")).alias("n"))


@query(f"SELECT word, count(*) AS n_docs FROM (SELECT unnest({CONTENT('text')}) AS word FROM documents) GROUP BY 1")
def content_words(spark, d):
    words = documents(spark, d).select(F.explode(X.content_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


_S = r"[ \t\n\x0B\f\r]"


@query(rf"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{_S}+', ' ', 'g')), ' ') AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(1, len(ts) + 1)) AS pos, ts FROM t),
said AS (SELECT doc_id, pos, unnest({NUMBERS('tok')}) AS number, {CONTENT('near')} AS near FROM (
  SELECT doc_id, pos, ts[pos] AS tok, array_to_string(ts[greatest(pos - 6, 1):greatest(pos - 6, 1) + 12], ' ') AS near FROM s WHERE regexp_matches(ts[pos], '\d'))),
given AS (SELECT unnest(list_distinct({NUMBERS('text')})) AS number, {CONTENT('text')} AS about FROM eval_items),
backed AS (SELECT DISTINCT doc_id, pos, number FROM said JOIN given USING (number) WHERE list_has_any(near, about))
SELECT DISTINCT doc_id, number FROM said ANTI JOIN backed USING (doc_id, pos, number)""")
def unfounded_numbers(spark, d):
    facts = table(spark, d, "eval_items").select(F.col("text").alias("fact"))
    return corpus.unfounded_numbers(documents(spark, d), facts, "doc_id")


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _long(key: str, source: str) -> str:
    return f"(SELECT DISTINCT {key}, n FROM (SELECT {key}, {_NORM.format('s')} AS n FROM (SELECT {key}, unnest({SENT('text')}) AS s FROM {source})) WHERE len(string_split(n, ' ')) >= 10)"


@query(rf"""WITH a AS {_long('doc_id', 'documents')}, b AS {_long('item_id', 'eval_items')},
ga AS (SELECT n, len(g) AS size, unnest(g) AS t FROM (SELECT n, list_distinct(list_transform(range(1, len(string_split(n, ' ')) - 1), lambda k: array_to_string(string_split(n, ' ')[k:k + 2], ' '))) AS g FROM (SELECT DISTINCT n FROM a))),
gb AS (SELECT n, len(g) AS size, unnest(g) AS t FROM (SELECT n, list_distinct(list_transform(range(1, len(string_split(n, ' ')) - 1), lambda k: array_to_string(string_split(n, ' ')[k:k + 2], ' '))) AS g FROM (SELECT DISTINCT n FROM b))),
p AS (SELECT ga.n AS norm, gb.n AS corpus_norm, count(*) AS c, any_value(ga.size) AS x, any_value(gb.size) AS y FROM ga JOIN gb USING (t) GROUP BY 1, 2)
SELECT doc_id, item_id, norm, corpus_norm, round(CAST(c AS double) / (x + y - c), 4) AS similarity FROM p JOIN a ON a.n = norm JOIN b ON b.n = corpus_norm WHERE CAST(c AS double) / (x + y - c) >= 0.5""")
def similar_sentences(spark, d):
    found = corpus.similar_sentences(documents(spark, d), table(spark, d, "eval_items"), "doc_id", "item_id")
    return found.select("doc_id", "item_id", "norm", "corpus_norm", F.round("similarity", 4).alias("similarity"))


# ---------------------------------------------------------------- file names

_PART = "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_FLAT_FIRM = FLAT("company")


@query(rf"""WITH n AS (SELECT DISTINCT company, title, {_FLAT_FIRM} AS firm FROM jobs),
k AS (SELECT *, CASE WHEN length(firm) > 30 OR len(string_split(firm, ' ')) > 4 THEN upper(array_to_string(list_transform(list_filter(string_split(firm, ' '), lambda w: regexp_matches(w, '^[A-Za-z0-9]')), lambda w: left(w, 1)), ''))
  ELSE {_PART.format('firm')} END AS token, {_PART.format('title')} AS whole, {_PART.format("trim(regexp_replace(title, '(?s)( - | – | — |[,/(:;|]).*$', ''))")} AS clause FROM n),
r AS (SELECT *, 66 - length(token) AS room FROM k),
c AS (SELECT *, regexp_replace(regexp_replace(substr(clause, 1, greatest(room + 1, 1)), '_?[^_]*$', ''), '_+$', '') AS cut FROM r)
SELECT company, title, concat('CV_', token, '_', CASE WHEN whole <> '' AND length(whole) <= room THEN whole WHEN clause <> '' AND length(clause) <= room THEN clause WHEN cut <> '' THEN cut ELSE 'Role' END, '_2026') AS stem FROM c""")
def file_names(spark, d):
    return jobs(spark, d).select("company", "title").distinct().select("company", "title", P.file_stem("CV", F.col("company"), F.col("title"), "2026").alias("stem"))


@query(f"SELECT company, coalesce(nullif({C('company')}, ''), regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', '', 'g')) AS key FROM (SELECT DISTINCT company FROM raw_jobs)")
def company_keys(spark, d):
    return raw(spark, d).select("company").distinct().select("company", P.company_key(F.col("company")).alias("key"))


_FOLDER = r"""CASE WHEN short = '' THEN 'Unknown company' WHEN regexp_matches(lower(short), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN short || ' Co' ELSE short END"""
_SHORT = r"regexp_replace(left(regexp_replace(" + FLAT(r"regexp_replace(company, '[<>:\"/\\|?*\x00-\x1F]', ' ', 'g')") + r", '[. ]+$', ''), 60), '[. ]+$', '')"
_KEY = f"coalesce(nullif({C('company')}, ''), regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', '', 'g'))"


@query(rf"""WITH f AS (SELECT DISTINCT {_FOLDER} AS folder FROM (SELECT {_SHORT} AS short FROM jobs)), k AS (SELECT folder, {_KEY} AS key FROM (SELECT folder, folder AS company FROM f)),
w AS (SELECT company, {_FOLDER} AS wanted, {_KEY} AS key FROM (SELECT DISTINCT company, {_SHORT} AS short FROM raw_jobs)),
e AS (SELECT lower(folder) AS low, min(folder) AS folder FROM f GROUP BY 1), s AS (SELECT key, min(folder) AS folder FROM k GROUP BY 1)
SELECT w.company, coalesce(e.folder, s.folder, w.wanted) AS folder FROM w LEFT JOIN e ON e.low = lower(w.wanted) LEFT JOIN s ON s.key = w.key""")
def folder_lookup(spark, d):
    """The folder of each firm among those there are: of the same name in any case, else the first of the same firm,
    else a new one."""
    there = jobs(spark, d).select(P.folder_name(F.col("company")).alias("folder")).distinct()
    return writeback.resolve_folders(raw(spark, d).select("company").distinct(), there)


# ---------------------------------------------------------------- JSON values, selection, planning

@query("""WITH p AS (SELECT raw_id, j, unnest(['listing', 'featured', 'layout', 'missing']) AS name FROM (SELECT raw_id, try_cast(raw AS json) AS j FROM raw_jobs)),
v AS (SELECT raw_id, name, json_type(j, '$.' || name) AS kind, json_extract_string(j, '$.' || name) AS said FROM p)
SELECT raw_id, name, CASE WHEN coalesce(kind, 'NULL') IN ('NULL', 'ARRAY', 'OBJECT') THEN '' ELSE trim(said) END AS txt,
  coalesce(CASE WHEN kind = 'BOOLEAN' THEN said = 'true' WHEN kind = 'VARCHAR' THEN regexp_matches(said, '(?i)^(true|yes|1)$') END, false) AS yes FROM v""")
def json_values(spark, d):
    cells = F.array(*(F.struct(F.lit(n).alias("name"), boards.as_text("raw", f"$.{n}").alias("txt"), boards.as_bool("raw", f"$.{n}").alias("yes")) for n in ("listing", "featured", "layout", "missing")))
    return raw(spark, d).select("raw_id", F.explode(cells).alias("c")).select("raw_id", "c.*")


_ISO = r"CASE WHEN regexp_matches(posted_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$') THEN try_cast(posted_at AS timestamptz) END"


def _instant(c: str):
    """The time of a text that is an instant as it stands; null for all other notations."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.try_to_timestamp(c))


@query(f"SELECT id FROM jobs WHERE NOT closed AND expired_at IS NULL AND pipeline_status = 'scraped' AND epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(coalesce({_ISO}, scraped_at)) <= 90 * 86400000000")
def fit_filter(spark, d):
    """Open jobs not judged yet, posted (or, where no instant is stated, scraped) in the last 90 days."""
    age = P.days_since(F.coalesce(_instant("posted_at"), "scraped_at"), F.lit(NOW).cast("timestamp"))
    return jobs(spark, d).filter(~F.col("closed") & F.col("expired_at").isNull() & (F.col("pipeline_status") == "scraped") & (F.coalesce(age, F.lit(0.0)) <= 90)).select("id")


@query("""SELECT j.id, nullif(url, '') AS url, coalesce(title, '') AS title, coalesce(company, '') AS company, p.place AS location, nullif(job_location.country, '') AS country, nullif(posted_at, '') AS posted_at,
  nullif(s.pay, '') AS salary, array_to_string(tags, ' ') AS tags, nullif(apply_method, '') AS apply_method FROM jobs j JOIN ({}) p ON p.id = j.id JOIN ({}) s ON s.id = j.id""".format(plans.SQL["format_location"], plans.SQL["format_salary"]))
def clean_jobs(spark, d):
    """What a later stage is given of a job: shown place and pay, optional fields null where they say nothing."""
    l, none = (lambda c: F.col(f"job_location.{c}")), (lambda c: F.nullif(c, F.lit("")))
    return jobs(spark, d).select(
        "id", none(F.col("url")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("company", F.lit("")).alias("company"), P.format_location(l("city"), l("state"), l("raw"), l("remote")).alias("location"),
        none(l("country")).alias("country"), none(F.col("posted_at")).alias("posted_at"), none(P.format_salary(F.col("salary.pay_min"), F.col("salary.pay_max"), F.col("salary.period"))).alias("salary"),
        F.array_join("tags", " ").alias("tags"), none(F.col("apply_method")).alias("apply_method"),
    )


@query(f"SELECT id, row_number() OVER (PARTITION BY source ORDER BY coalesce({_ISO}, scraped_at) DESC, id) AS place FROM jobs WHERE NOT closed AND pipeline_status IN ('fit_good', 'tracked')")
def stage_order(spark, d):
    """The queue of each source: freshest first, by the posting time where it is an instant, else by the scrape."""
    w = Window.partitionBy("source").orderBy(F.coalesce(_instant("posted_at"), "scraped_at").desc(), "id")
    return jobs(spark, d).filter("not closed and pipeline_status in ('fit_good', 'tracked')").select("id", F.row_number().over(w).cast("long").alias("place"))


@query(f"SELECT source, count(*) AS due FROM ({plans.SQL['due_for_check']}) JOIN jobs USING (id) GROUP BY 1")
def check_queues(spark, d):
    """How many listings of each source wait for a check; each source is a queue of its own."""
    due = writeback.due(jobs(spark, d), "last_seen_at", F.lit(NOW).cast("timestamp"), 720, ~F.col("closed") & F.col("expired_at").isNull())
    return due.groupBy("source").agg(F.count(F.lit(1)).alias("due"))


@query("SELECT DISTINCT trim(reason) AS reason FROM status_events WHERE coalesce(trim(reason), '') <> ''")
def distinct_reasons(spark, d):
    return table(spark, d, "status_events").select(F.trim("reason").alias("reason")).filter("reason <> ''").distinct()


@query("SELECT DISTINCT id FROM (SELECT id FROM jobs WHERE pipeline_status IN ('fit_good', 'tracked') AND salary IS NOT NULL UNION ALL SELECT id FROM jobs WHERE pipeline_status IN ('fit_good', 'tracked') AND apply_method IS NOT NULL)")
def stage_union(spark, d):
    good = jobs(spark, d).filter(F.col("pipeline_status").isin("fit_good", "tracked"))
    return good.filter("salary is not null").select("id").unionByName(good.filter("apply_method is not null").select("id")).distinct()


@query("SELECT kind, line FROM (SELECT 'item' AS kind, text AS line FROM eval_items UNION ALL SELECT 'place', concat_ws(', ', city, state, country) FROM places UNION ALL SELECT 'unit', concat(unit_kind, ' ', unit_code) FROM pay_units) WHERE line IS NOT NULL")
def fact_lines(spark, d):
    """All facts as lines of one table, whatever table they come from."""
    part = lambda name, kind, line: table(spark, d, name).select(F.lit(kind).alias("kind"), line.alias("line"))
    lines = part("eval_items", "item", F.col("text")).unionByName(part("places", "place", F.concat_ws(", ", "city", "state", "country")))
    return lines.unionByName(part("pay_units", "unit", F.concat("unit_kind", F.lit(" "), "unit_code"))).filter("line is not null")


@query("SELECT count(DISTINCT lower(company)) AS n FROM jobs")
def distinct_firms(spark, d):
    return jobs(spark, d).agg(F.count_distinct(F.lower("company")).alias("n"))


@query("SELECT source, snapshot_no, delivery_no FROM (SELECT source, arg_max({'s': snapshot_no, 'd': delivery_no}, {'t': taken_at, 's': snapshot_no, 'd': delivery_no}) AS t FROM job_snapshots GROUP BY 1) LEFT JOIN LATERAL (SELECT t.s AS snapshot_no, t.d AS delivery_no) ON true")
def newest_batch(spark, d):
    """The newest delivery that each source is in."""
    newest = F.max(F.struct("taken_at", "snapshot_no", "delivery_no")).alias("t")
    return table(spark, d, "job_snapshots").groupBy("source").agg(newest).select("source", "t.snapshot_no", "t.delivery_no")


@query("""WITH s AS (SELECT search_query, search_location, list_distinct(list(source)) AS sources, bool_or(ok) AS enabled, CASE WHEN count(*) > 60 THEN CAST(5 AS bigint) END AS max_pages FROM run_results GROUP BY 1, 2),
x AS (SELECT search_query, search_location, max_pages, unnest(sources) AS source FROM s WHERE enabled)
SELECT x.search_query, x.search_location, x.source, coalesce(x.max_pages, 3) AS max_pages FROM x JOIN source_settings t ON t.source = x.source WHERE t.currency <> 'NZD'""")
def search_plan(spark, d):
    """Enabled searches on each of their sources, sources that are unknown or switched off left out."""
    searches = table(spark, d, "run_results").groupBy("search_query", "search_location").agg(
        F.collect_set("source").alias("sources"), F.bool_or("ok").alias("enabled"), F.when(F.count(F.lit(1)) > 60, F.lit(5).cast("long")).alias("max_pages")
    )
    sources = table(spark, d, "source_settings").select("source", (F.col("currency") != "NZD").alias("enabled"))
    return writeback.planned(searches, sources, 3)


@query("""SELECT coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(job_location.city, '') AS city, coalesce(job_location.state, '') AS state, CASE WHEN job_location.remote THEN 'yes' ELSE 'no' END AS remote,
  coalesce(employment_type, '') AS employment_type, coalesce(CAST(CAST(floor(salary.pay_min) AS bigint) AS varchar), '') AS pay_min, coalesce(CAST(CAST(floor(salary.pay_max) AS bigint) AS varchar), '') AS pay_max, coalesce(salary.period, '') AS period, coalesce(posted_at, '') AS posted_at,
  coalesce(strftime(scraped_at, '%Y-%m-%dT%H:%M:%S'), '') AS scraped_at, coalesce(strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S'), '') AS last_seen_at, CASE WHEN closed THEN 'yes' ELSE 'no' END AS closed, coalesce(pipeline_status, '') AS pipeline_status, coalesce(apply_method, '') AS fit_reason,
  coalesce(source, '') AS source, array_to_string(seen_on, ' ') AS seen_on, coalesce(array_to_string(tags, ' '), '') AS tags, coalesce(url, '') AS url FROM jobs""")
def csv_projection(spark, d):
    """The nineteen columns of an export, in their order."""
    from tidewell.sources.files import csv_ready

    c, when = F.col, (lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"))
    columns = {
        "title": c("title"), "company": c("company"), "city": c("job_location.city"), "state": c("job_location.state"), "remote": c("job_location.remote"), "employment_type": c("employment_type"),
        "pay_min": F.floor("salary.pay_min"), "pay_max": F.floor("salary.pay_max"), "period": c("salary.period"), "posted_at": c("posted_at"), "scraped_at": when("scraped_at"), "last_seen_at": when("last_seen_at"),
        "closed": c("closed"), "pipeline_status": c("pipeline_status"), "fit_reason": c("apply_method"), "source": c("source"), "seen_on": c("seen_on"), "tags": c("tags"), "url": c("url"),
    }
    return csv_ready(jobs(spark, d), columns)
