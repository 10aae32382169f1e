"""Queries of the posting operators over the posting tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import postings as P
from tidewell.functions import text as X
from tidewell.operators import corpus, merge, resolve, runs, status, tables, writeback
from tidewell.session import staged, table

NOW = "2026-11-01 00:00:00"
#: RE2 spelling of the blanks in functions.text, for the SQL side.
B = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_jobs")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs")


def last_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot in its highest delivery, which replaces the others whole; a null delivery counts as the lowest."""
    rows = table(spark, d, "job_snapshots")
    order = F.coalesce(F.col("delivery_no").cast("long"), F.lit(-(2**62)))
    last = rows.groupBy(F.col("snapshot_no").alias("_no")).agg(F.max(order).alias("_last"))
    return rows.join(last, (F.col("snapshot_no") == F.col("_no")) & (order == F.col("_last")), "left_semi")


_COMPANY = rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({{0}}, '')), '&', 'and'), '[^a-z0-9 ]+', ' ', 'g'), '\b({P.COMPANY_NOISE.replace(' ', '|')})\b', ' ', 'g'), ' +', ' ', 'g'))"
_TITLE = rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(coalesce({{0}}, '')), '\([^)]*\)', ' ', 'g'), '[|–—][^\n\r]*$', ' '), '&', 'and'), '[^a-z0-9+# ]+', ' ', 'g'), '\b({P.TITLE_NOISE})\b', ' ', 'g'), ' +', ' ', 'g'))"
C = _COMPANY.format
T = lambda c: _TITLE.replace("{0}", c)
_FLAT = rf"trim(regexp_replace(coalesce({{0}}, ''), '{B}+', ' ', 'g'))"
FLAT = lambda c: _FLAT.replace("{0}", c)
_TOKENS = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> '')))"
TOKENS = lambda c: _TOKENS.replace("{0}", T(c))


@query("SELECT raw_id, sha1(concat(source, ':', source_id)) AS id FROM raw_jobs")
def make_id(spark, d):
    return raw(spark, d).select("raw_id", P.make_id(F.col("source"), F.col("source_id")).alias("id"))


@query(f"SELECT DISTINCT company, {C('company')} AS company_key FROM raw_jobs")
def normalize_company(spark, d):
    return raw(spark, d).select("company").distinct().select("company", P.normal_company(F.col("company")).alias("company_key"))


@query(f"SELECT DISTINCT title, {T('title')} AS title_key FROM raw_jobs")
def normalize_title(spark, d):
    return raw(spark, d).select("title").distinct().select("title", P.normal_title(F.col("title")).alias("title_key"))


_FP = f"sha1(concat({T('title')}, '|', {C('company')}, '|', trim(lower(coalesce(location_raw, '')))))"


@query(f"SELECT raw_id, {_FP} AS fp FROM raw_jobs")
def make_fingerprint(spark, d):
    return raw(spark, d).select("raw_id", P.fingerprint(F.col("title"), F.col("company"), F.col("location_raw")).alias("fp"))


@query(f"SELECT doc_id, md5({FLAT('text')}) AS digest, CAST(length({FLAT('text')}) AS bigint) AS n FROM documents")
def collapse_ws(spark, d):
    flat = X.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(flat.cast("binary")).alias("digest"), F.length(flat).cast("long").alias("n"))


@query(f"SELECT doc_id, CASE WHEN {FLAT('text')} = '' THEN 0 ELSE len(string_split({FLAT('text')}, ' ')) END AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"))


def _html_sql(c: str) -> str:
    """Breaks, block ends and items first; then what is markup goes without a trace; then entities and blanks."""
    steps = (
        (rf"(?i)<{B}*br{B}*/?{B}*>", "' || chr(10) || '"), (rf"(?i)</{B}*(p|div|li|h[1-6]|tr){B}*>", "' || chr(10) || '"), (rf"(?i)<{B}*li[^>]*>", "- "),
        (r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'),
        ("(?i)&#39;|&apos;", "''"), (r"[ \t]+", " "), (r"\n{3,}", "' || chr(10) || chr(10) || '"),
    )
    for rx, to in steps:
        c = f"regexp_replace({c}, '{rx}', '{to}', 'g')"
    return rf"nullif(regexp_replace({c}, '^{B}+|{B}+$', '', 'g'), '')"


@query(f"SELECT raw_id, md5({_html_sql('description')}) AS digest FROM raw_jobs WHERE description IS NOT NULL")
def strip_html(spark, d):
    return raw(spark, d).filter("description is not null").select("raw_id", F.md5(X.strip_html(F.col("description")).cast("binary")).alias("digest"))


@query("""SELECT raw_id, CASE WHEN regexp_matches(t, 'intern|graduate program|trainee') THEN 'internship' WHEN regexp_matches(t, 'casual') THEN 'casual'
  WHEN regexp_matches(t, 'contract|temp|fixed[ -]term|daily rate|day rate') THEN 'contract' WHEN regexp_matches(t, 'part[ -]time') THEN 'part-time'
  WHEN regexp_matches(t, 'full[ -]time|permanent|perm([^a-z0-9_]|$)') THEN 'full-time' ELSE 'unknown' END AS kind
FROM (SELECT raw_id, lower(concat(coalesce(employment_type_raw, ''), ' ', coalesce(title, ''))) AS t FROM raw_jobs)""")
def employment_type(spark, d):
    return raw(spark, d).select("raw_id", P.employment_type(F.col("employment_type_raw"), F.col("title")).alias("kind"))


def _tags_sql(title: str, body: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({'h' if only else 'w'}, '{rx}') THEN '{tag}' END" for tag, rx, only in P.TAGS)
    return f"concat_ws(',', {cases})"


@query(f"""SELECT raw_id, {_tags_sql('h', 'w')} AS tags FROM (
  SELECT raw_id, coalesce(lower(title), '') AS h, lower(concat_ws(' ' || chr(10) || ' ', nullif(title, ''), nullif(teaser, ''), nullif(description, ''))) AS w FROM raw_jobs)""")
def extract_tags(spark, d):
    return raw(spark, d).select("raw_id", F.concat_ws(",", P.tags(F.col("title"), F.col("teaser"), F.col("description"))).alias("tags"))


@query("SELECT id FROM jobs WHERE list_contains(tags, 'hybrid') AND list_contains(tags, 'licence')")
def tags_contain_all(spark, d):
    wanted = F.array(F.lit("hybrid"), F.lit("licence"))
    return jobs(spark, d).filter(F.size(F.array_except(wanted, F.col("tags"))) == 0).select("id")


def _first_hit(column: str, cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{rx}') THEN '{out}'" for rx, out in cases) + f" ELSE {other} END"


@query("SELECT DISTINCT location_raw, " + _first_hit("lower(coalesce(location_raw, ''))", [(rf"(^|[^A-Za-z0-9_])({rx})($|[^A-Za-z0-9_])", code) for code, rx in P.COUNTRY_WORDS], "'AU'") + " AS country FROM raw_jobs")
def detect_country(spark, d):
    return raw(spark, d).select("location_raw").distinct().select("location_raw", P.country(F.col("location_raw")).alias("country"))


_STATE = _first_hit("low", [(rf"(^|[\s,(/-]){n}($|[\s,)/-])", c) for n, c in P.STATE_WORDS], "NULL")
_CITY = (
    f"CASE WHEN regexp_matches(low, '{'|'.join(P.METRO)}') THEN 'Melbourne' " + " ".join(f"WHEN contains(low, '{n}') THEN '{n.title()}'" for n, _ in P.CITY_STATE)
    + " WHEN trim(split_part(replace(flat, '|', ','), ',', 1)) <> '' AND lower(trim(split_part(replace(flat, '|', ','), ',', 1))) NOT IN (" + ", ".join(f"'{n}'" for n, _ in P.STATE_WORDS)
    + ") THEN trim(split_part(replace(flat, '|', ','), ',', 1)) END"
)


@query(f"""SELECT location_raw, city, coalesce(state, {_first_hit('lower(city)', [(f'^{n}$', s) for n, s in P.CITY_STATE], 'NULL')}) AS state, remote FROM (
  SELECT location_raw, {_CITY} AS city, {_STATE} AS state, regexp_matches(low, '(^|[^A-Za-z0-9_])(remote|work from home|wfh|anywhere)($|[^A-Za-z0-9_])') AS remote
  FROM (SELECT DISTINCT location_raw, {FLAT('location_raw')} AS flat, lower({FLAT('location_raw')}) AS low FROM raw_jobs))""")
def parse_location(spark, d):
    found = raw(spark, d).select("location_raw").distinct().select("location_raw", P.location(F.col("location_raw"), F.lit(False)).alias("l"))
    return found.select("location_raw", "l.city", "l.state", "l.remote")


_BORDER = r"(^|[^a-z0-9_])({})([^a-z0-9_]|$)"
_PERIOD = _first_hit("t", [
    (_BORDER.format(r"p\.?a\.?|per\s*annum|annual|year|yr"), "year"), (_BORDER.format(r"per\s*month|p\.?m\.?|month"), "month"),
    (_BORDER.format(r"per\s*day|p\.?d\.?|daily") + r"|/\s*day|day\s*rate", "day"), (_BORDER.format(r"per\s*hour|p\.?h\.?|hourly") + r"|/\s*hr|/\s*hour|hour", "hour"),
], "'unknown'")


@query(rf"""WITH s AS (SELECT DISTINCT salary_raw, regexp_replace(regexp_replace(lower(salary_raw), '[–—]', '-', 'g'), '^{B}+|{B}+$', '', 'g') AS t FROM raw_jobs WHERE salary_raw IS NOT NULL),
p AS (SELECT *, {_PERIOD} AS said, regexp_matches(t, '(^|[^a-z0-9_])(aud|nzd|usd)([^a-z0-9_]|$)') AS named, regexp_extract_all(t, '\$?\s*\d[\d,]*(?:\.\d+)?\s*(?:k\b)?') AS hits FROM s),
v AS (SELECT *, list_transform(list_filter(list_transform(hits, lambda h: {{'h': h, 'v': CAST(regexp_replace(h, '[^0-9.]', '', 'g') AS double) * CASE WHEN contains(h, 'k') THEN 1000 ELSE 1 END}}),
  lambda x: contains(x.h, '$') OR named OR contains(x.h, 'k') OR said <> 'unknown' OR x.v >= 1000), lambda x: x.v) AS f FROM p)
SELECT salary_raw, CASE WHEN regexp_matches(t, 'up to|max') AND len(f) = 1 THEN NULL ELSE list_min(f) END AS pay_min,
  CASE WHEN (regexp_matches(t, 'up to|max') AND len(f) = 1) OR list_min(f) <> list_max(f) THEN list_max(f) END AS pay_max,
  CASE WHEN said <> 'unknown' THEN said WHEN list_max(f) >= 20000 THEN 'year' WHEN list_max(f) >= 300 THEN 'day' WHEN list_max(f) <= 250 THEN 'hour' ELSE 'unknown' END AS period
FROM v WHERE len(f) > 0""")
def parse_salary(spark, d):
    found = raw(spark, d).filter("salary_raw is not null").select("salary_raw").distinct().select("salary_raw", P.salary_label(F.col("salary_raw")).alias("s"))
    return found.filter("s is not null").select("salary_raw", "s.pay_min", "s.pay_max", "s.period")


@query("""SELECT id, CASE WHEN remote AND NOT contains(lower(base), 'remote') THEN base || ' (Remote)' ELSE base END AS place FROM (
  SELECT id, coalesce(job_location.remote, false) AS remote, coalesce(nullif(concat_ws(', ', nullif(job_location.city, ''), nullif(job_location.state, '')), ''), job_location.raw, '') AS base FROM jobs)""")
def format_location(spark, d):
    l = lambda c: F.col(f"job_location.{c}")  # noqa: E731, E741
    return jobs(spark, d).select("id", P.format_location(l("city"), l("state"), l("raw"), l("remote")).alias("place"))


_MONEY = "'$' || regexp_replace(regexp_replace(format('{{:,.3f}}', {0}), '0+$', ''), '[.]$', '')"


@query(f"""SELECT id, CASE WHEN lo <> 0 AND hi <> 0 THEN {_MONEY.format('lo')} || '-' || {_MONEY.format('hi')} || '/' || p WHEN lo <> 0 THEN {_MONEY.format('lo')} || '+/' || p WHEN hi <> 0 THEN 'up to ' || {_MONEY.format('hi')} || '/' || p ELSE '' END AS pay
FROM (SELECT id, coalesce(salary.pay_min, 0) AS lo, coalesce(salary.pay_max, 0) AS hi, coalesce(salary.period, 'unknown') AS p FROM jobs)""")
def format_salary(spark, d):
    return jobs(spark, d).select("id", P.format_salary(F.col("salary.pay_min"), F.col("salary.pay_max"), F.col("salary.period")).alias("pay"))


@query(f"SELECT id, round((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(scraped_at)) / 86400000000.0, 4) AS days FROM jobs")
def days_since(spark, d):
    return jobs(spark, d).select("id", F.round(P.days_since(F.col("scraped_at"), F.lit(NOW).cast("timestamp")), 4).alias("days"))


@query("SELECT column0 AS spec, CAST(column1 AS bigint) AS seconds FROM (VALUES ('24h', 86400), ('7d', 604800), ('2w', 1209600), ('1m', 2592000), (' 3D ', 259200), ('soon', -1)) v(column0, column1)")
def parse_duration(spark, d):
    return spark.createDataFrame([("24h",), ("7d",), ("2w",), ("1m",), (" 3D ",), ("soon",)], "spec string").select("spec", F.coalesce(P.duration_seconds(F.col("spec")), F.lit(-1)).cast("long").alias("seconds"))


@query("SELECT raw_id, CAST(json_extract_string(raw, '$.listing') AS bigint) AS listing, coalesce(nullif(trim(json_extract_string(raw, '$.missing')), ''), nullif(trim(json_extract_string(raw, '$.layout')), '')) AS layout FROM raw_jobs")
def json_paths(spark, d):
    from tidewell.sources.boards import pick

    return raw(spark, d).select("raw_id", pick("raw", "$.listing").cast("long").alias("listing"), pick("raw", "$.missing", "$.layout").alias("layout"))


_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^m\\.', '')"


def _platforms(spark, d):
    """(_host, platform) of the sources that are boards people apply on."""
    return table(spark, d, "source_settings").filter(F.col("source").isin("seek", "linkedin")).select(F.col("host").alias("_host"), F.col("source").alias("platform"))


@query(f"SELECT raw_id, s.source AS platform FROM raw_jobs r LEFT JOIN (SELECT * FROM source_settings WHERE source IN ('seek', 'linkedin')) s ON s.host = {_HOST}")
def url_platform(spark, d):
    return raw(spark, d).select("raw_id", P.url_host(F.col("url")).alias("_host")).join(_platforms(spark, d), "_host", "left").select("raw_id", "platform")


@query(r"""SELECT DISTINCT company, CASE WHEN short = '' THEN 'Unknown company' WHEN regexp_matches(lower(short), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN short || ' Co' ELSE short END AS folder
FROM (SELECT company, regexp_replace(left(regexp_replace(""" + FLAT(r"regexp_replace(company, '[<>:\"/\\|?*\x00-\x1F]', ' ', 'g')") + r""", '[. ]+$', ''), 60), '[. ]+$', '') AS short FROM raw_jobs)""")
def company_folder(spark, d):
    return raw(spark, d).select("company").distinct().select("company", P.folder_name(F.col("company")).alias("folder"))


# ---------------------------------------------------------------- joins and state

_KEYED = f"""k AS (SELECT raw_id AS seq, batch_no, source, sha1(concat(source, ':', source_id)) AS id, {_FP} AS fp, {C('company')} AS ck, {TOKENS('title')} AS tk FROM raw_jobs)"""
SPLIT = "(SELECT CAST(max(batch_no) AS double) / 2 FROM raw_jobs)"


def _split(spark, d):
    rows = raw(spark, d)
    keyed = resolve.keyed(rows, "raw_id", "source", "source_id", "title", "company", F.col("location_raw")).join(rows.select(F.col("raw_id").alias("seq"), "batch_no"), "seq")
    half = rows.agg((F.max("batch_no").cast("double") / 2).alias("half"))
    both = keyed.join(F.broadcast(half))  # one row
    return both.filter("batch_no > half"), both.filter("batch_no <= half")


def _or_none(found: DataFrame) -> DataFrame:
    return found.select("seq", F.coalesce("match_seq", F.lit(-1)).alias("match_seq"))


def _match_sql(key: str) -> str:
    return f"WITH {_KEYED} SELECT n.seq, coalesce(m.match_seq, -1) AS match_seq FROM k n LEFT JOIN (SELECT {key}, min(seq) AS match_seq FROM k WHERE batch_no <= {SPLIT} GROUP BY 1) m ON n.{key} = m.{key} WHERE n.batch_no > {SPLIT}"


@query(_match_sql("id"))
def match_exact(spark, d):
    new, old = _split(spark, d)
    return _or_none(resolve.match_by(new, old, "id"))


@query(_match_sql("fp"))
def match_fingerprint(spark, d):
    new, old = _split(spark, d)
    return _or_none(resolve.match_by(new, old, "fp"))


@query(f"""WITH {_KEYED}, o AS (SELECT ck, tk, source, min(seq) AS seq FROM k WHERE batch_no <= {SPLIT} AND len(tk) > 0 GROUP BY ALL), n AS (SELECT DISTINCT ck, tk, source FROM k WHERE batch_no > {SPLIT} AND len(tk) > 0),
m AS (SELECT n.ck, n.tk, n.source, min(o.seq) AS match_seq FROM n JOIN o ON n.ck = o.ck AND n.source <> o.source
  AND len(list_intersect(n.tk, o.tk)) >= 0.8 * (len(n.tk) + len(o.tk) - len(list_intersect(n.tk, o.tk))) GROUP BY ALL)
SELECT k.seq, coalesce(m.match_seq, -1) AS match_seq FROM k LEFT JOIN m ON k.ck = m.ck AND k.tk = m.tk AND k.source = m.source WHERE k.batch_no > {SPLIT}""")
def match_fuzzy_first(spark, d):
    new, old = _split(spark, d)
    return _or_none(resolve.match_fuzzy_first(new, old))


@query(f"WITH {_KEYED} SELECT id, min(seq) AS seq FROM k GROUP BY id")
def distinct_first(spark, d):
    keyed = resolve.keyed(raw(spark, d), "raw_id", "source", "source_id", "title", "company", F.col("location_raw"))
    return resolve.first_by(keyed.select("id", "seq", "fp"), "id").select("id", "seq")


@query("""WITH a AS (SELECT id, arg_max(title, raw_id) FILTER (title IS NOT NULL) AS title, min(scraped_at) AS first_at FROM (SELECT *, sha1(concat(source, ':', source_id)) AS id FROM raw_jobs) GROUP BY id)
SELECT coalesce(j.id, a.id) AS id, coalesce(a.title, j.title) AS title, epoch_us(CASE WHEN j.id IS NOT NULL THEN j.scraped_at ELSE a.first_at END) AS scraped_us FROM jobs j FULL JOIN a ON j.id = a.id""")
def upsert(spark, d):
    batch = raw(spark, d).select(P.make_id(F.col("source"), F.col("source_id")).alias("id"), "raw_id", "title", "scraped_at")
    last = batch.groupBy("id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("raw_id"))).alias("title"), F.min("scraped_at").alias("scraped_at"))
    after = merge.upsert(jobs(spark, d).select("id", "title", "scraped_at"), last, "id", keep=("scraped_at",))
    return after.select("id", "title", F.unix_micros("scraped_at").alias("scraped_us"))


@query("""WITH t AS (SELECT source, finished_at, row_number() OVER (PARTITION BY source ORDER BY finished_at) AS turn FROM (SELECT DISTINCT source, finished_at FROM run_results)),
s AS (SELECT source, id, max(finished_at) AS finished_at FROM (SELECT source, finished_at, unnest(seen_ids) AS id FROM run_results) WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT s.id, s.source, CAST(l.last - t.turn AS int) AS missed_runs, l.last - t.turn >= 3 AS closed
FROM s JOIN t ON s.source = t.source AND s.finished_at = t.finished_at JOIN (SELECT source, max(turn) AS last FROM t GROUP BY 1) l ON l.source = s.source""")
def age_out(spark, d):
    return status.missed_runs(table(spark, d, "run_results"))


@query("""WITH t AS (SELECT source, finished_at, row_number() OVER (PARTITION BY source ORDER BY finished_at) AS turn FROM (SELECT DISTINCT source, finished_at FROM run_results)),
s AS (SELECT source, id, max(finished_at) AS finished_at FROM (SELECT source, finished_at, unnest(seen_ids) AS id FROM run_results) WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT s.source, count(*) AS closed_now FROM s JOIN t ON s.source = t.source AND s.finished_at = t.finished_at JOIN (SELECT source, max(turn) AS last FROM t GROUP BY 1) l ON l.source = s.source WHERE l.last - t.turn = 3 GROUP BY 1""")
def closed_crossings(spark, d):
    """How many jobs the last run of each source closed: those that it was the third in a row to miss."""
    return status.missed_runs(table(spark, d, "run_results")).filter("missed_runs = 3").groupBy("source").agg(F.count(F.lit(1)).alias("closed_now"))


_LAST = "(SELECT * FROM job_snapshots s WHERE delivery_no = (SELECT max(delivery_no) FROM job_snapshots t WHERE t.snapshot_no = s.snapshot_no))"


@query(f"""WITH s AS (SELECT DISTINCT id, snapshot_no, closed FROM {_LAST}), o AS (SELECT id, snapshot_no, bool_or(NOT closed) AS up FROM s GROUP BY 1, 2),
b AS (SELECT *, sum(CAST(up AS int)) OVER (PARTITION BY id ORDER BY snapshot_no) AS block FROM o)
SELECT id, snapshot_no, CAST(sum(CAST(NOT up AS int)) OVER (PARTITION BY id, block ORDER BY snapshot_no) AS int) AS streak FROM b""")
def closed_streaks(spark, d):
    open_ = last_deliveries(spark, d).groupBy("id", "snapshot_no").agg(F.bool_or(~F.col("closed")).alias("up"))
    return status.miss_streaks(open_, "id", "snapshot_no", "up").select("id", "snapshot_no", "streak")


EDGES = [("scraped", "fit_good"), ("scraped", "fit_bad"), ("fit_good", "tracked"), ("fit_good", "applied"), ("tracked", "applied")]


@query("""WITH e AS (SELECT DISTINCT job_id, event_at, seq, coalesce(to_status, '') AS t FROM status_events),
l AS (SELECT job_id, list(t ORDER BY event_at, seq, t) AS ts FROM e GROUP BY 1),
f AS (SELECT job_id, len(ts) AS n, list_reduce(ts, lambda a, t: CASE WHEN concat(split_part(a, '|', 1), '>', t) IN ('scraped>fit_good', 'scraped>fit_bad', 'fit_good>tracked', 'fit_good>applied', 'tracked>applied')
  THEN concat(t, '|', CAST(split_part(a, '|', 2) AS int) + 1) ELSE a END, 'scraped|0') AS r FROM l)
SELECT job_id, split_part(r, '|', 1) AS status, CAST(split_part(r, '|', 2) AS int) AS n_accepted, CAST(n - CAST(split_part(r, '|', 2) AS int) AS int) AS n_refused FROM f""")
def ratchet_fold(spark, d):
    return status.fold_status(table(spark, d, "status_events"), EDGES, "scraped")


@query("SELECT job_id, t.to_status AS to_status FROM (SELECT job_id, max({'a': event_at, 'b': seq, 'to_status': to_status}) AS t FROM status_events GROUP BY 1)")
def last_status(spark, d):
    return status.last_event(table(spark, d, "status_events"))


_VERDICTS = """v AS (SELECT job_id, coalesce(t.to_status, '') AS to_status FROM (SELECT job_id, max({'a': event_at, 'b': seq, 'to_status': to_status}) AS t FROM status_events GROUP BY 1)),
j AS (SELECT v.job_id, v.to_status, CASE WHEN jobs.id IS NULL THEN 'unknown id' WHEN coalesce(pipeline_status, '') = to_status THEN concat('already ', to_status)
  WHEN concat(coalesce(pipeline_status, ''), '>', to_status) NOT IN ('scraped>fit_good', 'scraped>fit_bad', 'fit_good>tracked', 'fit_good>applied', 'tracked>applied')
  THEN concat('cannot move from ', coalesce(pipeline_status, ''), ' to ', to_status) END AS reason FROM v LEFT JOIN jobs ON v.job_id = jobs.id)"""


def _judged(spark, d):
    verdicts = last_status(spark, d).withColumnRenamed("job_id", "id")
    return writeback.judge(jobs(spark, d), verdicts, "id", "pipeline_status", "to_status", EDGES)


@query(f"WITH {_VERDICTS} SELECT job_id AS id, to_status, coalesce(reason, '') AS reason FROM j")
def verdict_reasons(spark, d):
    return _judged(spark, d).select("id", "to_status", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"WITH {_VERDICTS} SELECT jobs.id, coalesce(j.to_status, pipeline_status) AS pipeline_status FROM jobs LEFT JOIN (SELECT * FROM j WHERE reason IS NULL) j ON j.job_id = jobs.id")
def verdict_write_back(spark, d):
    return writeback.write_back(jobs(spark, d).select("id", "pipeline_status"), _judged(spark, d), "id", "pipeline_status", "to_status")


@query(f"SELECT id FROM jobs WHERE NOT closed AND expired_at IS NULL AND epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(last_seen_at) >= 720 * 3600000000")
def due_for_check(spark, d):
    return writeback.due(jobs(spark, d), "last_seen_at", F.lit(NOW).cast("timestamp"), 720, ~F.col("closed") & F.col("expired_at").isNull()).select("id")


@query("SELECT pipeline_status, count(*) AS n FROM jobs GROUP BY 1")
def stats_by_status(spark, d):
    return jobs(spark, d).groupBy("pipeline_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s AS source, count(*) AS n FROM (SELECT unnest(seen_on) AS s FROM jobs WHERE NOT closed) GROUP BY 1")
def stats_by_source(spark, d):
    return jobs(spark, d).filter("not closed").select(F.explode("seen_on").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS stored, count(*) FILTER (NOT closed) AS open, count(*) FILTER (closed) AS closed, count(*) FILTER (salary IS NOT NULL AND NOT closed) AS with_salary,
  count(*) FILTER (NOT closed AND epoch_us(TIMESTAMPTZ '2026-11-01 00:00:00+00') - epoch_us(scraped_at) < 86400000000) AS new_day,
  round(100.0 * count(*) FILTER (salary IS NOT NULL AND NOT closed) / nullif(count(*) FILTER (NOT closed), 0), 4) AS pct FROM jobs""")
def stats_totals(spark, d):
    open_, paid = F.count_if(~F.col("closed")), F.count_if(~F.col("closed") & F.col("salary").isNotNull())
    return jobs(spark, d).agg(F.count(F.lit(1)).alias("stored"), open_.alias("open"), F.count_if("closed").alias("closed"), paid.alias("with_salary"), F.count_if(~F.col("closed") & (P.days_since(F.col("scraped_at"), F.lit(NOW).cast("timestamp")) < 1)).alias("new_day"), F.round(F.lit(100.0) * paid / F.nullif(open_, F.lit(0)), 4).alias("pct"))


@query("SELECT company, count(*) AS n FROM jobs WHERE NOT closed GROUP BY 1 ORDER BY n DESC, company LIMIT 10")
def top_companies(spark, d):
    return jobs(spark, d).filter("not closed").groupBy("company").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("company")).limit(10)


@query("SELECT id FROM jobs WHERE NOT closed AND expired_at IS NULL ORDER BY last_seen_at DESC, id LIMIT 40")
def freshest_open(spark, d):
    return jobs(spark, d).filter("not closed and expired_at is null").orderBy(F.desc("last_seen_at"), "id").limit(40).select("id")


@query(f"SELECT id FROM jobs WHERE NOT closed AND pipeline_status IN ('tracked', 'fit_good') AND list_contains(seen_on, 'seek') AND scraped_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 60 DAY")
def export_filters(spark, d):
    since = F.lit(NOW).cast("timestamp") - F.expr("interval 60 days")
    return jobs(spark, d).filter(~F.col("closed") & F.col("pipeline_status").isin("tracked", "fit_good") & F.array_contains("seen_on", "seek") & (F.col("scraped_at") >= since)).select("id")


@query("SELECT source, search_query, search_location, count(*) AS runs, CAST(sum(fetched) AS bigint) AS fetched, CAST(sum(created) AS bigint) AS created, CAST(sum(errors) AS bigint) AS errors, count(*) FILTER (NOT ok) AS failed FROM run_results GROUP BY 1, 2, 3")
def run_counters(spark, d):
    return runs.run_counters(table(spark, d, "run_results"))


_EXPECTED = "SELECT run_id, fetched, CASE WHEN count(fetched) OVER w = 3 THEN round(avg(fetched) OVER w, 4) END AS expected FROM run_results WINDOW w AS (PARTITION BY source, search_query, search_location ORDER BY finished_at, run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query(f"SELECT run_id, expected FROM ({_EXPECTED})")
def expected_fetch(spark, d):
    return runs.expected_fetch(table(spark, d, "run_results")).select("run_id", F.round("expected", 4).alias("expected"))


@query(f"SELECT run_id FROM ({_EXPECTED}) WHERE fetched < expected * 0.2")
def sanity_floor(spark, d):
    return runs.below_floor(table(spark, d, "run_results")).select("run_id")


@query("SELECT run_id FROM run_results ORDER BY finished_at DESC, run_id DESC LIMIT 500")
def run_history(spark, d):
    return runs.latest_runs(table(spark, d, "run_results")).select("run_id")


def _snapshots(spark, d, *steps):
    """(key: snapshot_no and id, title, company) of the snapshots that have one before them, and under the same keys
    those so many snapshots earlier."""
    rows = staged(last_deliveries(spark, d).groupBy("snapshot_no", "id").agg(F.max("title").alias("title"), F.max("company").alias("company")), "snapshots")
    numbers = Window.orderBy("snapshot_no")  # a row for each snapshot
    order = staged(rows.select("snapshot_no").distinct().select("snapshot_no", F.lag("snapshot_no").over(numbers).alias("before"), *(F.lead("snapshot_no", n).over(numbers).alias(f"later{n}") for n in steps)), "snapshot-numbers")
    under = lambda no: rows.join(F.broadcast(order.filter("before is not null" if no == "snapshot_no" else f"{no} is not null").withColumn("_under", F.col(no))), "snapshot_no").select(F.struct(F.col("_under").alias("snapshot_no"), "id").alias("key"), "title", "company")
    return under("snapshot_no"), *(under(f"later{n}") for n in steps)


#: Snapshots in their last deliveries, a row an id, with the numbers of the one before and of the one before that.
_SNAP = f"""r AS (SELECT snapshot_no, id, max(title) AS title, max(company) AS company FROM {_LAST} GROUP BY 1, 2),
n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before, lag(snapshot_no, 2) OVER (ORDER BY snapshot_no) AS before2 FROM (SELECT DISTINCT snapshot_no FROM r))"""


@query(f"WITH {_SNAP} SELECT a.snapshot_no, a.id FROM r a JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE a.id = b.id AND b.snapshot_no = n.before)")
def append_new(spark, d):
    return tables.to_append(*_snapshots(spark, d, 1), "key").select("key.snapshot_no", "key.id")


def _decide_sql(c: str) -> str:
    o, t, a = (f"trim(coalesce({x}.{c}, ''), ' ')" for x in "ota")
    return f"CASE WHEN {t} = '' THEN CASE WHEN {o} <> '' THEN 'push' ELSE 'none' END WHEN {o} = {t} THEN 'none' WHEN {o} <> '' AND a.{c} IS NOT NULL AND {t} = {a} THEN 'push' ELSE 'pull' END"


@query(f"WITH {_SNAP} " + " UNION ALL ".join(
    f"SELECT snapshot_no, id, '{c}' AS column_name, action, CASE WHEN action = 'push' THEN mine ELSE theirs END AS value FROM (SELECT o.snapshot_no, o.id, {_decide_sql(c)} AS action, o.{c} AS mine, t.{c} AS theirs "
    f"FROM r o JOIN n USING (snapshot_no) JOIN r t ON o.id = t.id AND t.snapshot_no = n.before LEFT JOIN r a ON o.id = a.id AND a.snapshot_no = n.before2) WHERE action <> 'none'"
    for c in ("title", "company")))
def reconcile_cells(spark, d):
    return tables.cell_actions(*_snapshots(spark, d, 1, 2), "key", ["title", "company"]).select("key.snapshot_no", "key.id", "column_name", "action", "value")


_DIGEST = f"h AS (SELECT r.*, n.before, sha1(concat(coalesce(title, ''), '|', coalesce(company, ''))) AS h FROM r JOIN n USING (snapshot_no))"


@query(f"""WITH {_SNAP}, {_DIGEST}, later AS (SELECT n.snapshot_no, h.id, h.h FROM h JOIN n ON n.before = h.snapshot_no)
SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'drop' WHEN a.h = b.h THEN 'carry' ELSE 'build' END AS action
FROM (SELECT * FROM h WHERE before IS NOT NULL) a FULL JOIN later b ON a.id = b.id AND a.snapshot_no = b.snapshot_no""")
def incremental_actions(spark, d):
    digest = F.sha1(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("company", F.lit("")))).alias("h")
    now, before = (rows.select("key", digest) for rows in _snapshots(spark, d, 1))
    return tables.rebuild_actions(now, before, "key", "h").select("key.snapshot_no", "key.id", "action")


@query("SELECT id, CASE WHEN n = 1 THEN title ELSE title || '_' || n END AS file_name FROM (SELECT id, title, row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY id) AS n FROM jobs)")
def name_collisions(spark, d):
    return tables.numbered_names(jobs(spark, d), "company", "title", "id").select("id", "file_name")


@query(f"""SELECT coalesce(a.platform, 'none') AS platform, count(*) AS n, count(*) FILTER (s.id IS NULL) AS missing
FROM (SELECT j.id, p.source AS platform FROM jobs j LEFT JOIN (SELECT * FROM source_settings WHERE source IN ('seek', 'linkedin')) p ON p.host = {_HOST} WHERE NOT closed) a
LEFT JOIN (SELECT DISTINCT id FROM {_LAST} WHERE snapshot_no = (SELECT max(snapshot_no) FROM job_snapshots)) s ON a.id = s.id GROUP BY 1""")
def work_queue(spark, d):
    """Open jobs by the board to apply on, and how many of them the newest snapshot lacks."""
    last = last_deliveries(spark, d)
    newest = last.agg(F.max("snapshot_no").alias("snapshot_no"))  # one row
    there = last.join(F.broadcast(newest), "snapshot_no").select("id").distinct().withColumn("there", F.lit(True))
    waiting = jobs(spark, d).filter("not closed").select("id", P.url_host(F.col("url")).alias("_host")).join(_platforms(spark, d), "_host", "left").join(there, "id", "left")
    return waiting.groupBy(F.coalesce("platform", F.lit("none")).alias("platform")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


# ---------------------------------------------------------------- texts

_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({{0}}, '([.!?]){B}+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^{B}+|{B}+$', '', 'g')), lambda s: s <> '')"
SENT = lambda c: _SENTENCES.replace("{0}", c)
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST(len({SENT('text')}) AS bigint) AS n_sentences FROM documents WHERE text IS NOT NULL")
def count_sentences(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id, {_NORM.format('s')} AS norm FROM (SELECT doc_id, unnest({SENT('text')}) AS s FROM documents)),
e AS (SELECT {_NORM.format('s')} AS norm, count(DISTINCT item_id) AS n_sources FROM (SELECT item_id, unnest({SENT('text')}) AS s FROM eval_items) GROUP BY 1)
SELECT doc_id, norm, n_sources FROM d JOIN e USING (norm) WHERE len(string_split(norm, ' ')) >= 9""")
def reused_sentences(spark, d):
    return corpus.reused_sentences(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


@query(f"SELECT opener, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, array_to_string(string_split({_NORM.format('text')}, ' ')[1:5], ' ') AS opener, len(string_split({_NORM.format('text')}, ' ')) AS k FROM documents) WHERE k >= 5 GROUP BY 1 HAVING n > 1")
def shared_openers(spark, d):
    return corpus.shared_openers(table(spark, d, "documents"), "doc_id")


@query(f"SELECT w AS lead, count(*) AS n FROM (SELECT split_part({_NORM.format('s')}, ' ', 1) AS w FROM (SELECT unnest({SENT('text')}) AS s FROM documents)) WHERE w <> '' GROUP BY 1 HAVING n > 2")
def lead_words(spark, d):
    rows = corpus.sentence_rows(table(spark, d, "documents"), "doc_id", "text").select(F.split("norm", " ")[0].alias("lead")).filter("lead <> ''")
    return rows.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


@query(r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '—|―|\s–\s') THEN 'dash' END, CASE WHEN regexp_matches(text, '\[[^\]\n]{2,}\]') THEN 'placeholder' END,
  CASE WHEN regexp_matches(text, '(?m)^\s*(?:[-*•▪◦]|\d+[.)])\s+\S') THEN 'list' END, CASE WHEN regexp_matches(text, '(?m)\*\*|^#{1,6}\s') THEN 'markdown' END, CASE WHEN regexp_matches(text, '"career_profile"|"cover_letter"|^\s*[{\[]') THEN 'json' END) AS flags FROM documents WHERE text IS NOT NULL""")
def lint_flags(spark, d):
    t = F.col("text")
    # Marks of generated or pasted text.
    rules = (("dash", r"—|―|\s–\s"), ("placeholder", r"\[[^\]\n]{2,}\]"), ("list", r"(?m)^\s*(?:[-*•▪◦]|\d+[.)])\s+\S"), ("markdown", r"(?m)\*\*|^#{1,6}\s"), ("json", r'"career_profile"|"cover_letter"|^\s*[{\[]'))
    flags = F.concat_ws(",", *(F.when(t.rlike(rx), name) for name, rx in rules))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", flags.alias("flags"))


@query("""SELECT doc_id, CASE WHEN t >= 4 AND t > 1.5 * o THEN 'care' ELSE 'other' END AS label FROM (
  SELECT doc_id, len(regexp_extract_all(lower(text), 'customer|client|training|roster')) AS t, len(regexp_extract_all(lower(text), 'regulatory|governance|methodolog|obligation')) AS o FROM documents WHERE text IS NOT NULL)""")
def classify_by_terms(spark, d):
    low = F.lower("text")
    t, o = F.regexp_count(low, F.lit("customer|client|training|roster")), F.regexp_count(low, F.lit("regulatory|governance|methodolog|obligation"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.when((t >= 4) & (t > 1.5 * o), "care").otherwise("other").alias("label"))
