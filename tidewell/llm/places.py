"""Free-entered place names to the entries of a reference list: a partition-based pigeonhole join in SQL.

A name within `k` edits of a reference string keeps at least one of its k + 1 segments unchanged, at most k
places away from where it was. So names and segments meet in an equality join on (length, segment number,
substring); levenshtein verifies what meets, and an anti-join reports what matches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.session import staged

EDITS = 2

# Spellings of states and countries, after dots are dropped and white space is one space.
STATES = {
    "NSW": "new south wales|nsw", "VIC": "victoria|vic", "QLD": "queensland|qld", "SA": "south australia|sth australia|sa",
    "WA": "western australia|west australia|wa", "TAS": "tasmania|tas", "NT": "northern territory|nth territory|nt",
    "ACT": "australian capital territory|act",
}
COUNTRIES = {
    "AU": "australia|aust|aus|au", "NZ": "aotearoa nz|aotearoa|new zealand|nzl|nz", "GB": "united kingdom|great britain|gbr|gb|uk",
    "IN": "india|ind|in", "DE": "deutschland|germany|deu|de", "SG": "singapore|sgp|sg",
}
NOISE = "hybrid|remote|cbd|inner suburbs|northern suburbs|southern suburbs|eastern suburbs|western suburbs|suburbs|greater|metro|area|region|work from home|wfh|on site|onsite|days|day|anywhere|wide|national"
ABBREVIATIONS = {"ck": "creek", "crk": "creek", "hts": "heights", "hgts": "heights", "jct": "junction", "jn": "junction", "pt": "point", "vl": "vale"}
ACCENTED = ("àáâãäåāèéêëēìíîïīòóôõöøōùúûüūñçýÿ", "aaaaaaaeeeeeiiiiiooooooouuuuuncyy")


def _plain(column: str) -> str:
    """SQL: lower case, accents folded, dots dropped, all else that is no letter or digit one space."""
    folded = f"translate(lower({column}), '{ACCENTED[0]}', '{ACCENTED[1]}')"
    return f"trim(regexp_replace(regexp_replace({folded}, '[.\\'’]', ''), '[^a-z0-9]+', ' '))"


def _named(column: str, groups: dict[str, str]) -> str:
    """SQL: code of the first group of which a spelling stands in the text."""
    cases = " ".join(f"WHEN {column} RLIKE '\\\\b({words})\\\\b' THEN '{code}'" for code, words in groups.items())
    return f"CASE {cases} END"


def _name(column: str) -> str:
    """SQL: what a plain text leaves as the name of a place, its abbreviations spelled out."""
    words = "|".join([*STATES.values(), *COUNTRIES.values(), NOISE, "[0-9]+"])
    # The longest spelling first, so that "south australia" goes before "australia".
    ordered = "|".join(sorted(words.split("|"), key=lambda w: (-len(w), w)))
    out = f"regexp_replace({column}, '\\\\b({ordered})\\\\b', ' ')"
    out = f"regexp_replace({out}, '^ *pt\\\\b', 'port')"
    for short, full in ABBREVIATIONS.items():
        out = f"regexp_replace({out}, '\\\\b{short}\\\\b', '{full}')"
    return f"trim(regexp_replace({out}, ' +', ' '))"


MATCH_SQL = f"""
WITH refs AS (
  SELECT place_id, state, country, explode(array_union(array(city), coalesce(aliases, array()))) AS written FROM {{places}} WHERE place_id IS NOT NULL),
strings AS (SELECT DISTINCT ref FROM (SELECT {_plain("written")} AS ref FROM refs WHERE written IS NOT NULL) WHERE ref <> ''),
segments AS (
  SELECT ref, length(ref) AS n, i AS seg,
    CAST(floor(length(ref) * i / {EDITS + 1}) AS int) + 1 AS pos,
    substring(ref, CAST(floor(length(ref) * i / {EDITS + 1}) AS int) + 1, CAST(floor(length(ref) * (i + 1) / {EDITS + 1}) AS int) - CAST(floor(length(ref) * i / {EDITS + 1}) AS int)) AS part
  FROM strings LATERAL VIEW explode(sequence(0, {EDITS})) t AS i),
probes AS (
  SELECT name, n, seg, CAST(floor(n * seg / {EDITS + 1}) AS int) + 1 + shift AS at,
    substring(name, CAST(floor(n * seg / {EDITS + 1}) AS int) + 1 + shift, CAST(floor(n * (seg + 1) / {EDITS + 1}) AS int) - CAST(floor(n * seg / {EDITS + 1}) AS int)) AS part
  FROM {{names}}
  LATERAL VIEW explode(sequence(greatest(length(name) - {EDITS}, 1), length(name) + {EDITS})) a AS n
  LATERAL VIEW explode(sequence(0, {EDITS})) b AS seg
  LATERAL VIEW explode(sequence(-{EDITS}, {EDITS})) c AS shift)
SELECT /*+ SHUFFLE_HASH(s) */ DISTINCT p.name, s.ref, levenshtein(p.name, s.ref) AS edits
FROM probes p JOIN segments s ON p.n = s.n AND p.seg = s.seg AND p.part = s.part
WHERE p.at >= 1 AND levenshtein(p.name, s.ref, {EDITS}) >= 0
"""


def match_names(names: DataFrame, places: DataFrame) -> DataFrame:
    """(name, ref, edits): each distinct name with the reference strings up to EDITS edits away. names: one
    column `name`, plain and not empty."""
    return names.sparkSession.sql(MATCH_SQL, names=names.distinct(), places=places)


ROWS_SQL = f"""
SELECT whole, part, state_said, country_said, name FROM (
  SELECT whole, part, {_named("t", STATES)} AS state_said, {_named("t", COUNTRIES)} AS country_said, {_name("t")} AS name
  FROM (SELECT whole, part, {_plain("txt")} AS t FROM {{texts}}))
"""

DECIDE_SQL = """
WITH refs AS (
  SELECT DISTINCT place_id, lower(city) AS city, state, country, {plain} AS ref
  FROM {{places}} LATERAL VIEW explode(array_union(array(city), coalesce(aliases, array()))) t AS written WHERE place_id IS NOT NULL),
said AS (SELECT whole, max(state_said) AS state_said, max(country_said) AS country_said, max(name) AS name FROM {{parsed}} GROUP BY whole),
fits AS (
  SELECT p.whole, r.place_id, min(m.edits) AS edits, any_value(r.state) AS state, any_value(r.country) AS country, any_value(r.city) AS city
  FROM {{parsed}} p JOIN {{matches}} m ON p.name = m.name JOIN refs r ON m.ref = r.ref GROUP BY p.whole, r.place_id),
scored AS (
  SELECT f.whole, f.place_id, f.edits, f.city,
    CASE WHEN s.state_said IS NOT NULL THEN if(f.state = s.state_said, 2, 0) WHEN s.country_said IS NOT NULL THEN if(f.country = s.country_said, 1, 0) ELSE 0 END AS backed
  FROM fits f JOIN said s ON f.whole = s.whole),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY whole ORDER BY edits, backed DESC) AS nth FROM scored),
found AS (SELECT whole, if(count(*) = 1, max(place_id), -1) AS place_id, min(edits) AS edits, min(city) AS named FROM ranked WHERE nth = 1 GROUP BY whole)
SELECT whole, place_id, edits, named FROM found
UNION ALL
SELECT s.whole, CAST(-1 AS bigint), CAST(NULL AS int), nullif(s.name, '') FROM said s LEFT ANTI JOIN found f ON s.whole = f.whole
""".replace("{plain}", _plain("written").replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")


def map_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(whole, place_id bigint, edits, named) for each distinct `whole` of texts; named: the city meant, or what
    is written where no listed place is meant, null where that is nothing.

    texts: whole (key of a value as a whole), part (name of its field), txt. Fields are read together: each
    may name the place or only its state or country. The nearest reference string wins, then what state and
    country back; -1 where nothing is within EDITS edits, or where two places are left. Null and blank texts
    name nothing; an empty list matches nothing.
    """
    spark = texts.sparkSession
    # Written out: both are read several times, and small beside what they are worked out from.
    parsed = staged(spark.sql(ROWS_SQL, texts=texts), "place-names")
    matches = staged(match_names(parsed.filter("name <> ''").select("name"), places), "place-matches")
    return spark.sql(DECIDE_SQL, parsed=parsed, matches=matches, places=places)
