"""Functions that turn the strings of a posting into typed, comparable columns."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import bound, collapse, stripped, word

# Words without identity in names of firms and in titles.
COMPANY_NOISE = "pty ltd limited inc llc group holdings australia australian aus au recruitment recruiting consulting technologies technology solutions services international global"
TITLE_NOISE = r"urgent|urgently|hiring|now|immediate start|apply now|new|hot job|multiple positions|x\d+|associate"


def make_id(source: Column, source_id: Column) -> Column:
    return F.sha1(F.concat_ws(":", source, source_id))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def normal_company(name: Column) -> Column:
    """Lower case, letters and digits only, words without identity dropped; null gives ''."""
    kept = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9 ]+", " ")
    return _squeezed(F.regexp_replace(kept, rf"\b({COMPANY_NOISE.replace(' ', '|')})\b", " "))


def normal_title(title: Column) -> Column:
    """Lower case without brackets, what follows a bar or long dash, and calls to apply; null gives ''."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\([^)]*\)", " ")
    text = F.replace(F.regexp_replace(text, r"[|–—][^\n\r]*$", " "), F.lit("&"), F.lit("and"))
    text = F.regexp_replace(text, "[^a-z0-9+# ]+", " ")
    return _squeezed(F.regexp_replace(text, rf"\b({TITLE_NOISE})\b", " "))


def fingerprint(title: Column, company: Column, city: Column) -> Column:
    return F.sha1(F.concat_ws("|", normal_title(title), normal_company(company), F.trim(F.lower(F.coalesce(city, F.lit(""))))))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_title(title), " "), lambda w: w != ""))


def employment_type(raw: Column, title: Column) -> Column:
    """First kind whose words stand anywhere in label or title; 'unknown' otherwise."""
    text = F.lower(F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    # Kinds and their words, first hit wins.
    kinds = (
        ("internship", "intern|graduate program|trainee"), ("casual", "casual"), ("contract", "contract|temp|fixed[ -]term|daily rate|day rate"),
        ("part-time", "part[ -]time"), ("full-time", "full[ -]time|permanent|perm([^a-z0-9_]|$)"),
    )
    return F.coalesce(*(F.when(text.rlike(rx), kind) for kind, rx in kinds), F.lit("unknown"))


# Countries by name first, then by city; the first hit wins, AU is assumed without one.
COUNTRY_WORDS = (
    ("NZ", "new zealand"), ("IE", "ireland"), ("GB", "united kingdom|england|scotland|northern ireland|uk"), ("DE", "germany"), ("NL", "netherlands|holland"),
    ("CA", "canada"), ("SG", "singapore"), ("AE", "united arab emirates|uae"), ("AU", "australia"),
    ("NZ", "auckland|wellington|christchurch"), ("IE", "dublin"), ("GB", "london|manchester|birmingham|edinburgh|glasgow"),
    ("DE", "berlin|munich|münchen|hamburg|frankfurt"), ("NL", "amsterdam|rotterdam|utrecht|the hague|den haag"),
    ("CA", "toronto|vancouver|montreal|ottawa|calgary"), ("AE", "dubai|abu dhabi|sharjah"),
)
# States in the order in which they are looked for.
STATE_WORDS = (
    ("vic", "VIC"), ("victoria", "VIC"), ("nsw", "NSW"), ("new south wales", "NSW"), ("qld", "QLD"), ("queensland", "QLD"), ("wa", "WA"), ("western australia", "WA"),
    ("sa", "SA"), ("south australia", "SA"), ("tas", "TAS"), ("tasmania", "TAS"), ("act", "ACT"), ("australian capital territory", "ACT"), ("nt", "NT"), ("northern territory", "NT"),
)
# Labels of one metropolitan area, and larger cities with their states.
METRO = ("cbd & inner suburbs", "eastern suburbs", "western suburbs", "northern suburbs", "south eastern suburbs", "bayside & south eastern suburbs", "melbourne")
CITY_STATE = (
    ("melbourne", "VIC"), ("geelong", "VIC"), ("ballarat", "VIC"), ("bendigo", "VIC"), ("sydney", "NSW"), ("newcastle", "NSW"), ("wollongong", "NSW"), ("central coast", "NSW"),
    ("brisbane", "QLD"), ("gold coast", "QLD"), ("sunshine coast", "QLD"), ("cairns", "QLD"), ("townsville", "QLD"), ("perth", "WA"), ("adelaide", "SA"), ("canberra", "ACT"),
    ("hobart", "TAS"), ("launceston", "TAS"), ("darwin", "NT"),
)


def country(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(word(rx)), code) for code, rx in COUNTRY_WORDS), F.lit("AU"))


def location(raw: Column, remote_hint: Column) -> Column:
    """struct<raw, city, state, country, remote> of a location label."""
    flat = collapse(raw)
    return bound(F.struct(flat.alias("text"), F.lower(flat).alias("low"), F.coalesce(remote_hint, F.lit(False)).alias("hint")), _location_of)


def _location_of(t: Column) -> Column:
    text, low = t["text"], t["low"]
    state = F.coalesce(*(F.when(low.rlike(rf"(^|[\s,(/-]){name}($|[\s,)/-])"), code) for name, code in STATE_WORDS))
    first = F.trim(F.split(text, r"[,|]")[0])
    names = F.array(*(F.lit(n) for n, _ in STATE_WORDS))
    city = F.coalesce(
        F.when(low.rlike("|".join(METRO)), "Melbourne"), *(F.when(F.contains(low, F.lit(n)), F.initcap(F.lit(n))) for n, _ in CITY_STATE),
        F.when((first != "") & ~F.array_contains(names, F.lower(first)), first),
    )
    by_city = F.coalesce(*(F.when(F.lower(city) == n, s) for n, s in CITY_STATE))
    remote = t["hint"] | low.rlike(word("remote|work from home|wfh|anywhere"))
    return F.struct(text.alias("raw"), city.alias("city"), F.coalesce(state, by_city).alias("state"), country(text).alias("country"), remote.alias("remote"))


# Words of the periods of pay, first hit wins.
PERIODS = (
    ("year", r"p\.?a\.?|per\s*annum|annual|year|yr"), ("month", r"per\s*month|p\.?m\.?|month"),
    ("day", r"per\s*day|p\.?d\.?|daily|/\s*day|day\s*rate"), ("hour", r"per\s*hour|p\.?h\.?|hourly|/\s*hr|/\s*hour|hour"),
)


def salary_label(raw: Column) -> Column:
    """struct<pay_min, pay_max, period> of a label; null where it states no figure. Figures below 1000 count
    only with a currency, a k or a period; the largest one decides a period that is not stated."""
    return bound(stripped(F.regexp_replace(F.lower(raw), "[–—]", "-")), _salary_of)


def _salary_of(text: Column) -> Column:
    border = lambda rx: rf"(^|[^a-z0-9_])({rx})([^a-z0-9_]|$)"
    said = F.coalesce(*(F.when(text.rlike(border(rx) if kind != "day" and kind != "hour" else rf"{border(rx.split('|/')[0])}|{rx[rx.index('|/') + 1 :]}"), kind) for kind, rx in PERIODS), F.lit("unknown"))
    named = text.rlike(border("aud|nzd|usd"))
    hits = F.regexp_extract_all(text, F.lit(r"\$?\s*\d[\d,]*(?:\.\d+)?\s*(?:k\b)?"), F.lit(0))
    plain = lambda h: F.regexp_replace(h, r"[^0-9.]", "").cast("double")
    value = lambda h: plain(h) * F.when(F.contains(h, F.lit("k")), 1000.0).otherwise(1.0)
    counts = lambda h: F.contains(h, F.lit("$")) | named | F.contains(h, F.lit("k")) | (said != "unknown") | (value(h) >= 1000)
    figures = F.transform(F.filter(hits, counts), value)
    low, high = F.array_min(figures), F.array_max(figures)
    period = F.when(said != "unknown", said).when(high >= 20000, "year").when(high >= 300, "day").when(high <= 250, "hour").otherwise("unknown")
    upto = text.rlike("up to|max") & (F.size(figures) == 1)
    pay = F.struct(F.when(~upto, low).alias("pay_min"), F.when(upto | (high != low), high).alias("pay_max"), period.alias("period"))
    return F.when(F.size(figures) > 0, pay)


def format_location(city: Column, state: Column, raw: Column, remote: Column) -> Column:
    named = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))
    base = F.when(named != "", named).otherwise(F.coalesce(raw, F.lit("")))
    return F.when(F.coalesce(remote, F.lit(False)) & ~F.lower(base).contains("remote"), F.concat(base, F.lit(" (Remote)"))).otherwise(base)


def format_salary(low: Column, high: Column, period: Column) -> Column:
    """'$a-$b/period', '$a+/period', 'up to $b/period' or ''; 0 counts as missing."""
    money = lambda x: F.concat(F.lit("$"), F.call_function("format_number", x, F.lit("#,##0.###")))
    has = lambda x: F.coalesce(x, F.lit(0.0)) != 0
    tail = F.concat(F.lit("/"), F.coalesce(period, F.lit("unknown")))
    return (
        F.when(has(low) & has(high), F.concat(money(low), F.lit("-"), money(high), tail)).when(has(low), F.concat(money(low), F.lit("+"), tail))
        .when(has(high), F.concat(F.lit("up to "), money(high), tail)).otherwise("")
    )


def duration_seconds(spec: Column) -> Column:
    """Seconds of '24h', '7d', '2w', '1m' (a month has 30 days); null for anything else."""
    count = F.regexp_extract(F.trim(spec), r"(?i)^(\d+)\s*[hdwm]$", 1)
    unit = F.lower(F.substring(F.trim(spec), -1, 1))
    return F.when(count != "", count.cast("bigint") * F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).otherwise(2592000))


def days_since(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def platform(url: Column) -> Column:
    """The board that a url belongs to, by the name of its site; null for others."""
    low = F.lower(url)
    return F.when(F.contains(low, F.lit("linkedin.com")), "linkedin").when(F.contains(low, F.lit("seek.com")), "seek")


def url_host(url: Column) -> Column:
    """The host of a url in lower case, that of a mobile page as of the page itself; '' where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), "^[a-z]+://([^/:?#]+)", 1), r"^m\.", "")


# Tags in order, their patterns, and whether only the title is read.
TAGS = (
    ("java", r"\bjava\b", False), ("spring", r"\bspring( boot)?\b", False), ("kotlin", r"\bkotlin\b", False), ("typescript", r"\btypescript\b|\bts[ ,/)]", False),
    ("javascript", r"\bjavascript\b|\bjs[ ,/)]", False), ("react", r"\breact(\.js)?\b", False), ("angular", r"\bangular\b", False), ("vue", r"\bvue(\.js)?\b", False),
    ("node", r"\bnode(\.js)?\b", False), ("python", r"\bpython\b", False), ("csharp", r"\bc#|\.net\b|dotnet", False), ("go", r"\bgolang\b|\bgo( developer| engineer)", False),
    ("sql", r"\bsql\b", False), ("postgres", r"\bpostgres(ql)?\b", False), ("mysql", r"\bmysql\b", False), ("mongodb", r"\bmongo(db)?\b", False),
    ("aws", r"\baws\b|amazon web services", False), ("azure", r"\bazure\b", False), ("gcp", r"\bgcp\b|google cloud", False), ("docker", r"\bdocker\b", False),
    ("kubernetes", r"\bkubernetes\b|\bk8s\b", False), ("terraform", r"\bterraform\b", False), ("graphql", r"\bgraphql\b", False), ("rest", r"\brest(ful)? api", False),
    ("microservices", r"\bmicroservice", False), ("ci-cd", r"\bci/cd\b|jenkins|github actions|gitlab ci", False),
    ("testing", r"\bqa\b|automat(ed|ion) test(ing)?|test automation|selenium|cypress|playwright|junit|jest", False), ("agile", r"\bagile\b|\bscrum\b", False),
    ("junior", r"\bjunior\b|\bjnr\b|\bgraduate\b|\bentry[ -]level\b", True), ("mid", r"\bmid[ -]level\b|\bintermediate\b", True),
    ("senior", r"\bsenior\b|\bsnr\b|\blead\b|\bprincipal\b|\bstaff engineer\b", True), ("hybrid", r"\bhybrid\b", False), ("remote", r"\bremote\b|work from home", False),
    ("visa-sponsorship", r"visa sponsor|sponsorship (is )?(available|offered)|482|tss visa", False),
    ("citizen-only", r"must be (an )?australian citizen|citizens? only|security clearance|nv1|baseline clearance", False),
)


def _alternatives(pattern: str) -> list[str]:
    """Alternatives of a pattern outside its brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _literal(alternative: str) -> str:
    """What every match of an alternative begins with."""
    m = re.match(r"(?:\\b)?((?:[a-z0-9#/ -]|\\\.)*)(.?)", alternative)
    return (m[1][:-1] if m[2] == "?" else m[1]).replace("\\.", ".")


def tags(title: Column, *bodies: Column) -> Column:
    """Tags whose pattern occurs, in the order of the list; seniority is read from the title only. Word borders
    are those of ASCII: other letters count as none. A pattern runs only where its literals occur."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\x00-\x7F]", "!")
    head = F.coalesce(plain(title), F.lit(""))
    whole = plain(F.concat_ws(" \n ", F.nullif(title, F.lit("")), *(F.nullif(b, F.lit("")) for b in bodies)))

    def found(text: Column, pattern: str) -> Column:
        near = [F.contains(text, F.lit(_literal(a))) for a in _alternatives(pattern)]
        return functools.reduce(lambda x, y: x | y, near) & text.rlike(pattern)

    each = lambda t: F.array_compact(F.array(*(F.when(found(t["head"] if only else t["whole"], rx), F.lit(tag)) for tag, rx, only in TAGS)))
    return bound(F.struct(head.alias("head"), whole.alias("whole")), each)


def file_part(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def title_clause(title: Column) -> Column:
    """What stands before the first spaced dash or any of , / ( : ; |"""
    return F.trim(F.regexp_replace(title, r"(?s)( - | – | — |[,/(:;|]).*$", ""))


def company_token(name: Column) -> Column:
    """File-name part of a firm: initials of names over 30 characters or 4 words, else its letters and digits."""
    flat = collapse(name)
    words = F.filter(F.split(flat, " "), lambda w: w.rlike("^[A-Za-z0-9]"))
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when((F.length(flat) > 30) | (F.size(F.split(flat, " ")) > 4), initials).otherwise(file_part(flat))


def file_stem(prefix: str, company: Column, title: Column, suffix: str, most: int = 75) -> Column:
    """prefix_Company_Title_suffix of at most `most` characters: the whole title, else its first clause, else
    that cut at a word, else 'Role'."""
    room = F.lit(most - len(prefix) - len(suffix) - 3) - F.length(company_token(company))
    whole, clause = file_part(title), file_part(title_clause(title))
    cut = F.regexp_replace(F.regexp_replace(F.substr(clause, F.lit(1), F.greatest(room + 1, F.lit(1)).cast("int")), "_?[^_]*$", ""), "_+$", "")
    part = F.when((whole != "") & (F.length(whole) <= room), whole).when((clause != "") & (F.length(clause) <= room), clause).when(cut != "", cut).otherwise("Role")
    return F.concat_ws("_", F.lit(prefix), company_token(company), part, F.lit(suffix))


def folder_name(company: Column) -> Column:
    """A folder name that every file system takes, at most 60 characters."""
    flat = F.regexp_replace(collapse(F.regexp_replace(company, r'[<>:"/\\|?*\x00-\x1F]', " ")), r"[. ]+$", "")
    short = F.regexp_replace(F.substring(flat, 1, 60), r"[. ]+$", "")
    reserved = F.lower(short).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when(F.coalesce(short, F.lit("")) == "", "Unknown company").when(reserved, F.concat(short, F.lit(" Co"))).otherwise(short)


def company_key(name: Column) -> Column:
    return F.coalesce(F.nullif(normal_company(name), F.lit("")), F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", ""))


def liveness(source: Column, html: Column) -> Column:
    """'expired', 'open' or 'unknown' of a listing page."""
    gone = html.rlike(r"(?i)no longer (?:advertised|accepting applications|available)|job (?:has )?expired")
    seek = F.when(html.rlike(r'"isExpired"\s*:\s*true') | gone, "expired").when(html.rlike(r'"isExpired"\s*:\s*false'), "open")
    other = F.when(html.rlike("apply-link|apply-button"), "open").when(gone, "expired")
    return F.coalesce(F.when(source == "seek", seek).when(source == "linkedin", other), F.lit("unknown"))


def apply_method(html: Column) -> Column:
    """'external', 'quick_apply', 'easy_apply' or null of a detail page: a flag of the first board's data, else what
    the button of the second board's page leads to."""
    out = F.regexp_extract(html, r'"isLinkOut"\s*:\s*(true|false)', 1)
    button = F.regexp_extract(html, "public_jobs_apply-link-(onsite|simple|offsite)", 1)
    return F.when(out == "true", "external").when(out == "false", "quick_apply").when(button == "offsite", "external").when(button != "", "easy_apply")


# Names of the ways to apply.
APPLY_LABELS = {"easy_apply": "Easy Apply", "quick_apply": "Quick Apply", "external": "External"}


def apply_label(method: Column) -> Column:
    return F.coalesce(*(F.when(method == code, name) for code, name in APPLY_LABELS.items()), F.lit(""))


def batch_name(at: Column) -> Column:
    """A name for a batch begun at a time, in the session's zone."""
    return F.date_format(at, "yyyy-MM-dd-HH-mm-ss")
