"""Amounts of pay in free text: a multi-pattern automaton finds unit words, context decides what they mean."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick

CURRENCY, PERIOD, AFTER, BEFORE, UPTO, FROM = "currency", "period", "after", "before", "upto", "from"

# Spellings of the units. `$` alone names no currency.
CURRENCY_WORDS = {
    "AUD": "aud|a$|au$|aus$|aus dollars|aus dollar|australian dollars|australian dollar",
    "NZD": "nzd|nz$|nz dollars|nz dollar|new zealand dollars",
    "USD": "usd|us$|u.s.$|us dollars|us dollar",
    "GBP": "gbp|£|pounds|pound|sterling|gb£|pounds sterling",
    "EUR": "eur|€|euro|euros",
    "SGD": "sgd|s$|sg$|sing dollars|singapore dollars",
    "": "$|dollars",
}
PERIOD_WORDS = {
    "year": "per annum|per year|a year|an year|p.a.|p.a|pa|p/a|/yr|/year|/annum|/pa|yr|yearly|annually|annual|annum|year|each year|every year|py|p.y.|per yr",
    "month": "per month|a month|p.m.|p.m|pm|/month|/mth|/mo|mth|monthly|month|per mth|pcm|each month|calendar month",
    "fortnight": "per fortnight|a fortnight|p.f.|p.f|pf|/fn|/fortnight|fn|fortnightly|fortnight|per fn|f/n|pfn|each fortnight|every fortnight",
    "week": "per week|a week|p.w.|p.w|pw|/wk|/week|wk|weekly|week|per wk|each week",
    "day": "per day|a day|p.d.|p.d|pd|/day|/d|daily rate|day rate|daily|per diem|day|each day",
    "hour": "per hour|an hour|a hour|p.h.|p.h|ph|/hr|/hour|/h|hr|hourly|hour|hourly rate|per hr|each hour",
}
# Words that make the figure before or after them something else than pay.
AFTER_WORDS = "%|per cent|percent|hour roster|hours roster|hr roster|hour week|hours per week|hours a week|hours|hrs|hour shift|hour shifts|positions|position|roles|vacancies|openings|people|staff|heads|headcount|fte|days on|days off|off|days|day week|weeks leave|weeks|months|month contract|month|years experience|years|years of experience|years' experience|yrs exp|year experience|+ years|shifts|locations|sites"
BEFORE_WORDS = "level|levels|band|grade|step|tier|class|stage|band level|lvl|pay point|scale|hew|ref|reference|on"
UPTO_WORDS = "up to|upto|max|max.|maximum|maximum of|to a maximum of|to a max of|no more than|capped at"
FROM_WORDS = "from|starting at|starting from|starts at|min|min.|minimum|minimum of|at least|not less than|upwards of|above|over"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, groups in ((CURRENCY, CURRENCY_WORDS), (PERIOD, PERIOD_WORDS)):
        for code, words in groups.items():
            for word in words.split("|"):
                found.add_word(word, (word, kind, code))
    for kind, words in ((AFTER, AFTER_WORDS), (BEFORE, BEFORE_WORDS), (UPTO, UPTO_WORDS), (FROM, FROM_WORDS)):
        for word in words.split("|"):
            # "month", "hour", "day" stay units where a unit is spelled the same.
            if word not in found:
                found.add_word(word, (word, kind, ""))
    found.make_automaton()
    return found


def aliases(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, code) of unit words in lower-cased text: whole words only, longest match first,
    none overlapping."""
    hits = []
    for last, (word, kind, code) in automaton().iter(text):
        start, end = last - len(word) + 1, last + 1
        # A word may touch a figure, but no letter; signs bind to letters before them only as listed.
        if word[0].isalpha() and start and text[start - 1].isalpha():
            continue
        if word[-1].isalpha() and end < len(text) and text[end].isalpha():
            continue
        hits.append((start, end, kind, code))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    kept: list[tuple[int, int, str, str]] = []
    for hit in hits:
        if all(hit[1] <= k[0] or hit[0] >= k[1] for k in kept):
            kept.append(hit)
    return sorted(kept)


_FIGURE = re.compile(r"\d{1,3}(?:[ ’'   ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?(?![\d])|\d+[.,]\d{1,2}(?!\d)|\d+(?:\.\d+)?")


def _value(figure: str) -> float:
    text = re.sub(r"[ ’'   ]", "", figure)
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?", text):
        return float(text.replace(".", "").replace(",", "."))
    if re.fullmatch(r"\d+,\d{1,2}", text):
        return float(text.replace(",", "."))
    return float(text.replace(",", ""))


@dataclass(frozen=True)
class Pay:
    low: float | None  # lowest and highest figure, thousands worked out; None where open
    high: float | None
    currency: str | None  # None where the text names none
    period: str | None
    thousands: bool  # the text gives its figures in thousands


def parse_pay(raw: str | None) -> Pay | None:
    """Pay stated in a text. Figures None where it names units only; None where it says nothing of pay."""
    text = " ".join((raw or "").lower().replace("—", "-").replace("–", "-").replace("−", "-").split())
    if not text:
        return None
    words = aliases(text)
    figures = []
    for m in _FIGURE.finditer(text):
        start, end = m.span()
        if start and (text[start - 1].isalpha() and not any(w[1] == start for w in words)):
            continue  # part of a code such as SIT331
        k = re.match(r"\s?k\b", text[end:])
        stop = end + (k.end() if k else 0)
        plus = text[stop : stop + 1] == "+"
        after = next((w for w in words if w[0] >= stop and not text[stop : w[0]].strip(" +")), None)
        before = next((w for w in reversed(words) if w[1] <= start and not text[w[1] : start].strip(" :.-#")), None)
        if after and after[2] == AFTER or before and before[2] == BEFORE:
            continue
        figures.append((start, _value(m[0]), bool(k), plus))
    currencies = [w[3] for w in words if w[2] == CURRENCY]
    currency = next((c for c in currencies if c), None)
    period = next((w[3] for w in words if w[2] == PERIOD), None)
    thousands = any(f[2] for f in figures)
    scaled = []
    for i, (start, value, k, plus) in enumerate(figures):
        # "74-90 k": the mark after a later figure holds for the ones before it too
        k = k or (value < 1000 and any(f[2] for f in figures[i + 1 :]))
        scaled.append((start, value * 1000 if k else value, k, plus))
    scaled = [f for f in scaled if currencies or f[2] or period or f[1] >= 1000 or (f[1] >= 20 and len(text) <= 12 and len(figures) == 1 and "." in text)]
    if not scaled:
        return Pay(None, None, currency, period, False) if currency or period else None
    low, high = min(f[1] for f in scaled), max(f[1] for f in scaled)
    if len(scaled) == 1:
        marks = [w[2] for w in words if w[1] <= scaled[0][0]]
        if UPTO in marks:
            low = None
        elif FROM in marks or scaled[0][3]:
            high = None
    return Pay(low, high, currency, period, thousands)


@lru_cache(maxsize=4096)
def unit_of(kind: str, word: str | None) -> str | None:
    """Code of a unit given in a field of its own; None where it is missing, unknown or names none."""
    text = " ".join((word or "").lower().split())
    hits = [h for h in aliases(text) if h[2] == kind and h[3]]
    return hits[0][3] if hits else None


def period_by_size(largest: float | None) -> str | None:
    """The unstated period, decided by the largest figure; None between 250 and 300 and without figures."""
    if largest is None:
        return None
    return "year" if largest >= 20000 else "day" if largest >= 300 else "hour" if largest <= 250 else None
