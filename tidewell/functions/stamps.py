"""Reading of free time notations: one value gives every instant it can validly mean."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICRO = timedelta(microseconds=1)
#: The year 1; what lies before it is no time that a listing can state.
FIRST = (datetime(1, 1, 1, tzinfo=timezone.utc) - EPOCH) // MICRO

# Usual zone letters of Australia, New Zealand and Britain, in minutes east of UTC.
ZONE_LETTERS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "BST": 60, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

# Seconds of the relative units; a month counts 30 days.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
_UNIT_OF = (
    ("mo", "mo"), ("min", "m"), ("sec", "s"), ("h", "h"), ("d", "d"), ("w", "w"), ("y", "y"), ("m", "m"), ("s", "s"),
)

_LEAD = re.compile(r"^(?:re-?)?(?:posted|listed|published|added|updated|date|advertised)(?:\s+(?:on|at))?\s*:?\s+|^(?:posted|listed)\s*:\s*", re.I)
_AGO = re.compile(r"^(?:about |over |around )?(\d+|an?|one)\s*\+?\s*(months?|mths?|mos?|minutes?|mins?|seconds?|secs?|hours?|hrs?|days?|weeks?|wks?|years?|yrs?|[hdwms])\s*\+?\s*(?:ago)?$", re.I)
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?)?"
_ZONE = r"\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_/]+)?(?:\s*\[([A-Za-z_/+-]+)\])?"
_TIME = rf"(?:(?:[T,]|\s|\bat\b)+{_CLOCK}{_ZONE})?"
_YMD = re.compile(rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", re.I)
_COMPACT = re.compile(rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?$")
_SLASH = re.compile(rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}$", re.I)
_DAY_MON = re.compile(rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}){_TIME}$", re.I)
_MON_DAY = re.compile(rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}$", re.I)
_DIGITS = re.compile(r"^\d{9,16}$")

DMY, MDY, YMD, SURE = "DMY", "MDY", "YMD", "sure"
#: Forms a date with slashes may have; the last one only with a year of two digits.
FORMS = (DMY, MDY, YMD)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | timezone | None:
    """A zone by offset, letters or region name; None where the text names no known zone."""
    if not name:
        return None
    if name[0] in "+-":
        digits = name[1:].replace(":", "").ljust(4, "0")
        minutes = int(digits[:2]) * 60 + int(digits[2:])
        return timezone(timedelta(minutes=-minutes if name[0] == "-" else minutes)) if minutes < 1440 else None
    if (letters := name.upper()) in ZONE_LETTERS:
        return timezone(timedelta(minutes=ZONE_LETTERS[letters]))
    if "/" in name:
        try:
            return ZoneInfo(name)
        except Exception:
            return None
    return None


def _micros(moment: datetime) -> int:
    return (moment - EPOCH) // MICRO


def _build(year, month, day, clock, zones, default) -> int | None:
    """UTC microseconds of one civil time. fold=0 gives the earlier of two instants, and moves a skipped
    time on by the length of the gap."""
    hour, minute, second, fraction, half = clock
    try:
        h = int(hour or 0)
        if half:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if half[0] in "pP" else 0)
        zone = default
        if zones[0]:
            zone = _zone(zones[0])
        elif zones[1]:
            zone = _zone(zones[1])
        if zone is None:
            return None
        micro = int(((fraction or "") + "000000")[:6])
        return _micros(datetime(int(year), int(month), int(day), h, int(minute or 0), int(second or 0), micro, tzinfo=zone))
    except (ValueError, OverflowError):
        return None


def _month(word: str) -> int | None:
    return MONTHS.get(word[:3].lower()) if re.fullmatch(r"jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?", word, re.I) else None


def twice(moment: int, tz: str | None) -> bool:
    """Whether the local time of an instant occurs twice in its zone, by a clock put back."""
    zone = _zone(tz) or timezone.utc
    local = (EPOCH + timedelta(microseconds=moment)).astimezone(zone).replace(tzinfo=None)
    return local.replace(tzinfo=zone).utcoffset() != local.replace(tzinfo=zone, fold=1).utcoffset()


_TOLD = re.compile(r"(?:\d|[ap]\.?m\.?)\s*(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_/]+|\[[^\]]+\])$", re.I)


def unsaid_zone(raw: str | None) -> bool:
    """Whether a value states a clock time, but no zone."""
    text = " ".join((raw or "").split())
    return re.search(r"\d:\d{2}", text) is not None and (_TOLD.search(text) is None or re.search(r"[ap]\.?m\.?$", text, re.I) is not None)


def readings(raw: str | None, scraped_micros: int | None, tz: str | None) -> dict[str, int]:
    """{format: UTC microseconds} for each valid reading. One sure reading for most notations; for dates
    with slashes up to three, FORMS. Empty for null, blank and meaningless values, and for relative
    values without scraped_at or from before the year 1. tz: zone of values that name none; UTC where it is null or unknown."""
    text = " ".join((raw or "").split())
    if not text:
        return {}
    default = _zone(tz) or timezone.utc
    if m := _LEAD.match(text):
        text = text[m.end() :]
    if _DIGITS.match(text) and len(text) in (10, 13, 16):
        return {SURE: int(text) * {10: 1_000_000, 13: 1_000, 16: 1}[len(text)]}
    one = None
    if m := _YMD.match(text):
        g = m.groups()
        one = _build(*g[:3], g[3:8], g[8:], default)
    elif m := _COMPACT.match(text):
        g = m.groups()
        one = _build(*g[:3], (*g[3:7], None), g[7:], default)
    elif m := _SLASH.match(text):
        a, mark, b, year, *rest = m.groups()
        short, year = len(year) == 2, year if len(year) == 4 else "20" + year
        dmy = _build(year, b, a, rest[:5], rest[5:], default)
        if mark != "/":  # dotted dates are day first
            one = dmy
        else:
            mdy = _build(year, a, b, rest[:5], rest[5:], default)
            ymd = _build("20" + a, b, year[2:], rest[:5], rest[5:], default) if short and len(a) == 2 else None
            found = {k: v for k, v in zip(FORMS, (dmy, mdy, ymd)) if v is not None}
            if len(set(found.values())) != 1 or dmy is None:
                return found
            one = dmy
    elif m := _DAY_MON.match(text):
        g = m.groups()
        one = _build(g[2], _month(g[1]) or 0, g[0], g[3:8], g[8:], default)
    elif m := _MON_DAY.match(text):
        g = m.groups()
        one = _build(g[2], _month(g[0]) or 0, g[1], g[3:8], g[8:], default)
    elif scraped_micros is not None:
        low = text.lower()
        if m := _AGO.match(low):
            count = 1 if m[1] in ("a", "an", "one") else int(m[1])
            unit = next(u for start, u in _UNIT_OF if m[2].startswith(start) or (start == "mo" and m[2].startswith("mth")))
            back = scraped_micros - count * UNIT_SECONDS[unit] * 1_000_000
            one = back if back >= FIRST else None
        elif low in ("just now", "just posted", "just listed", "just", "now", "today", "new", "moments ago"):
            one = scraped_micros
        elif low == "yesterday":
            one = scraped_micros - UNIT_SECONDS["d"] * 1_000_000
    return {} if one is None else {SURE: one}
