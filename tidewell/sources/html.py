"""Parts of HTML pages that no regular expression finds: nested elements and JSON inside scripts.

Functions of Python strings, and Arrow-batched column functions over them.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_at(html: str, tag: str, start: int) -> str | None:
    """The element that opens at `start`, with all nested ones; None if it never closes."""
    depth = 0
    for m in re.compile(rf"<(/?){tag}\b[^>]*?(/?)>", re.I).finditer(html, start):
        if m[1]:
            depth -= 1
        elif not m[2]:
            depth += 1
        if depth == 0:
            return html[start : m.end()]
    return None


def cards(html: str | None, tag: str = "li") -> list[str]:
    """Consecutive outermost elements of a tag, nested ones inside them; an unclosed one is left out."""
    out, at = [], 0
    opening = re.compile(rf"<{tag}\b", re.I)
    while html and (m := opening.search(html, at)):
        card = element_at(html, tag, m.start())
        at = m.start() + (len(card) if card else 1)
        if card:
            out.append(card)
    return out


def marked_div(html: str | None, marker: str) -> str | None:
    """Inside of the div that carries a marker (an attribute or class), its quotes written either way."""
    found = re.search(re.escape(marker).replace('"', "[\"']"), html or "")
    at = found.start() if found else -1
    start = html.rfind("<div", 0, at) if at >= 0 else -1
    whole = element_at(html, "div", start) if start >= 0 else None
    return whole[whole.index(">") + 1 : whole.rindex("<")] if whole else None


def _walk(node: Any):
    todo = [node]
    while todo:
        node = todo.pop(0)
        yield node
        if isinstance(node, dict):
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)


def posting_ld(html: str | None) -> str | None:
    """The first JobPosting of the page's JSON-LD blocks, as JSON; blocks that do not parse are passed over."""
    for block in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html or "", re.I | re.S):
        try:
            parsed = json.loads(block)
        except ValueError:
            continue
        for node in _walk(parsed):
            if isinstance(node, dict) and "jobposting" in str(node.get("@type", "")).lower():
                return json.dumps(node)
    return None


# Names under which pages keep the text of an advertisement.
DESCRIPTION_KEYS = ("content", "description", "jobAdDetails", "adDetails")


def embedded_description(html: str | None, posting_id: str | None, least: int = 200) -> str | None:
    """A long description inside the page's embedded data, below the node of the posting if it is there."""
    m = re.search(r"<script[^>]*__NEXT_DATA__[^>]*>(.*?)</script>", html or "", re.I | re.S)
    try:
        data = json.loads(m[1]) if m else None
    except ValueError:
        return None

    def longest(root: Any) -> str | None:
        texts = [n[k] for n in _walk(root) if isinstance(n, dict) for k in DESCRIPTION_KEYS if isinstance(n.get(k), str)]
        return next((t for t in texts if len(t) > least and ("<" in t or " " in t)), None)

    for node in _walk(data):
        if isinstance(node, dict) and posting_id and posting_id in {str(node.get(k)) for k in ("id", "jobId", "adId")}:
            if found := longest(node):
                return found
    return longest(data)


@F.pandas_udf(T.ArrayType(T.StringType()))
def cards_of(html: pd.Series) -> pd.Series:
    return html.map(cards)


@F.pandas_udf(T.StringType())
def posting_ld_of(html: pd.Series) -> pd.Series:
    return html.map(posting_ld)


@F.pandas_udf(T.StringType())
def marked_div_of(html: pd.Series, marker: pd.Series) -> pd.Series:
    return pd.Series([marked_div(h, m) for h, m in zip(html, marker)])


@F.pandas_udf(T.StringType())
def embedded_description_of(html: pd.Series, posting_id: pd.Series) -> pd.Series:
    return pd.Series([embedded_description(h, p) for h, p in zip(html, posting_id)])
