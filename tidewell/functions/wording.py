"""Titles, firms, terms and verbs as prose uses them; column expressions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.postings import title_clause
from tidewell.functions.text import BLANKS, bound, collapse, numbers_in, word

# Places and ways of working that end a title, and words that a firm's name in prose goes without.
TITLE_ENDS = "NSW|VIC|QLD|WA|SA|TAS|ACT|NT|Remote|Hybrid|Sydney|Melbourne|Brisbane|Perth|Adelaide|Canberra|Hobart|Darwin|Auckland|Wellington|London|Dublin|Singapore"
FIRM_ENDS = "pty|ltd|limited|inc|llc|group|australia|holdings|corporation|corp|banking"
BRACKETS = r"\([^)]*\)|\[[^\]]*\]"
#: A title longer than this is cut to its first clause.
HEADLINE = 45

# Verbs of achievement, and forms that no ending explains.
VERBS = (
    "own build lead write find make cut set ship teach bring choose create develop design implement deliver resolve fix trace introduce validate mentor automate diagnose optimise "
    "optimize improve reduce migrate integrate maintain manage author analyse analyze coordinate launch establish refactor deploy configure architect co-author promote collaborate "
    "streamline identify investigate debug drive achieve replace switch follow apply construct produce prototype spearhead"
).split()
IRREGULAR = {
    "built": "build", "led": "lead", "wrote": "write", "written": "write", "ran": "run", "found": "find", "made": "make", "cut": "cut", "set": "set",
    "shipped": "ship", "taught": "teach", "brought": "bring", "drove": "drive", "chose": "choose", "chosen": "choose",
}


def headline(title: Column) -> Column:
    """A title without brackets and without a last part that names a place or a way of working; cut to its first
    clause where it is long. Null gives ''."""
    dash = "[-–—|]"
    place = rf"(?i){BLANKS}+{dash}{BLANKS}+(?:[^-–—|]*[^A-Za-z0-9_–—|-])?(?:{TITLE_ENDS})(?:[^A-Za-z0-9_–—|-][^-–—|]*)?$"
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), BRACKETS, " "), place, "")
    flat = F.regexp_replace(collapse(bare), r"[ ,–—|:-]+$", "")
    return bound(flat, lambda t: F.when(F.length(t) <= HEADLINE, t).otherwise(title_clause(t)))


def prose_name(company: Column) -> Column:
    """A firm's name without words of its legal form; the name as it is where nothing else is in it."""
    short = collapse(F.regexp_replace(company, rf"(?i){word(FIRM_ENDS)}\.?", ""))
    return F.when(short != "", short).otherwise(company)


def term_count(text: Column, term: str) -> Column:
    """How often a term stands in a text as a word, marks such as # + . being parts of words before it and # + after
    it: C# and .NET are words, C is none in C#. Case is ignored."""
    literal = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(?<![A-Za-z0-9_#+.]){literal}(?![A-Za-z0-9_#+])"))


def title_candidates(title: Column) -> Column:
    """A title without brackets, then its clauses that have three letters in a row; each once."""
    clean = collapse(F.regexp_replace(F.coalesce(title, F.lit("")), BRACKETS, " "))
    clauses = F.transform(F.split(clean, r" [-–—|] |[,/:;|]"), lambda c: F.trim(c))
    return F.array_distinct(F.concat(F.array(clean), F.filter(clauses, lambda c: c.rlike("(?i)[a-z]{3}"))))


def mentions_title(text: Column, title: Column) -> Column:
    """Whether a text names a title or one of its clauses, case ignored."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(title_candidates(title), lambda c: F.contains(low, F.lower(c)))


def verb_of(token: Column) -> Column:
    """The verb that a lower-case token is a form of: an irregular one, else the first of the token and what its
    endings may stand for that is a verb; null for other words."""
    odd = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    cut = lambda pattern, to="": F.regexp_replace(token, pattern, to)
    forms = (F.try_element_at(odd, token), token, cut("(?:ies|ied)$", "y"), cut("(?:ing|ed|es|s)$"), cut("[ds]$"), cut(r"(.)\1(?:ing|ed)$", "$1"), cut("ing$", "e"))
    return F.coalesce(*(F.when(f.isin(*VERBS), f) for f in forms))


def verb_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z-]*"), F.lit(0))


def distinct_numbers(text: Column) -> Column:
    return F.size(F.array_distinct(numbers_in(F.coalesce(text, F.lit("")))))
