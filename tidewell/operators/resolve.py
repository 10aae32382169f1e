"""Which stored posting an incoming one is: by id, by fingerprint, by similar title at the same firm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.postings import fingerprint, make_id, normal_company, title_tokens
from tidewell.functions.text import jaccard
from tidewell.session import discard, staged


def keyed(rows: DataFrame, seq: str, source: str, source_id: str, title: str, company: str, city: Column) -> DataFrame:
    """(seq, source, id, fp, company_key, tokens) of postings; seq is the order of arrival."""
    return rows.select(
        F.col(seq).alias("seq"), F.col(source).alias("source"), make_id(F.col(source), F.col(source_id)).alias("id"),
        fingerprint(F.col(title), F.col(company), city).alias("fp"), normal_company(F.col(company)).alias("company_key"), F.array_sort(title_tokens(F.col(title))).alias("tokens"),
    )


def first_by(rows: DataFrame, key: str) -> DataFrame:
    """First arrival of each key, all columns; a total order by seq makes it one row."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), "seq").alias("_r")).select(key, "_r.*")


def match_by(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(seq, match_seq): each incoming row with the first stored row of the same key, null where none is."""
    first = stored.groupBy(key).agg(F.min("seq").alias("match_seq"))
    return incoming.select("seq", key).join(first, key, "left").select("seq", "match_seq")


def _prefix(tokens: Column, least: float) -> Column:
    """The tokens of which two sets of Jaccard >= least share at least one, in one common order of tokens."""
    return F.slice(tokens, 1, (F.size(tokens) - F.ceil(F.lit(least) * F.size(tokens)) + 1).cast("int"))


def similar_titles(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(fa, fb, similarity) of distinct forms (company_key, tokens) of rows: firms equal, token sets at least
    so similar, fa < fb by hash. Forms meet by firm and a prefix token, so a large firm's postings are not
    all paired."""
    forms = rows.filter(F.size("tokens") > 0).select("company_key", "tokens").distinct().withColumn("form", F.xxhash64("company_key", "tokens"))
    spread = forms.select("form", "company_key", "tokens", F.explode(_prefix(F.col("tokens"), least)).alias("t"))
    a, b = spread.alias("a"), spread.alias("b")
    met = a.join(b, (F.col("a.company_key") == F.col("b.company_key")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.form") < F.col("b.form")))
    sim = jaccard(F.col("a.tokens"), F.col("b.tokens"))
    return met.select(F.col("a.form").alias("fa"), F.col("b.form").alias("fb"), sim.alias("similarity")).filter(F.col("similarity") >= least).distinct()


def match_fuzzy_first(incoming: DataFrame, stored: DataFrame, least: float = 0.8) -> DataFrame:
    """(seq, match_seq): each incoming row with the first stored row of another source that has the same
    firm and a title at least so similar. Stored rows are reduced to the first of each form and source."""
    form = F.xxhash64("company_key", "tokens").alias("form")
    firsts = stored.filter(F.size("tokens") > 0).groupBy(form, F.col("source").alias("s2")).agg(F.min("seq").alias("match_seq"))
    pairs = similar_titles(incoming.select("company_key", "tokens").unionByName(stored.select("company_key", "tokens")), least)
    reach = pairs.select(F.col("fa").alias("form"), F.col("fb").alias("to")).unionByName(pairs.select(F.col("fb").alias("form"), F.col("fa").alias("to")))
    asked = incoming.filter(F.size("tokens") > 0).select("seq", "source", form)
    same = asked.select("seq", "source", F.col("form").alias("to"))
    near = asked.join(reach, "form").select("seq", "source", "to")
    hits = same.unionByName(near).join(firsts.withColumnRenamed("form", "to"), "to").filter("source <> s2").groupBy("seq").agg(F.min("match_seq").alias("match_seq"))
    return incoming.select("seq").join(hits, "seq", "left")


def _first_independent(edges: DataFrame) -> DataFrame:
    """edges: x, y, where y comes before x. (x): the nodes that are not taken when nodes are gone through in order
    and each is taken unless an edge leads to one taken before. Rounds: what has no edge left is taken, and what
    has an edge to it is not; both leave the graph."""
    left, refused = staged(edges.distinct(), "conflicts"), []
    while not left.isEmpty():
        waiting = left.select(F.col("x").alias("y")).distinct()
        out = staged(left.join(waiting, "y", "left_anti").select("x").distinct(), "refused")
        refused.append(out)
        rest = staged(left.join(out, "x", "left_anti").join(out.select(F.col("x").alias("y")), "y", "left_anti").select("x", "y"), "conflicts")
        discard(left)
        left = rest
    found = edges.select("x").limit(0)
    for out in refused:
        found = found.unionByName(out)
    return found


def resolve_in_order(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(seq, leader, status): the posting each row becomes part of when rows are taken in one by one.

    Per row: a known id is 'updated'; a known fingerprint of a leader, else a similar title of another source
    at the same firm (first leader in order), is 'merged'; else it is 'new' and a leader. Ids of merged rows
    are known from then on; the fingerprint of a row merged by similarity is not.

    Only sets are worked on. A fingerprint holds firm and title, so rows of one form (firm, title words) and
    source differ in fingerprint only, and the first of them leads unless an earlier leader of another source
    has a similar form: leaders are the first independent set of (form, source) in order of arrival. All other
    rows follow from the first leader around their form and the first leader of their fingerprint.
    """
    first = first_by(rows, "id").withColumn("form", F.when(F.size("tokens") > 0, F.xxhash64("company_key", "tokens")))
    first = staged(first.select("id", "seq", "source", "fp", "company_key", "tokens", "form"), "resolve-firsts")
    nodes = staged(first.filter("form is not null").groupBy("form", "source").agg(F.min("seq").alias("at")), "forms")
    pairs = similar_titles(first, least)
    reach = staged(
        pairs.select("fa", "fb").unionByName(pairs.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"))).unionByName(nodes.select(F.col("form").alias("fa"), F.col("form").alias("fb")).distinct()), "alike"
    )
    mine = nodes.select(F.col("form").alias("fa"), F.col("source").alias("s"), F.col("at").alias("x"))
    edges = mine.join(reach, "fa").join(nodes.select(F.col("form").alias("fb"), F.col("source").alias("t"), F.col("at").alias("y")), "fb").filter("s <> t and y < x").select("x", "y")
    refused = _first_independent(staged(edges, "conflicts"))
    leads = nodes.join(refused.select(F.col("x").alias("at")), "at", "left_anti")
    around = mine.join(reach, "fa").join(leads.select(F.col("form").alias("fb"), F.col("source").alias("t"), F.col("at").alias("y")), "fb").filter("s <> t").groupBy("fa", "s").agg(F.min("y").alias("near"))
    told = staged(
        first.select("id", "seq", "source", "fp", "form").join(around.select(F.col("fa").alias("form"), F.col("s").alias("source"), "near"), ["form", "source"], "left")
        .join(leads.select("form", "source", F.lit(True).alias("leads")), ["form", "source"], "left"), "resolve-told"
    )
    own = F.col("form").isNull() | (F.col("leads") & (F.col("near").isNull() | (F.col("seq") < F.col("near"))))
    by_fp = told.filter(own).groupBy("fp").agg(F.min("seq").alias("lead_fp"))
    lead = F.when(F.col("lead_fp") <= F.col("seq"), F.col("lead_fp")).otherwise(F.col("near"))
    ids = told.join(by_fp, "fp", "left").select("id", F.col("seq").alias("first_seq"), lead.alias("leader"))
    status = F.when(F.col("seq") != F.col("first_seq"), "updated").when(F.col("leader") == F.col("seq"), "new").otherwise("merged")
    return rows.select("seq", "id").join(ids, "id").select("seq", "leader", status.alias("status"))
