"""Captured pages of boards to raw postings: JSON result pages, HTML cards, detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.postings import apply_method
from tidewell.functions.text import collapse, strip_html
from tidewell.sources.html import cards_of, embedded_description_of, marked_div_of, posting_ld_of

RAW_COLUMNS = ("source_id", "url", "title", "company", "location_raw", "salary_raw", "posted_at_raw", "employment_type_raw", "teaser", "category", "remote_hint", "raw")


def pick(json: Column | str, *paths: str) -> Column:
    """The first of several JSON paths that holds a text or number that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths))


def _kind(json: Column | str, path: str) -> tuple[Column, Column]:
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return value, F.schema_of_variant(value)


def as_text(json: Column | str, path: str) -> Column:
    """Trimmed text at a path; numbers and booleans as text; '' for lists, objects, null, and where nothing is."""
    value, kind = _kind(json, path)
    return F.when(F.coalesce(kind, F.lit("VOID")).rlike("^(VOID|ARRAY|OBJECT)"), "").otherwise(F.coalesce(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))


def as_bool(json: Column | str, path: str) -> Column:
    """A boolean, or a text true, yes or 1 in any case; false for all else."""
    value, kind = _kind(json, path)
    said = F.try_variant_get(value, "$", "string")
    return F.coalesce(F.when(kind == "BOOLEAN", said == "true").when(kind == "STRING", said.rlike("(?i)^(true|yes|1)$")), F.lit(False))


def search_url(base: str, parameters: dict[str, Column]) -> Column:
    """base?name=value&..., blank values left out."""
    parts = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in parameters.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def json_postings(pages: DataFrame, page_size: int = 22, max_pages: int | None = None) -> DataFrame:
    """pages: search, page, body (JSON with data[] and totalCount). Postings of the pages that a reader would
    have asked for: up to the first that is empty, short or completes the total; rows without id or title
    dropped. (search, page, row, RAW_COLUMNS)."""
    rows = F.from_json(F.get_json_object("body", "$.data"), "array<string>")
    sized = pages.select("search", "page", F.coalesce(rows, F.array().cast("array<string>")).alias("rows"), F.get_json_object("body", "$.totalCount").cast("long").alias("total"))
    if max_pages is not None:
        sized = sized.filter(F.col("page") <= max_pages)
    w = Window.partitionBy("search").orderBy("page")
    emitted = F.sum(F.size("rows")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = sized.withColumn("last", ((F.size("rows") < page_size) | (emitted >= F.coalesce("total", F.lit(2**62)))).cast("int"))
    asked = ends.withColumn("ended", F.coalesce(F.sum("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("ended = 0")
    item = asked.select("search", "page", F.posexplode("rows").alias("row", "j"))
    remote = F.coalesce(pick("j", "$.isRemote") == "true", F.lit(False)) | F.coalesce(F.lower(F.get_json_object("j", "$.workArrangements")), F.lit("")).rlike("remote|work from home|hybrid")
    bullets = F.from_json(F.get_json_object("j", "$.bulletPoints"), "array<string>")
    return item.select(
        "search", "page", "row", pick("j", "$.id", "$.solMetadata.jobId").alias("source_id"), pick("j", "$.jobUrl", "$.url").alias("url"), pick("j", "$.title", "$.jobTitle").alias("title"),
        F.coalesce(pick("j", "$.companyName", "$.advertiser.description", "$.employer.name"), F.lit("Unknown")).alias("company"),
        F.coalesce(pick("j", "$.locations[0].label", "$.location", "$.area"), F.lit("")).alias("location_raw"), pick("j", "$.salaryLabel", "$.salary").alias("salary_raw"),
        pick("j", "$.listingDate", "$.listingDateDisplay").alias("posted_at_raw"), pick("j", "$.workTypes[0]", "$.workType").alias("employment_type_raw"),
        F.nullif(F.concat_ws(" · ", pick("j", "$.teaser"), F.array_join(bullets, " · ")), F.lit("")).alias("teaser"),
        pick("j", "$.classifications[0].classification.description", "$.classification.description").alias("category"), remote.alias("remote_hint"), F.col("j").alias("raw"),
    ).filter("source_id is not null and title is not null")


def tag_text(html: Column | str, tag: str, hint: str) -> Column:
    """Text of the first element of a tag whose class names the hint."""
    inner = F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*class="[^"]*{hint}[^"]*"[^>]*>(.*?)</{tag}>', 1)
    return F.nullif(collapse(strip_html(inner)), F.lit(""))


def card_postings(pages: DataFrame, page_size: int = 25) -> DataFrame:
    """pages: search, start, html. Postings of result cards: (search, start, row, RAW_COLUMNS). Pages after
    the first with fewer cards than page_size are not read; cards without number or title are dropped."""
    split = pages.select("search", "start", cards_of("html").alias("cards"))
    w = Window.partitionBy("search").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    asked = split.withColumn("ended", F.coalesce(F.sum((F.size("cards") < page_size).cast("int")).over(w), F.lit(0))).filter("ended = 0")
    card = asked.select("search", "start", F.posexplode("cards").alias("row", "c"))
    link = F.regexp_extract("c", r'(?i)href="([^"]+)"', 1)
    number = F.coalesce(F.nullif(F.regexp_extract("c", r'data-entity-urn="[^"]*:(\d+)"', 1), F.lit("")), F.nullif(F.regexp_extract(F.regexp_replace(link, r"[?#].*$", ""), r"(\d+)/?$", 1), F.lit("")))
    place, pay, kind = (tag_text("c", "span", f"job-search-card__{x}") for x in ("location", "salary-info", "workplace-type"))
    dated = F.coalesce(F.nullif(F.regexp_extract("c", r'(?i)<time\b[^>]*datetime="([^"]+)"', 1), F.lit("")), tag_text("c", "time", "listdate"))
    return card.select(
        "search", "start", "row", number.alias("source_id"), F.nullif(F.regexp_replace(link, r"\?.*$", ""), F.lit("")).alias("url"), tag_text("c", "h3", "title").alias("title"),
        F.coalesce(tag_text("c", "h4", "subtitle"), F.lit("Unknown")).alias("company"), F.coalesce(place, F.lit("")).alias("location_raw"), pay.alias("salary_raw"), dated.alias("posted_at_raw"),
        F.lit(None).cast("string").alias("employment_type_raw"), F.lit(None).cast("string").alias("teaser"), F.lit(None).cast("string").alias("category"),
        F.lower(F.concat_ws(" ", place, kind)).rlike("remote|hybrid").alias("remote_hint"), F.col("c").alias("raw"),
    ).filter("source_id is not null and title is not null")


def criteria(html: Column | str) -> Column:
    """map<label, value> of a detail page's list of criteria."""
    names = F.regexp_extract_all(html, F.lit(r"(?is)<h3[^>]*criteria[^>]*>(.*?)</h3>\s*<span[^>]*>(.*?)</span>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?is)<h3[^>]*criteria[^>]*>(.*?)</h3>\s*<span[^>]*>(.*?)</span>"), F.lit(2))
    return F.map_from_arrays(F.transform(names, lambda x: F.lower(collapse(strip_html(x)))), F.transform(values, lambda x: collapse(strip_html(x))))


#: What marks the text of an advertisement on a detail page.
MARKERS = ('data-automation="jobAdDetails"', "show-more-less-html__markup")


def detail_fields(pages: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """pages: url, source_id, status, html. (url, description, employment_type_raw, posted_at_raw,
    apply_method) of pages that were read; the advertisement's own text first, then JSON-LD, then embedded
    data; the kind of employment from JSON-LD, else from the list of criteria. Pages with an error status give nulls: rows keep what their card said."""
    good = F.when(F.col("status") == 200, F.col("html"))
    read = pages.select("url", "source_id", good.alias("html")).withColumn("ld", posting_ld_of("html"))
    body = F.coalesce(*(marked_div_of("html", F.lit(m)) for m in markers), F.get_json_object("ld", "$.description"), embedded_description_of("html", "source_id"))
    kind = F.try_element_at(criteria("html"), F.lit("employment type"))
    return read.select(
        "url", strip_html(body).alias("description"), F.coalesce(F.get_json_object("ld", "$.employmentType"), F.nullif(kind, F.lit(""))).alias("employment_type_raw"),
        F.get_json_object("ld", "$.datePosted").alias("posted_at_raw"), apply_method(F.col("html")).alias("apply_method"),
    )


def enriched(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows with their detail page's fields where they lack them; a row without a page stays as it is."""
    d = details.groupBy("url").agg(F.first(F.struct(*(c for c in details.columns if c != "url"))).alias("d"))
    filled = [F.coalesce(c, F.col(f"d.{c}")).alias(c) if c in details.columns and c != "url" else F.col(c) for c in rows.columns]
    return rows.join(d, "url", "left").select(*filled)


def read_pages(spark: SparkSession, path: str, schema: str = "search string, page int, body string") -> DataFrame:
    """Captured pages as lines of JSON; the schema is given, lines that do not fit it fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
