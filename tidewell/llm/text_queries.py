"""Queries over documents: p8 (token ids), p9 (leaked test items), p10 (reading level)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.leaks import SEED, find_leaks
from tidewell.llm.reading import reading_levels
from tidewell.llm.tokens import encode_corpus
from tidewell.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the documents it leaked into, and the most of it that one of them covers."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    by_item = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("coverage").alias("most_covered"))
    items = table(spark, d, "eval_items").select("item_id").join(by_item, "item_id", "left")
    return items.select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_covered", F.lit(0.0)).alias("most_covered"))


#: Share of an item's words that a document's tiles must cover to count as taken from it, in whatever order.
COVERED = 0.5


def p9_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose tiles cover half of an item though no run of 13 words is shared: passages cut up and reordered."""
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), longest=SEED, coverage=COVERED)
    return found.filter("longest < 13").select("doc_id", "item_id", "longest", "covered", "tiles")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


QUERIES = {"p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p9_reordered": p9_reordered, "p10_found": p10_found}

SQL = {
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(array_to_string(w[k:k + 12], ' ')))) AS g FROM d WHERE len(w) >= 13),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: hash(array_to_string(w[k:k + 12], ' ')))) AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
