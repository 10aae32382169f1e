"""Sentences and numbers of texts against a corpus or against facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import content_words, normal_sentence, numbers_in, sentences, trigrams
from tidewell.session import staged


def sentence_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, sentence, norm) of every sentence of every text."""
    split = texts.select(key, F.posexplode(sentences(F.col(text))).alias("at", "sentence"))
    return split.withColumn("norm", normal_sentence(F.col("sentence")))


def reused_sentences(texts: DataFrame, corpus: DataFrame, key: str, corpus_key: str, text: str = "text", least_words: int = 9) -> DataFrame:
    """(key, norm, n_sources): sentences of at least so many words that stand in the corpus too."""
    mine = sentence_rows(texts, key, text).filter(F.size(F.split("norm", " ")) >= least_words).select(key, "norm").distinct()
    theirs = sentence_rows(corpus, corpus_key, text).groupBy("norm").agg(F.count_distinct(corpus_key).alias("n_sources"))
    return mine.join(theirs, "norm").select(key, "norm", "n_sources")


def _trigram_sets(sentences: DataFrame) -> DataFrame:
    """(norm, g, n): distinct sentences with the set of their trigrams' hashes; trigrams are built once a sentence."""
    return sentences.select("norm").distinct().select("norm", F.transform(trigrams(F.col("norm")), lambda t: F.xxhash64(t)).alias("g")).withColumn("n", F.size("g"))


def similar_sentences(texts: DataFrame, corpus: DataFrame, key: str, corpus_key: str, text: str = "text", least: float = 0.5, least_words: int = 10) -> DataFrame:
    """(key, corpus_key, norm, corpus_norm, similarity): sentences of at least so many words whose trigram
    sets are at least so similar. Distinct sentences meet through a prefix of the corpus sentence: a set with
    Jaccard >= least to it holds one of any n - ceil(least * n) + 1 of its n trigrams, the rarest in the corpus
    here, and is neither smaller than least times its size nor larger than its size over least. Trigrams go by
    64-bit hashes."""
    long = lambda rows: rows.filter(F.size(F.split("norm", " ")) >= least_words)
    mine, theirs = (staged(long(sentence_rows(rows, k, text)).select(k, "norm").distinct(), "sentences") for rows, k in ((texts, key), (corpus, corpus_key)))
    a, b = staged(_trigram_sets(mine), "trigrams"), staged(_trigram_sets(theirs), "trigrams")
    counts = b.select(F.explode("g").alias("t")).groupBy("t").count()
    ranked = b.select("norm", "n", F.explode("g").alias("t")).join(counts, "t").groupBy("norm", "n").agg(F.array_sort(F.collect_list(F.struct("count", "t"))).alias("ts"))
    prefix = ranked.select(F.col("norm").alias("corpus_norm"), F.col("n").alias("m"), F.explode(F.slice(F.col("ts.t"), 1, (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))).alias("t"))
    sized = (F.col("n") >= F.col("m") * least) & (F.col("m") >= F.col("n") * least)
    met = a.select("norm", "n", F.explode("g").alias("t")).join(prefix, "t").filter(sized).select("norm", "corpus_norm").distinct()
    sets = met.join(a.select("norm", F.col("g").alias("x")), "norm").join(b.select(F.col("norm").alias("corpus_norm"), F.col("g").alias("y")), "corpus_norm")
    both = sets.select("norm", "corpus_norm", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("both"))
    scored = both.withColumn("similarity", F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).filter(F.col("similarity") >= least).select("norm", "corpus_norm", "similarity")
    return (
        mine.join(scored, "norm").join(theirs.select(corpus_key, F.col("norm").alias("corpus_norm")), "corpus_norm").select(key, corpus_key, "norm", "corpus_norm", "similarity")
    )


def shared_openers(texts: DataFrame, key: str, text: str = "text", words: int = 5) -> DataFrame:
    """(opener, n): first words of texts with which more than one text begins."""
    opener = F.array_join(F.slice(F.split(normal_sentence(F.col(text)), " "), 1, words), " ")
    return texts.select(key, opener.alias("opener")).filter(F.size(F.split("opener", " ")) == words).groupBy("opener").agg(F.count_distinct(key).alias("n")).filter("n > 1")


def unfounded_numbers(texts: DataFrame, facts: DataFrame, key: str, text: str = "text", fact: str = "fact", span: int = 6) -> DataFrame:
    """(key, number) of numbers that no fact has, or only facts without a content word in common with what
    stands within `span` words of the number."""
    tokens = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    spots = texts.select(key, F.posexplode(tokens).alias("at", "tok"), tokens.alias("ts")).filter(F.col("tok").rlike(r"\d"))
    around = F.array_join(F.slice("ts", F.greatest(F.col("at") - span + 1, F.lit(1)), 2 * span + 1), " ")
    said = spots.select(key, "at", F.explode(numbers_in(F.col("tok"))).alias("number"), content_words(around).alias("near"))
    given = facts.select(F.explode(F.array_distinct(numbers_in(F.col(fact)))).alias("number"), content_words(F.col(fact)).alias("about"))
    backed = said.join(given, "number").filter(F.arrays_overlap("near", "about")).select(key, "at", "number").distinct()
    return said.join(backed, [key, "at", "number"], "left_anti").select(key, "number").distinct()
