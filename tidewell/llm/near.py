"""Near-duplicate texts: pigeonhole blocks over fingerprints of word shingles, Hamming check, exact check.

A fingerprint holds SYMBOLS minimum hashes of a text's shingles; the share of equal symbols estimates the
Jaccard similarity. It is split into blocks of BLOCK symbols: two fingerprints that differ in fewer symbols
than there are blocks surely share one, and at a similarity of 0.6 the odds of sharing none are 2 %, at 0.65
0.2 %. Pairs that share a block are verified by the Hamming distance of their sketches (one bit of each of the
first SKETCH symbols), and last exactly by their words.

The sketches join the pairs met, not the blocks: 80 blocks a text carry 11 bytes each through the shuffle, and would
carry 43 with a sketch, while only some three distinct pairs a text are met.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.leaks import codes_of, words_of
from tidewell.llm.tokens import _strings
from tidewell.session import staged

SYMBOLS, BLOCK = 480, 6
BLOCKS = SYMBOLS // BLOCK
#: Bits of a sketch, and how many of them may differ in a pair: at a similarity of 0.6, 51.2 are expected with a
#: deviation of 6.4.
SKETCH, HAMMING = 256, 78
#: Columns of 64 bits that hold a sketch.
HALVES = [f"s{i}" for i in range(SKETCH // 64)]

_random = np.random.RandomState(20260101)
_A = _random.randint(0, 1 << 31, SYMBOLS).astype(np.uint32) * 2 + 1
_B = _random.randint(0, 1 << 31, SYMBOLS).astype(np.uint32)
#: Shingles hashed in one go; bounds a worker's memory on very long texts.
SPAN = 4096
#: Fingerprints cut into blocks in one go.
TOGETHER = 512

def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """32-bit hashes of the runs of `size` words; of all words if there are fewer."""
    codes = codes_of(words)
    size = min(size, len(codes))
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def symbols(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the shingles, SPAN shingles at a time."""
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), SPAN):
        hashed = shingles[at : at + SPAN, None] * _A
        hashed += _B
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def prints_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block hashes (int32) and the sketch (int64 columns) of fingerprints, a row for each."""
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    blocks = np.zeros((len(mixed), BLOCKS), np.uint32)
    for j in range(BLOCK):
        blocks = (blocks ^ mixed[:, j::BLOCK]) * np.uint32(0xC2B2AE35)
        blocks ^= blocks >> np.uint32(13)
    bits = np.packbits(((mixed[:, :SKETCH] >> np.uint32(9)) & np.uint32(1)).astype(np.uint8), axis=1)
    return blocks.view(np.int32), np.ascontiguousarray(bits).view(np.int64)


def fingerprints(texts: DataFrame, size: int, least_words: int) -> DataFrame:
    """texts: id, lead, body. (id, c1, c2, HALVES, blocks) of rows whose body has least_words words; c1 and c2
    are a 128-bit hash of the words of lead and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            c1, c2, least, parts = [], [], [], []
            for i, (lead, body) in enumerate(zip(_strings(batch.column(1)), _strings(batch.column(2)))):
                words = words_of(body)
                if len(words) < least_words:
                    continue
                words = words_of(lead) + words
                digest = xxhash.xxh3_128_digest(" ".join(words))
                rows.append(i)
                c1.append(int.from_bytes(digest[:8], "big", signed=True))
                c2.append(int.from_bytes(digest[8:], "big", signed=True))
                least.append(symbols(shingle_hashes(words, size)))
                if len(least) == TOGETHER:
                    parts.append(prints_of(np.array(least)))
                    least = []
            parts.append(prints_of(np.array(least, np.uint32).reshape(-1, SYMBOLS)))
            blocks, sketch = (np.concatenate(x) for x in zip(*parts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BLOCKS), pa.array(blocks.ravel()))
            longs = [pa.array(v, pa.int64()) for v in (c1, c2, *sketch.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *longs, lists], names=["id", "c1", "c2", *HALVES, "blocks"])

    ready = texts.select(F.col("id").cast("long"), F.coalesce("lead", F.lit("")).alias("lead"), "body").filter(F.col("id").isNotNull() & (F.length("body") >= 2 * least_words - 1))
    return ready.mapInArrow(run, f"id long, c1 long, c2 long, {', '.join(f'{h} long' for h in HALVES)}, blocks array<int>")


def _exact(pairs: DataFrame, size: int, least: float) -> DataFrame:
    def shingles(text: str) -> set[tuple[str, ...]]:
        words = words_of(text)
        n = min(size, len(words))
        return set(zip(*(words[j:] for j in range(n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _strings(batch.column(2)), _strings(batch.column(3))
            found = []
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = shingles(x), shingles(y)
                both = len(p & q)
                if both and both >= least * (len(p) + len(q) - both):
                    found.append((i, both / (len(p) + len(q) - both)))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([f[1] for f in found], pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(texts: DataFrame, size: int = 5, least: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts whose sets of `size`-word shingles of lead + ' ' + body have a Jaccard similarity of at
    least `least`, given by representatives of equal texts, and the membership.

    texts: id (bigint, unique; null ids are left out), lead, body (strings). Returns (pairs: a < b,
    similarity; members: id, rep): rep is the lowest id with the same words. Texts whose body has fewer than
    least_words words (null and empty ones too) are no members. Equal texts are members of one rep and give
    no pair here.
    """
    prints = staged(fingerprints(texts, size, least_words), "fingerprints")
    grouped = prints.groupBy("c1", "c2")
    reps = grouped.agg(F.min(F.struct("id", "blocks")).alias("r")).select("r.id", "r.blocks")
    keys = reps.select("id", F.posexplode("blocks").alias("no", "h")).select("id", (F.shiftleft(F.col("no").cast("long"), 32).bitwiseXOR(F.col("h").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("key"))
    left, right = keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b")
    met = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    sketch = lambda x: prints.select(F.col("id").alias(x), *(F.col(h).alias(x + h) for h in HALVES))
    apart = functools.reduce(operator.add, (F.bit_count(F.col("a" + h).bitwiseXOR(F.col("b" + h))) for h in HALVES))
    close = staged(met.join(sketch("a"), "a").join(sketch("b"), "b").filter(apart <= HAMMING).select("a", "b"), "close-pairs")
    needed = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    long = texts.filter(F.length("body") >= 2 * least_words - 1)  # as for fingerprints: no others can be needed
    words = long.select(F.col("id").cast("long").alias("id"), F.concat_ws(" ", F.coalesce("lead", F.lit("")), "body").alias("text")).join(needed, "id", "left_semi")
    wanted = staged(words, "close-texts")
    full = close.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    least_ids = grouped.agg(F.min("id").alias("rep"))
    return _exact(full, size, least), prints.select("id", "c1", "c2").join(least_ids, ["c1", "c2"]).select("id", "rep")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of rows, copies written out."""
    of = lambda x: members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(x))
    across = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("id_a", "id_b")
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep")
    equal = members.join(copies, "rep", "left_semi")
    within = equal.select(F.col("id").alias("id_a"), "rep").join(equal.select(F.col("id").alias("id_b"), "rep"), "rep").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
