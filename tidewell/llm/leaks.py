"""Test passages inside corpus documents, by greedy string tiling over joined seeds.

Windows of SEED words that a document and an item share are the seeds, found by running Karp-Rabin hashes. Documents
pass a bitmap of the items' hashes, which has one size however many items there are; what passes is joined with
the items' seeds by hash. Each pair that met is tiled: the longest matches that do not overlap are marked, longest
first, so that the first tile is the longest passage both have, and passages whose parts were put in another order
are told by how much of the item all tiles cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tokens import _strings
from tidewell.session import staged

WORD = re.compile(r"[a-z0-9]+")
#: Words of a seed, and of the shortest tile.
SEED = 5
#: Bits of the map of item seeds that goes to every executor.
BITS = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_codes: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def code_of(word: str) -> int:
    """64 bits of a word, kept for words seen before."""
    code = _codes.get(word)
    if code is None:
        if len(_codes) > 500_000:
            _codes.clear()
        code = _codes[word] = xxhash.xxh3_64_intdigest(word)
    return code


def codes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(code_of, words), np.uint64, len(words))


def running_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, mod 2^64, of all windows of `width` codes."""
    out = np.zeros(max(len(codes) - width + 1, 0), np.uint64)
    for j in range(width):
        out = out * _BASE + codes[j : j + len(out)]
    return out ^ (out >> np.uint64(31))


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (doc start, item start, length) of the longest common runs of unmarked words, longest
    first (ties: earliest in the document), none shorter than least, no word used twice."""
    free_doc, free_item, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    while True:
        best = (0, 0, 0)
        reached: dict[int, int] = {}  # diagonal -> end of the last run, which its inner seeds only repeat
        for i, j in sorted(seeds):
            if i < reached.get(i - j, -1):
                continue
            n = min(len(doc) - i, len(item) - j)
            same = (doc[i : i + n] == item[j : j + n]) & free_doc[i : i + n] & free_item[j : j + n]
            length = n if same.all() else int(np.argmin(same))
            back = 0
            while i - back and j - back and doc[i - back - 1] == item[j - back - 1] and free_doc[i - back - 1] and free_item[j - back - 1] and length:
                back += 1
            reached[i - j] = i + length
            if length + back > best[2]:
                best = (i - back, j - back, length + back)
        if best[2] < least:
            return out
        out.append(best)
        i, j, n = best
        free_doc[i : i + n] = False
        free_item[j : j + n] = False
        seeds = [(a, b) for a, b in seeds if free_doc[a] and free_item[b]]


def tiled(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles of two lists of word codes, from all the windows they share."""
    at: dict[int, list[int]] = {}
    for j, h in enumerate(running_hashes(item, least).tolist()):
        at.setdefault(h, []).append(j)
    seeds = [(i, j) for i, h in enumerate(running_hashes(doc, least).tolist()) for j in at.get(h, ())]
    return tiles(doc, item, seeds, least) if seeds else []


def seed_map(seeds: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits of the hashes h of seeds: brought together as maps, never as seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for row in seeds.select("h").coalesce(64).mapInArrow(run, "bits binary").toLocalIterator():  # one map at a time
        out |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def in_stretches(passes: np.ndarray, least: int) -> np.ndarray:
    """Which of a row of marks stand in a stretch of at least so many marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], passes.view(np.int8), [0]])))
    lengths = edges[1::2] - edges[::2]
    out = passes.copy()
    for start, n in zip(edges[::2][lengths < least], lengths[lengths < least]):
        out[start : start + n] = False
    return out


def _with_hashes(rows: DataFrame, width: int, bits=None, in_a_row: int = 1) -> DataFrame:
    """rows: n, key, text. (n, key, text, size: words, hashes, times): distinct hashes of the windows of each text with the
    number of their places; only those that the map `bits` has, where it is given, at so many places in a row.
    Texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits.value
        for batch in batches:
            lists = [words_of(t) for t in _strings(batch.column(2))]
            ends = np.cumsum([0, *map(len, lists)])
            hashes = running_hashes(codes_of([w for words in lists for w in words]), width)
            start = np.arange(len(hashes))
            row = np.searchsorted(ends, start, "right") - 1
            inside = start + width <= ends[row + 1] if len(hashes) else np.zeros(0, bool)
            if known is not None:  # the last windows of a text reach into the next one, so no stretch does
                inside = in_stretches(inside & known[hashes % np.uint64(BITS)], in_a_row)
            both, times = np.unique(np.stack([row[inside].astype(np.int64), hashes[inside].view(np.int64)], 1), axis=0, return_counts=True)
            kept, sizes = np.unique(both[:, 0], return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x))) for x in (both[:, 1], times.astype(np.int32))]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(np.diff(ends)[kept].astype(np.int32)), *lists], names=["n", "key", "text", "size", "hashes", "times"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"n long, key {kind}, text string, size int, hashes array<long>, times array<int>")


def find_leaks(
    documents: DataFrame, items: DataFrame, longest: int = 13, coverage: float = 0.0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = SEED
) -> DataFrame:
    """(key, item_key, longest, covered, tiles, coverage) of documents and items that share a run of `longest` words or
    more, and whose tiles of at least `seed` words cover at least the share `coverage` of the item's words. With
    `longest` = `seed`, coverage alone decides: passages cut up and put in another order are found too.

    One row for each document row and item: a document row given twice is found twice. Null and empty texts, items
    with fewer words than `seed` and null item keys find nothing. seed must not be above longest.
    """
    spark = documents.sparkSession
    numbered = lambda rows, k, t: rows.select(F.monotonically_increasing_id().alias("n"), F.col(k).alias("key"), F.col(t).cast("string").alias("text")).filter(F.length("text") >= 2 * seed - 1)
    asked = staged(_with_hashes(numbered(items.filter(F.col(item_key).isNotNull()), item_key, item_text), seed), "item-seeds")
    item_seeds = asked.select(F.col("n").alias("m"), "size", F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("times").alias("t"))).alias("s")).select("m", "size", "s.h", "s.t")
    bits = spark.sparkContext.broadcast(seed_map(item_seeds))
    hit = staged(_with_hashes(numbered(documents, key, text), seed, bits, longest - seed + 1), "seeded-texts")
    # What is asked for needs seeds at so many places of the item: a run has one for each of its words but the last
    # few, and tiles cover at most `seed` words for each.
    places = F.greatest(F.lit(longest - seed + 1), F.ceil(F.lit(coverage) * F.col("size") / seed))
    met = hit.select("n", F.explode("hashes").alias("h")).join(item_seeds, "h").groupBy("n", "m", "size").agg(F.sum("t").alias("at")).filter(F.col("at") >= places).select("n", "m")
    pairs = met.join(hit.select("n", "key", "text"), "n").join(asked.select(F.col("n").alias("m"), F.col("key").alias("item"), F.col("text").alias("passage")), "m").select("key", "item", "text", "passage")
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (t, p) in enumerate(zip(_strings(batch.column(2)), _strings(batch.column(3)))):
                passage = codes_of(words_of(p))
                found = tiled(codes_of(words_of(t)), passage, seed)
                covered = sum(x[2] for x in found)
                if found and found[0][2] >= longest and covered >= coverage * len(passage):
                    out.append((i, found[0][2], covered, len(found), covered / len(passage)))
            at, *numbers = ([r[c] for r in out] for c in range(5))
            rows = pa.array(at, pa.int64())
            values = [pa.array(v, t) for v, t in zip(numbers, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *values], names=[key, item_key, "longest", "covered", "tiles", "coverage"])

    return pairs.mapInArrow(run, f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, longest int, covered int, tiles int, coverage double")
