"""New deliveries of postings against all that was accepted before, without going through the history again.

What is kept, at a path of its own: a store of fingerprints, partitioned by their hash, with what they stand for;
partitioned Bloom filters of them; the spellings of titles, companies and places, and the counts of words, known so
far. Every row of a delivery comes in by its posting's fingerprint (board and number), and the first row of a
posting not known by the fingerprints of its content too. The filters are asked first; only what may have been
seen is looked up, in those partitions of the store that hold it, and verified field by field. Then store and
filters take in the delivery as one new version, which counts once it is written whole.

Contents have about five words, of which winnowed runs lose most pairs that differ in one word. So a content has one
fingerprint of all its words, and asks for those of every spelling near its own: whatever the check accepts shares
one. Equal contents of one slot of time share one entry, so that the store never pairs copies with copies.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.matching import DAY
from tidewell.llm.vacancies import same_place, spellings_of, vacancy_fields, word_counts
from tidewell.operators.connect import lowest_linked
from tidewell.session import discard, relieve, staged

#: Single-letter edits that titles, companies and unlisted places of one vacancy may be apart.
EDITS = 2
#: A filter: bits and hashes. At 60,000 entries a partition, 1 in 100 unseen entries passes.
BITS, HASHES, PER_PART = 1 << 20, 5, 60_000

CONTENT = ("source", "title", "rank", "company", "place_id", "place")


def contents(postings: DataFrame, days: int) -> DataFrame:
    """(id, CONTENT, slot, first, last) of distinct contents in slots of `days`; id: their lowest posting id.
    Slots are shorter than `days`, so postings of one entry lie within it."""
    slot = F.floor(F.col("at") / F.lit(days * DAY)).cast("long").alias("slot")
    return postings.filter("at is not null and title <> '' and company <> ''").groupBy(*CONTENT, slot).agg(F.min("id").alias("id"), F.min("at").alias("first"), F.max("at").alias("last"))


# A text within EDITS edits of another holds one of its EDITS + 1 segments unchanged, at most EDITS places away.
_CUT = "CAST(n * {} div %d AS int)" % (EDITS + 1)
NEAR_SQL = f"""
WITH segments AS (
  SELECT kind, text, n, seg, substring(text, {_CUT.format("seg")} + 1, {_CUT.format("(seg + 1)")} - {_CUT.format("seg")}) AS part
  FROM (SELECT kind, text, length(text) AS n FROM {{known}}) LATERAL VIEW explode(sequence(0, {EDITS})) t AS seg),
probes AS (
  SELECT kind, text, n, seg, {_CUT.format("seg")} + 1 + shift AS at, substring(text, {_CUT.format("seg")} + 1 + shift, {_CUT.format("(seg + 1)")} - {_CUT.format("seg")}) AS part
  FROM {{asked}}
  LATERAL VIEW explode(sequence(greatest(length(text) - {EDITS}, 0), length(text) + {EDITS})) a AS n
  LATERAL VIEW explode(sequence(0, {EDITS})) b AS seg
  LATERAL VIEW explode(sequence(-{EDITS}, {EDITS})) c AS shift)
SELECT /*+ SHUFFLE_HASH(s) */ DISTINCT p.kind, p.text, s.text AS near
FROM probes p JOIN segments s ON p.kind = s.kind AND p.n = s.n AND p.seg = s.seg AND p.part = s.part
WHERE p.at >= 1 AND levenshtein(p.text, s.text, {EDITS}) >= 0
"""


def spellings(entries: DataFrame) -> DataFrame:
    """(kind, text): the distinct titles, companies and places of contents."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("title", "company", "place")))
    return entries.select(F.explode(kinds).alias("s")).select("s.kind", "s.text").filter("text is not null").distinct()


def near_spellings(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, text, near): each of `asked` with those of `known` of its kind up to EDITS edits away."""
    return asked.sparkSession.sql(NEAR_SQL, asked=asked, known=known)


def _print(how: str, *place: str) -> Column:
    return F.xxhash64("source", "rank", "title", "company", F.lit(how), *place)


def key_print() -> Column:
    return F.xxhash64(F.lit("posting"), "source", "key")


def prints(entries: DataFrame) -> DataFrame:
    """(id, slot, fp) to store: a content with its place and with any place, or as one that states no place."""
    fps = F.when(F.col("place").isNull(), F.array(_print("none"))).otherwise(F.array(_print("at", "place"), _print("any")))
    return entries.select("id", "slot", F.explode(fps).alias("fp"))


def asks(entries: DataFrame, near: DataFrame) -> DataFrame:
    """(id, slot, fp) to look for: of all spellings near a content's own; of its place or none stated, and of any
    place if it states none."""
    for kind in ("title", "company", "place"):
        other = near.filter(F.col("kind") == kind).select(F.col("text").alias(kind), F.col("near").alias("_near"))
        entries = entries.join(other, kind, "left").withColumn(kind, F.coalesce("_near", kind)).drop("_near")
    fps = F.array(_print("none"), F.when(F.col("place").isNull(), _print("any")).otherwise(_print("at", "place")))
    return entries.select("id", "slot", F.explode(fps).alias("fp")).distinct()


def _places(values: np.ndarray) -> np.ndarray:
    """Bit numbers of each value: two halves of a mixed hash, combined HASHES times."""
    with np.errstate(over="ignore"):
        x = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        one, two = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return np.stack([(one + np.uint64(i) * two) % np.uint64(BITS) for i in range(HASHES)]).astype(np.int64)


def _entry(fp: np.ndarray, slot: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return fp ^ (slot.astype(np.int64) * np.int64(0x5851F42D4C957F2D))


def _screen(key: tuple, batch: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """Which (fp, slot) that a partition's batch asks for may occur in the filter or elsewhere in the batch, in
    a neighbouring slot too; and the filter with the batch taken in. held, asked: whether the batch has it and
    asks for it; shared: whether it asks for one of another content."""
    bits = np.unpackbits(np.frombuffer(kept["bits"].iloc[0], np.uint8)) if len(kept) else np.zeros(BITS, np.uint8)
    fp, slot = (batch[c].to_numpy(np.int64) for c in ("fp", "slot"))
    held, asked, seen = (batch[c].to_numpy(bool) for c in ("held", "asked", "shared"))
    if len(fp):
        have = np.sort(_entry(fp[held], slot[held]))
        for step in (-1, 0, 1):
            entry = _entry(fp, slot + step)
            seen |= bits[_places(entry)].all(axis=0)
            if step and len(have):
                seen |= have[np.minimum(np.searchsorted(have, entry), len(have) - 1)] == entry
        seen &= asked
        bits[_places(_entry(fp[held], slot[held])).ravel()] = 1
    out = pd.DataFrame({"part": int(key[0]), "fp": fp[seen], "slot": slot[seen], "bits": None})
    return pd.concat([out, pd.DataFrame({"part": [int(key[0])], "fp": [0], "slot": [0], "bits": [np.packbits(bits).tobytes()]})], ignore_index=True)


STORED = "fp long, slot long, id long, root long, source string, key string, title string, rank string, company string, place_id long, place string, first long, last long, part int"
#: Columns of what is kept; root is the lowest id of the vacancy, title is null in the print of a posting's number.
KINDS = {"filters": "part int, bits binary", "texts": "kind string, text string", "words": "kind string, word string, n long", "prints": STORED}


@dataclass
class History:
    """Store, filters, spellings and words of all that was accepted, below `path`, one version a delivery.

    A version is a folder v=N in each of prints, texts (what it adds), filters and words (as they are then), and in
    state, which is written last: which versions make up the store, its number of partitions, the prints taken in.
    Versions that lack it never count; they are written again.
    """

    spark: SparkSession
    path: str
    state: dict
    #: Partitions of the store that the last delivery had to read, of how many.
    asked_parts: tuple[int, int] = (0, 0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The history at a path as its last whole version left it; an empty one where there is none."""
        jvm = spark._jvm
        path = path.rstrip("/")
        root = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        empty = {"version": 0, "parts": 1, "size": 0, "prints": [], "texts": []}
        return cls(spark, path, json.loads(spark.read.text(f"{path}/state/v={max(whole)}").first()[0]) if whole else empty)

    def _read(self, kind: str, versions: list[str]) -> DataFrame:
        """What these versions hold of a kind."""
        if not versions:
            return self.spark.createDataFrame([], KINDS[kind])
        at = f"{self.path}/{kind}"
        return self.spark.read.schema(f"{KINDS[kind]}, v string").option("basePath", at).parquet(*(f"{at}/v={v}" for v in versions)).drop("v")

    def _write(self, rows: DataFrame, version: int | str, kind: str, *by: str) -> None:
        writer = (rows.repartition(*by) if by else rows).write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{kind}/v={version}")

    def _now(self, kind: str) -> DataFrame:
        return self._read(kind, self.state[kind] if kind in ("prints", "texts") else [self.state["version"]] if self.state["version"] else [])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(self.state["parts"])).cast("int").alias("part")

    def _grow(self, more: int, version: int) -> DataFrame:
        """Room for so many prints more: the filters as they are, or, where partitions would overflow, the store
        divided anew and filters built from it. Partitions at least double then, so each print is moved a bounded
        number of times however long the history gets."""
        parts = self.state["parts"]
        while parts * PER_PART < self.state["size"] + more:
            parts *= 2
        if parts == self.state["parts"]:
            return self._now("filters")
        self.state = self.state | {"parts": parts}
        if not self.state["prints"]:
            return self._now("filters")
        self._write(self._now("prints").drop("part").withColumn("part", self._part()), f"{version}d", "prints", "part")
        self.state = self.state | {"prints": [f"{version}d"]}
        moved = self._now("prints")
        none = F.lit(False)
        held = moved.select("part", "fp", "slot", F.lit(True).alias("held"), none.alias("asked"), none.alias("shared")).distinct()
        return self._screened(held, self.spark.createDataFrame([], KINDS["filters"]))[1]

    def _screened(self, batch: DataFrame, filters: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((part, fp, slot) that may have been seen, the filters with the batch taken in)."""
        out = staged(batch.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(_screen, "part int, fp long, slot long, bits binary"), "screened")
        return out.filter("bits is null").select("part", "fp", "slot"), out.filter("bits is not null").select("part", "bits")

    def _stored(self, parts: list[int]) -> DataFrame:
        """What the store holds in these partitions; no others are read."""
        self.asked_parts = (self.asked_parts[0] + len(parts), self.asked_parts[1] + self.state["parts"])
        return self._now("prints").filter(F.col("part").isin(parts)) if parts else self._read("prints", [])

    def accept(self, rows: DataFrame, places: DataFrame, settings: DataFrame, days: int = 10) -> DataFrame:
        """Take in a delivery. rows: id (bigint, unique, higher than those of deliveries before), source, key (number of
        the posting on its board), title, company, location_raw, posted_at_raw, scraped_at.

        Returns (id, root) of rows that repeat an earlier one: root is the lowest id of the same source with the
        same posting or the same vacancy. Given roots stay: where posting times form a chain, each within `days` of
        the next, a row that closes a gap joins the lower root, the rows before it do not move. A null source or
        key is a value like any other. Rows given twice count once. An empty delivery changes nothing.
        """
        version = self.state["version"] + 1
        self.asked_parts = (0, 0)
        told = F.min_by(F.struct("title", "company", "location_raw", "posted_at_raw", "scraped_at"), "id").alias("r")
        firsts = staged(rows.groupBy("source", "key").agg(F.min("id").alias("id"), told).select("id", "source", "key", "r.*"), "first-rows")
        n = firsts.count()
        if not n:
            return self.spark.createDataFrame([], "id long, root long")
        filters = self._grow(3 * n, version)  # a posting's own print and at most two of its content

        # Postings that were there before. With nothing in the store none was, and their prints go in with the contents'.
        zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)
        keys = firsts.select("id", "source", "key", key_print().alias("fp"))
        held_keys = keys.select(self._part(), "fp", zero.alias("slot"), yes.alias("held"), yes.alias("asked"), no.alias("shared")).distinct()
        if self.state["prints"]:
            maybe, filters = self._screened(held_keys, filters)
            parts = [r.part for r in maybe.select("part").distinct().collect()]  # at most one number a partition
            had = self._stored(parts).filter("title is null").select("fp", "source", "key", "root")
            k, h = keys.join(maybe.select("fp"), "fp", "left_semi").alias("k"), had.alias("h")
            same = (F.col("k.fp") == F.col("h.fp")) & F.col("k.source").eqNullSafe(F.col("h.source")) & F.col("k.key").eqNullSafe(F.col("h.key"))
            known = staged(k.join(h, same).groupBy("k.id").agg(F.min("h.root").alias("root")).select("id", "root"), "known-postings")
            fresh = staged(firsts.join(known, "id", "left_anti"), "fresh-postings")
        else:
            known, fresh = self.spark.createDataFrame([], "id long, root long"), firsts

        # Contents of the others, their spelling mended by what is known by now.
        values = staged(spellings_of(fresh), "spellings")
        words = staged(word_counts(values, self._now("words")), "words")
        fields = staged(vacancy_fields(fresh.drop("key"), places, settings, values, words), "vacancies")
        relieve(self.spark)
        entries = staged(contents(fields, days), "contents")
        texts, old = staged(spellings(entries), "texts"), self._now("texts")
        near = staged(near_spellings(texts, old.unionByName(texts).distinct()), "near")
        wanted = staged(asks(entries, near), "asks")
        relieve(self.spark)
        new = prints(entries)
        no_id = F.lit(None).cast("long")
        both = new.select("fp", "slot", F.col("id").alias("has"), no_id.alias("asks")).unionByName(wanted.select("fp", "slot", no_id.alias("has"), F.col("id").alias("asks")))
        held, asked = F.count("has") > 0, F.count("asks") > 0
        alone = (F.min("has") == F.max("asks")) & (F.max("has") == F.min("asks"))
        batch = both.groupBy("fp", "slot").agg(held.alias("held"), asked.alias("asked"), (held & asked & ~F.coalesce(alone, no)).alias("shared")).select(self._part(), "fp", "slot", "held", "asked", "shared")
        maybe, filters = self._screened(batch if self.state["prints"] else batch.unionByName(held_keys.withColumn("asked", no)), filters)
        parts = [r.part for r in maybe.select("part").distinct().collect()]
        spread = wanted.join(maybe.select("fp", "slot"), ["fp", "slot"]).select(F.col("id").alias("b"), "fp", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
        own = entries.join(new.select("id", "fp"), "id")
        side = ("fp", "slot", "id", *CONTENT, "first", "last")
        there = self._stored(parts).filter("title is not null").select(*side, "root").unionByName(own.select(*side, F.col("id").alias("root")))
        a = there.select("fp", "slot", "root", *(F.col(c).alias("a" if c == "id" else f"a_{c}") for c in ("id", *CONTENT, "first", "last")))
        b = entries.select(*(F.col(c).alias("b" if c == "id" else f"b_{c}") for c in ("id", *CONTENT, "first", "last")))
        pairs = spread.join(a, ["fp", "slot"]).filter("a <> b").join(b, "b")
        timely = (F.col("a_first") <= F.col("b_last") + days * DAY) & (F.col("b_first") <= F.col("a_last") + days * DAY)
        spelled = (F.levenshtein("a_title", "b_title", EDITS) >= 0) & (F.levenshtein("a_company", "b_company", EDITS) >= 0)
        alike = pairs.filter(F.col("a_source").eqNullSafe(F.col("b_source")) & (F.col("a_rank") == F.col("b_rank")) & timely & spelled & (same_place("a", "b") > 0))
        roots = lowest_linked(alike.select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b"))

        relieve(self.spark)

        # Postings of one content and slot share an entry.
        slot = F.floor(F.col("at") / F.lit(days * DAY)).cast("long")
        rooted = entries.join(roots, "id", "left").select(*CONTENT, "slot", "id", F.coalesce("root", "id").alias("root"))
        on = [fields[c].eqNullSafe(rooted[c]) for c in CONTENT] + [slot == rooted["slot"]]
        led = fields.join(rooted, on, "left").select(fields["id"], F.least(fields["id"], F.coalesce(rooted["root"], fields["id"])).alias("root"))
        told = staged(known.unionByName(led), "roots")
        relieve(self.spark)

        # Store, filters, spellings and words take the delivery in.
        blank = {c: F.lit(None).cast("string") for c in ("title", "rank", "company", "place")} | {c: F.lit(None).cast("long") for c in ("place_id", "first", "last")}
        posted = fresh.select("id", "source", "key", key_print().alias("fp"), zero.alias("slot")).join(told, "id").withColumns(blank)
        said = own.join(rooted.select("id", "root"), "id").withColumn("key", F.lit(None).cast("string"))
        columns = [c.split()[0] for c in STORED.split(", ") if c != "part int"]
        added = posted.select(*columns).unionByName(said.select(*columns)).withColumn("part", self._part())
        self._write(added, version, "prints", "part")
        self._write(filters, version, "filters")
        self._write(texts.join(old, ["kind", "text"], "left_anti"), version, "texts")
        self._write(words, version, "words")
        state = self.state | {"version": version, "size": self.state["size"] + 3 * n, "prints": [*self.state["prints"], version], "texts": [*self.state["texts"], version]}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state/v={version}")
        self.state = state
        if fresh is not firsts:
            discard(fresh)
        discard(values, words, fields, entries, texts, near, wanted)
        lowest = firsts.join(told, "id").select(F.col("source").alias("_s"), F.col("key").alias("_k"), "root")
        same_posting = rows["source"].eqNullSafe(lowest["_s"]) & rows["key"].eqNullSafe(lowest["_k"])
        repeated = staged(rows.join(lowest, same_posting).filter("id > root").select("id", "root").distinct(), "repeats")
        relieve(self.spark)
        return repeated


def repeats(rows: DataFrame, places: DataFrame, settings: DataFrame, deliveries: list, path: str, days: int = 10) -> DataFrame:
    """(id, root) of all rows that repeat an earlier one, taken in delivery after delivery (conditions on the columns
    of rows) by the history at `path`."""
    history, out = History.open(rows.sparkSession, path), None
    for holds in deliveries:
        found = history.accept(rows.filter(holds), places, settings, days)
        out = found if out is None else out.unionByName(found)
    return out
