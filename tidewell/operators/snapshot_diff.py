"""Added, removed and changed records between consecutive full snapshots, by invertible Bloom lookup tables.

Each record is an element (key hash, digest of its values). A snapshot becomes, per hash bucket of its keys, a
table of cells (count, xor of keys, of digests, of checks); three cells for an element. Tables are sized by what
is expected to differ, not by what is there. The tables of consecutive snapshots subtract cell by cell, which
leaves only what differs, and the cells that hold one element peel off the rest. A bucket that does not peel to
nothing is done again from its elements, with a table as large as its own cells say is needed. What is recovered
counts once a row of that snapshot, key hash and digest is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import discard, staged

HASHES = 3
#: Records that a bucket of one snapshot holds on average; bounds what one peeling step holds.
BUCKET_ROWS = 2048
#: Cells of a bucket at first, as a part of its records: enough while two elements differ for every five records.
CELL_SHARE = 0.5
#: Cells for each element expected to differ; peeling succeeds above 1.23 for large tables.
SPARE = 1.5
#: Tables of a failed bucket grow as often before it is compared record by record.
ROUNDS = 6


def trimmed(name: str) -> Column:
    """Text without white space at its ends; null and '' are one."""
    return F.coalesce(F.regexp_replace(F.col(name).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def _delivery(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(-(2**62)))


def snapshot_order(snapshots: DataFrame, no: str, delivery: str, key: str) -> DataFrame:
    """(snapshot_no, last, n, before, later): each snapshot with its highest delivery (null counts as the lowest), the
    rows of that, and the snapshots beside it. A row for each snapshot: small by the number of deliveries."""
    rows = snapshots.filter(F.col(no).isNotNull() & F.col(key).isNotNull())
    counts = rows.groupBy(F.col(no).cast("int").alias("snapshot_no"), _delivery(delivery).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    last = counts.groupBy("snapshot_no").agg(F.max(F.struct("last", "n")).alias("d")).select("snapshot_no", "d.last", "d.n")
    w = Window.orderBy("snapshot_no")
    return last.select("*", F.lag("snapshot_no").over(w).alias("before"), F.lead("snapshot_no").over(w).alias("later"))


def key_hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def latest_rows(snapshots: DataFrame, order: DataFrame, no: str, delivery: str, key: str, seen: str, digest: Column) -> DataFrame:
    """(snapshot_no, kh, digest), one row for each key of each snapshot's highest delivery: the one seen last; of
    rows seen at the same time the one with the largest digest. Null keys and snapshot numbers are left out; a
    null sighting counts as the lowest. Keys go by their hash from here on."""
    rows = snapshots.filter(F.col(no).isNotNull() & F.col(key).isNotNull()).select(
        F.col(no).cast("int").alias("snapshot_no"), _delivery(delivery).alias("last"), key_hash(key).alias("kh"), F.coalesce(F.unix_micros(seen), F.lit(-(2**62))).alias("at"), digest.alias("digest")
    )
    kept = rows.join(F.broadcast(order.select("snapshot_no", "last")), ["snapshot_no", "last"], "left_semi")
    return kept.groupBy("snapshot_no", "kh").agg(F.max(F.struct("at", "digest")).alias("row")).select("snapshot_no", "kh", F.col("row.digest").alias("digest"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def spark_hash(*values: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of columns of longs (arrays) and of int literals, as uint64."""
    with np.errstate(over="ignore"):
        h = np.uint64(42)
        for v in values:
            if isinstance(v, int):
                h = _mixed(_rotl((h + _P5 + np.uint64(4)) ^ (np.uint64(v) * _P1), 23) * _P2 + _P3)
            else:
                h = _mixed(_rotl((h + _P5 + np.uint64(8)) ^ (_rotl(v.view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)
        return h


def _spots(k: np.ndarray, d: np.ndarray, m: int) -> list[np.ndarray]:
    part = m // HASHES
    return [j * part + (spark_hash(k, d, j + 11) % np.uint64(part)).astype(np.int64) for j in range(HASHES)]


def _check(k: np.ndarray, d: np.ndarray) -> np.ndarray:
    return spark_hash(k, d, 7).view(np.int64)


def cells_for(elements: float) -> int:
    """Cells, a multiple of HASHES, for so many elements that differ; small tables need more room."""
    return max(HASHES * 8, -(-int(elements * SPARE + 12) // HASHES) * HASHES)


def table_of(kh: np.ndarray, digest: np.ndarray, m: int) -> np.ndarray:
    """The table of m cells that sums these elements: rows n, keys, digests, checks."""
    out = np.zeros((4, m), np.int64)
    chk = _check(kh, digest)
    for s in _spots(kh, digest, m):
        np.add.at(out[0], s, 1)
        for row, values in zip(out[1:], (kh, digest, chk)):
            np.bitwise_xor.at(row, s, values)
    return out


def subtracted(now: np.ndarray, prior: np.ndarray) -> np.ndarray:
    out = now ^ prior
    out[0] = now[0] - prior[0]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Key hashes, digests and signs of the elements of a subtracted table, and whether it came down to nothing.
    An element counts only if its check and its cell agree."""
    m = table.shape[1]
    n, k, d, x = table.copy()
    found: list[np.ndarray] = []
    while True:
        at = np.flatnonzero(np.abs(n) == 1)
        kk, dd = k[at], d[at]
        good = _check(kk, dd) == x[at]
        good &= np.any([s == at for s in _spots(kk, dd, m)], axis=0)
        pure = np.unique(np.stack([k[at[good]], d[at[good]], n[at[good]]], 1), axis=0)
        if not len(pure):
            break
        found.append(pure)
        kk, dd, nn = (np.ascontiguousarray(pure[:, i]) for i in range(3))
        for s in _spots(kk, dd, m):
            np.subtract.at(n, s, nn)
            for row, values in ((k, kk), (d, dd), (x, _check(kk, dd))):
                np.bitwise_xor.at(row, s, values)
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[:, 0], out[:, 1], out[:, 2], not (n.any() or k.any() or d.any() or x.any())


def expected_elements(table: np.ndarray) -> float:
    """How many elements a subtracted table holds, told by the share of its cells that are empty."""
    m = table.shape[1]
    empty = m - np.count_nonzero(table.any(axis=0))
    return -m / HASHES * float(np.log(max(empty, 0.5) / m))


def changes(keys: np.ndarray, digests: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key hash, digest, kind) of each key of signed elements; the digest is that of the later snapshot, for a
    removed key that of the earlier one."""
    each, where = np.unique(keys, return_inverse=True)
    came, went, digest = np.zeros(len(each), bool), np.zeros(len(each), bool), np.zeros(len(each), np.int64)
    for sign, seen in ((-1, went), (1, came)):
        one = signs == sign
        seen[where[one]] = True
        digest[where[one]] = digests[one]
    return each, digest, np.where(came & went, "changed", np.where(came, "added", "removed"))


def compared(now: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, digests and signs of what differs between two lists of elements (rows key, digest): record by record."""
    both = np.concatenate([now.T, prior.T])
    each, first, times = np.unique(both, axis=0, return_index=True, return_counts=True)
    alone = times == 1
    return each[alone, 0], each[alone, 1], np.where(first[alone] < now.shape[1], 1, -1)


_TABLES = "snapshot_no int, bucket int, cells binary, elements binary"
#: snapshot_no: where the row of this digest stands. kind 'failed': kh holds the elements expected to differ.
_FOUND = "pair int, bucket int, snapshot_no int, kh long, digest long, kind string"


def snapshot_tables(rows: DataFrame, buckets: int, m: int) -> DataFrame:
    """(snapshot_no, bucket, cells, elements) of rows (snapshot_no, kh, digest): one table a snapshot and bucket, and
    the elements behind it. Kept, a snapshot is compared with later ones without being read again; all must have
    the same number of buckets and of cells."""

    def run(group: pa.Table) -> pa.Table:
        kh, digest = (group.column(c).to_numpy() for c in ("kh", "digest"))
        cells = table_of(kh, digest, m).tobytes()
        return pa.table([group.column("snapshot_no")[:1], group.column("bucket")[:1], [cells], [np.stack([kh, digest]).tobytes()]], names=["snapshot_no", "bucket", "cells", "elements"])

    parted = rows.select("snapshot_no", F.pmod(F.xxhash64("kh", F.lit(3)), F.lit(buckets)).cast("int").alias("bucket"), "kh", "digest")
    return parted.groupBy("snapshot_no", "bucket").applyInArrow(run, _TABLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pair", "bucket", "snapshot_no", "kh", "digest", "kind"])


def _told(pair: int, prior: int, bucket: int, found: tuple) -> list[tuple]:
    return [(pair, bucket, prior if kind == "removed" else pair, k, d, kind) for k, d, kind in zip(*(x.tolist() for x in changes(*found)))]


def subtract_tables(tables: DataFrame, order: DataFrame, m: int) -> DataFrame:
    """Subtract each bucket's tables of consecutive snapshots and peel what is left. A bucket that one of the two
    does not have counts as an empty table."""
    beside = Window.partitionBy("bucket").orderBy("snapshot_no")
    lined = tables.select("snapshot_no", "bucket", "cells", F.lag(F.struct("snapshot_no", "cells")).over(beside).alias("had"), F.lead("snapshot_no").over(beside).alias("next"))
    ready = lined.join(F.broadcast(order.select("snapshot_no", "before", "later")), "snapshot_no").select(
        "snapshot_no", "bucket", "before", "later", "cells", F.when(F.col("had.snapshot_no") == F.col("before"), F.col("had.cells")).alias("prior"), F.col("next").eqNullSafe(F.col("later")).alias("goes_on")
    )
    none = np.zeros((4, m), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda cells: none if cells is None else np.frombuffer(cells, np.int64).reshape(4, -1)
        for batch in batches:
            out: list[tuple] = []
            for no, bucket, before, later, cells, prior, goes_on in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [(no, before, read(cells), read(prior))] if before is not None else []
                if later is not None and not goes_on:
                    pairs.append((later, no, none, read(cells)))
                for pair, earlier, now, then in pairs:
                    left = subtracted(now, then)
                    *found, done = peel(left)
                    if done:
                        out.extend(_told(pair, earlier, bucket, found))
                    else:
                        out.append((pair, bucket, earlier, int(expected_elements(left)) + 1, 0, "failed"))
            yield _batch(out)

    return ready.mapInArrow(run, _FOUND)


def enlarge(tables: DataFrame, failed: DataFrame, exactly: bool = False) -> DataFrame:
    """Failed buckets (pair, bucket, snapshot_no: the earlier one, kh: elements expected) done again from the elements of
    both snapshots, with tables that grow until they peel; after ROUNDS, or if `exactly`, record by record."""
    asked = failed.select("pair", "bucket", F.col("snapshot_no").alias("prior"), F.col("kh").alias("expected"))
    side = lambda no, name: tables.select(F.col("snapshot_no").alias(no), "bucket", F.col("elements").alias(name))
    ready = asked.join(side("pair", "now"), ["pair", "bucket"], "left").join(side("prior", "then"), ["prior", "bucket"], "left").select("pair", "prior", "bucket", "expected", "now", "then")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda b: np.frombuffer(b or b"", np.int64).reshape(2, -1)
        for batch in batches:
            out: list[tuple] = []
            for pair, prior, bucket, expected, now, then in zip(*(c.to_pylist() for c in batch.columns)):
                now, then = read(now), read(then)
                m, found, done = cells_for(min(expected, now.shape[1] + then.shape[1])), (), False
                for _ in range(0 if exactly else ROUNDS):
                    *found, done = peel(subtracted(table_of(*now, m), table_of(*then, m)))
                    if done:
                        break
                    m *= 2
                out.extend(_told(pair, prior, bucket, found if done else compared(now, then)))
            yield _batch(out)

    return ready.mapInArrow(run, _FOUND)


def diff_snapshots(
    snapshots: DataFrame, no: str, delivery: str, key: str, seen: str, digest: Column,
    bucket_rows: int = BUCKET_ROWS, cell_share: float = CELL_SHARE, keep: Callable[[DataFrame, str], DataFrame] = staged,
) -> DataFrame:
    """(snapshot_no int, id, change_kind 'added'/'removed'/'changed') of each snapshot against the one before
    it in the table. digest: 64-bit hash of the values whose difference counts. An empty table and a single
    snapshot give no row. Key hashes are 64 bit: ids that collide within one snapshot, odds of n^2/2^65,
    would share a fate."""
    order = keep(snapshot_order(snapshots, no, delivery, key), "snapshot-order")
    most = order.agg(F.max("n")).first()[0] or 0
    buckets, m = max(1, -(-most // bucket_rows)), max(HASHES * 8, int(bucket_rows * cell_share) // HASHES * HASHES)
    tables = keep(snapshot_tables(latest_rows(snapshots, order, no, delivery, key, seen, digest), buckets, m), "snapshot-tables")
    first = keep(subtract_tables(tables, order, m), "snapshot-peel")
    again = keep(enlarge(tables, first.filter("kind = 'failed'")), "snapshot-peel")
    found = first.filter("kind <> 'failed'").unionByName(again)
    # One id for each row that a recovered element may stand for; aggregated before it is moved.
    rows = snapshots.filter(F.col(no).isNotNull() & F.col(key).isNotNull()).select(F.col(no).cast("int").alias("snapshot_no"), key_hash(key).alias("kh"), digest.alias("digest"), F.col(key).alias("id"))
    names = rows.groupBy("snapshot_no", "kh", "digest").agg(F.min("id").alias("id"))
    named = keep(found.join(names, ["snapshot_no", "kh", "digest"], "left").select("pair", "bucket", "id", "kind"), "snapshot-changes")
    doubted = named.filter("id is null").select("pair", "bucket").distinct()
    if not doubted.isEmpty():  # an element that no row has: its bucket is compared record by record
        before = order.select(F.col("snapshot_no").alias("pair"), F.col("before").alias("snapshot_no"))
        exact = enlarge(tables, doubted.join(before, "pair").withColumn("kh", F.lit(0).cast("long")), exactly=True)
        named = named.join(doubted, ["pair", "bucket"], "left_anti").unionByName(exact.join(names, ["snapshot_no", "kh", "digest"]).select("pair", "bucket", "id", "kind"))
    else:
        discard(first, again, tables)
    return named.select(F.col("pair").alias("snapshot_no"), "id", F.col("kind").alias("change_kind"))
