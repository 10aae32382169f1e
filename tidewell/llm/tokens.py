"""Encoding a corpus with a public byte-level BPE, by dynamic programming over byte prefixes.

The encoding of a byte string ends in exactly one token, and what precedes that token is the encoding of the
shorter prefix. So one token for each prefix stores the encodings of all prefixes: a token may follow
another if merging the two never crosses their border. Appends extend the table; an edit recomputes it from
the edit until it agrees with the old one again.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's memory of encoded words; beyond it the memory starts anew, results stay the same.
WORDS_KEPT = 300_000


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary of public_tokenizers; folder: where else the files are."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return f"{folder}/{name}"


class Vocabulary:
    """Tokens by rank, with the merge that makes each of them."""

    def __init__(self, path: str) -> None:
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.bytes_of = {r: b for b, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is this one; None for single bytes."""
        if token not in self._halves:
            data, parts = self.bytes_of[token], None
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    ranked = [(self.rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
                    best, i = min(ranked)
                    if best >= token:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if parts and len(parts) == 2 else None
        return self._halves[token]

    def merged(self, left: int, right: int) -> int | None:
        whole = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
        return whole if whole is not None and self.halves(whole) == (left, right) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`: taken apart merge by merge, latest first, no pair of tokens
        that touch at the border would have merged before the tokens beside it did."""
        key = (left, right)
        if (known := self._fits.get(key)) is not None:
            return known
        a, b, bound, answer = left, right, 1 << 30, True
        while True:
            across = self.merged(a, b)
            if across is not None and across < bound:
                answer = False
                break
            split_a, split_b = self.halves(a), self.halves(b)
            # The later of both merges is undone first; of equal ones the right one, as merges go left to right.
            if split_a is not None and (split_b is None or a > b):
                bound, a = a, split_a[1]
            elif split_b is not None:
                bound, b = b + 1, split_b[0]
            else:
                break
        self._fits[key] = answer
        return answer


class Prefixes:
    """Last tokens of all prefixes of a byte string (one pre-split piece)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token_at(self, end: int) -> int:
        rank, data, last = self.vocabulary.rank, self.data, self.last
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = rank.get(data[start:end])
            if token is not None and (start == 0 or self.vocabulary.fits(last[start - 1], token)):
                return token
        raise ValueError("no valid token ends here: the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were computed again."""
        old, shift = self.last, start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._token_at(end)
            self.last.append(token)
            before = end - shift
            agreed = agreed + 1 if before > stop and old[before - 1] == token else 0
            if agreed >= self.vocabulary.longest:  # all that later prefixes depend on is as it was
                self.last.extend(old[before:])
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: Runs of three or more blanks with a space among them: there cutting at single spaces is not exact.
_WIDE = re.compile(r" \s\s|\s \s|\s\s ")


class Encoder:
    """Whole texts to ids; words are remembered, and rebuilt when more than WORDS_KEPT are."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._pieces: dict[str, bytes] = {}
        self._after_space: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            whole = self.vocabulary.rank.get(data)
            ids = array("i", [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()).tobytes()
            if len(self._pieces) >= WORDS_KEPT:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _run(self, text: str) -> bytes:
        return b"".join(map(self._piece, PIECES.findall(text)))

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if _WIDE.search(text):
            return self._run(text)
        first, *parts = text.split(" ")
        known = self._after_space
        out = [self._run(first)]
        for part, ids in zip(parts, map(known.get, parts)):
            if ids is None:
                ids = self._run(" " + part)
                if len(part) <= 40:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _strings(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for each row, repeats included: ids without special tokens, whose strings count as
    ordinary text. Null and empty texts give an empty list; white space is text. Nothing is shuffled."""
    path = path or vocabulary_file()
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            packed = [coder.packed(t) if t else b"" for t in _strings(batch.column(1))]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
