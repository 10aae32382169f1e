"""Reading level of documents: distributions of surprisal under n-gram models, mapped by isotonic regression.

One interpolated trigram model a level is trained on half of all labelled documents; the weights of its orders are
fitted by EM on other ones. Each sentence of a document has a surprisal a word under every model. The quantiles of these,
and of their differences, over all words of the whole document are its distribution; a linear projection makes one
score of them, which a monotone step function, fitted on still other labelled documents, maps to the rated level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.leaks import words_of
from tidewell.llm.tokens import _strings
from tidewell.session import discard, staged

LEVELS = (1, 2, 3)
#: Every labelled document is used, by a hash of its id: half of them train the models, a sixth fits weights and
#: projection, a third the mapping.
TRAIN, WEIGH, MAP = 0, 1, 2
#: Cells of the count table of one order and level. n-grams share cells by hash, so the models have one
#: size however large the corpus is.
CELLS = 1 << 17
#: Cells that are summed up together.
BLOCK = 1 << 13
#: Weights of trigrams, bigrams, words and the uniform model before they are fitted.
MIX = (0.55, 0.3, 0.145, 0.005)
#: Quantiles that stand for a distribution of surprisal, and the ridge of the projection.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
RIDGE = 1.0

#: Tokens scored in one go by a worker.
TOGETHER = 100_000

_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?|[0-9]+|[.!?]+(?=\s|$)|\n\s*")
_EDGE, _NUMBER = 1, 2
_M = np.uint64(0xFF51AFD7ED558CCD)


def english(lang: Column) -> Column:
    """Whether a language code is a spelling of English: en, eng, en-AU, en_US ..., any case, spaces ignored."""
    return F.coalesce(F.regexp_replace(F.lower(lang), r"(?U)\s+", "").rlike(r"^(en|eng|english)([-_][a-z0-9]+)*$"), F.lit(False))


_codes: dict[str, int] = {}


def _code(word: str) -> int:
    """A word's 64-bit code: FNV-1a of its bytes, kept for words seen before."""
    code = _codes.get(word)
    if code is None:
        if word[0].isdigit():
            code = _NUMBER
        elif not word[0].isalpha():
            code = _EDGE
        else:
            code = 0xCBF29CE484222325
            for byte in word.encode():
                code = ((code ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        if len(_codes) > 500_000:
            _codes.clear()
        _codes[word] = code
    return code


def tokens_of(text: str) -> np.ndarray:
    """Codes of words, numbers and sentence ends; one end for a run of them."""
    found = _TOKEN.findall(text.lower())
    codes = np.fromiter(map(_code, found), np.uint64, len(found))
    codes = np.concatenate([[np.uint64(_EDGE)], codes, [np.uint64(_EDGE)]])
    edge = codes == _EDGE
    return codes[~(edge & np.concatenate([[False], edge[:-1]]))]


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def cells_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the words, bigrams and trigrams that end at each token; the start is padded with ends."""
    pad = np.concatenate([np.full(2, _EDGE, np.uint64), codes])
    one = _mix64(codes)
    two = _mix64(one + pad[1:-1] * np.uint64(0x9E3779B97F4A7C15))
    three = _mix64(two + pad[:-2] * np.uint64(0xC2B2AE3D27D4EB4F))
    return tuple((h % np.uint64(CELLS)).astype(np.int64) for h in (one, two, three))


def word_quantiles(values: np.ndarray, words: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """[text, quantile] of sentence values, each counted once for each of its words; of: the text of a sentence,
    ascending. All texts must have a sentence."""
    order = np.lexsort((values, of))
    w = words[order].astype(float)
    middle = np.cumsum(w) - w / 2
    total = np.bincount(of, words, texts)
    base = np.concatenate([[0.0], np.cumsum(total)[:-1]])
    last = np.cumsum(np.bincount(of, minlength=texts)) - 1
    spots = np.searchsorted(middle, base[:, None] + total[:, None] * np.array(QUANTILES))
    return values[order][np.minimum(spots, last[:, None])]


@dataclass
class Moments:
    """Number of rows, their means and the sums of products of what they differ from these by."""

    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(34))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((34, 34)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        return cls(len(rows), mean, (rows - mean).T @ (rows - mean))

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * other.n / n, self.spread + other.spread + np.outer(apart, apart) * self.n * other.n / n)


@dataclass
class Levels:
    """Counts of each level's models, orders 1 to 3, the weights of their orders, the projection of surprisal
    distributions and the mapping from score to level."""

    counts: np.ndarray  # [level, order, cell]
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array(MIX)[:, None], (1, len(LEVELS))))  # [order, level]
    center: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: np.ndarray | None = None  # by feature; without one, the mean difference of the outer models is the score
    edges: list[float] = field(default_factory=list)  # scores at which the level rises

    def __post_init__(self) -> None:
        self.total = np.maximum(self.counts[:, 0].sum(1), 1.0)

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """[order, level, token]: probabilities by trigrams, bigrams, words and the uniform model."""
        one, two, three = cells_of(codes)
        before = np.concatenate([[one[0]], one[:-1]])
        before2 = np.concatenate([[two[0]], two[:-1]])
        c = self.counts
        bi = c[:, 1][:, two] / np.maximum(c[:, 0][:, before], 1.0)
        tri = c[:, 2][:, three] / np.maximum(c[:, 1][:, before2], 1.0)
        return np.minimum(np.stack([tri, bi, c[:, 0][:, one] / self.total[:, None], np.full(bi.shape, 1 / CELLS)]), 1.0)

    def surprisal(self, codes: np.ndarray) -> np.ndarray:
        """Surprisal in nats of each token under the models of all levels: [level, token]."""
        return -np.log(np.einsum("ol,olt->lt", self.weights, self.parts(codes)))

    def features(self, texts: list[str]) -> np.ndarray:
        """[text, feature]: quantiles over words of the surprisal a word that sentences have under each model, quantiles
        and means of its differences. Worked through together, TOGETHER tokens at a time."""
        out: list[np.ndarray] = []
        waiting: list[np.ndarray] = []
        size = 0
        for text in texts:
            waiting.append(tokens_of(text))
            size += len(waiting[-1])
            if size >= TOGETHER:
                out.append(self._features(waiting))
                waiting, size = [], 0
        if waiting:
            out.append(self._features(waiting))
        return np.concatenate(out) if out else np.zeros((0, 33))

    def _features(self, texts: list[np.ndarray]) -> np.ndarray:
        codes = np.concatenate(texts)
        first = np.cumsum([0, *map(len, texts[:-1])])
        s = self.surprisal(codes)
        s[:, first] = 0.0  # what begins a text follows nothing
        after_edge = np.concatenate([[True], codes[:-1] == _EDGE])
        after_edge[first] = True
        starts = np.flatnonzero(after_edge)
        lengths = np.diff(np.append(starts, len(codes)))
        per_word = np.add.reduceat(s, starts, axis=1) / lengths
        of, n = np.searchsorted(first, starts, "right") - 1, len(texts)
        words = np.bincount(of, lengths, n)
        apart = [per_word[0] - per_word[1], per_word[1] - per_word[2], per_word[0] - per_word[2]]
        means = [np.bincount(of, d * lengths, n) / words for d in apart]
        return np.column_stack([*means, *(word_quantiles(v, lengths, of, n) for v in (*apart, *per_word))])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features[:, 2] if self.slope is None else (features - self.center) @ self.slope

    def fit_projection(self, moments: Moments) -> None:
        """Ridge regression of the rated level on standardised features; moments: those of features and level."""
        if moments.n and moments.spread[-1, -1] > 0:
            self.center, scale = moments.mean[:-1], np.sqrt(np.diag(moments.spread)[:-1] / moments.n)
            scale = np.where(scale > 1e-9 * (1 + np.abs(self.center)), scale, np.inf)  # what is always the same tells nothing
            self.slope = np.linalg.solve(moments.spread[:-1, :-1] / np.outer(scale, scale) + RIDGE * np.eye(len(scale)), moments.spread[:-1, -1] / scale) / scale

    def level(self, score: float) -> int:
        return LEVELS[0] + sum(score >= e for e in self.edges)


def fit_weights(grid: np.ndarray, times: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the orders by EM: grid [cell, order] of probabilities, times: how many tokens have them."""
    w = np.array(MIX)
    for _ in range(rounds):
        share = grid * w
        w = ((share / share.sum(1, keepdims=True)) * times[:, None]).sum(0) / times.sum()
        w = np.maximum(w, 1e-4)
        w /= w.sum()
    return w


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the non-decreasing means fitted to them."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # [mean, weight, first]
    for i, y in enumerate(levels[order].astype(float)):
        blocks.append([y, 1.0, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _ = blocks.pop()
            blocks[-1][0] = (blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w)
            blocks[-1][1] += w
    fitted = np.concatenate([np.full(int(b[1]), b[0]) for b in blocks]) if blocks else np.zeros(0)
    return scores[order], fitted


def fit_edges(scored: DataFrame) -> list[float]:
    """scored: score, level. Scores from which the isotonic fit is nearer to the next level; midway between the labelled
    scores. The fit is at least c from the first place on at which the sum of (level - c) over all lower scores is least,
    so running sums over ranges of scores tell it; each range sends one row."""
    steps = np.array([2 * step + 1 for step in LEVELS[:-1]])

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first, last = np.zeros(len(steps), np.int64), None, None
        least: list[tuple[int, float, float | None]] = [(0, 0.0, None)] * len(steps)  # sum before, score, score below
        for batch in batches:
            if not len(batch):
                continue
            score = batch["score"].to_numpy()
            gain = batch["twice"].to_numpy(np.int64)[:, None] - steps * batch["n"].to_numpy(np.int64)[:, None]
            before = total + np.cumsum(gain, axis=0) - gain
            below = [last, *score[:-1].tolist()]
            for k, i in enumerate(before.argmin(0)):
                if first is None or before[i, k] < least[k][0]:
                    least[k] = (int(before[i, k]), float(score[i]), below[i])
            total = total + gain.sum(0)
            first, last = score[0] if first is None else first, float(score[-1])
        if first is not None:
            yield pd.DataFrame({"first": [first], "last": [last], "total": [total.tolist()], **{k: [[x[i] for x in least]] for i, k in enumerate(("least", "at", "below"))}})

    ranges = (
        scored.groupBy("score").agg(F.sum(2 * F.col("level")).alias("twice"), F.count(F.lit(1)).alias("n")).repartitionByRange("score").sortWithinPartitions("score")
        .mapInPandas(lowest, "first double, last double, total array<long>, least array<long>, at array<double>, below array<double>").collect()
    )
    edges = []
    for k in range(len(steps)):
        edge, least, so_far, last = -float("inf"), 0, 0, None
        for r in sorted(ranges, key=lambda r: r["first"]):
            if so_far + r["least"][k] < least:
                below = last if r["below"][k] is None else r["below"][k]
                edge, least = (below + r["at"][k]) / 2, so_far + r["least"][k]
            so_far, last = so_far + r["total"][k], r["last"]
        edges.append(float("inf") if so_far < least or last is None else edge)
    return edges


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, level, part) of every labelled document. A document's level is the median of its ratings, the lower one
    of two. Null ratings and texts are left out."""
    votes = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.sort_array(F.collect_list("reading_level")).alias("v"))
    rated = votes.select("doc_id", F.element_at("v", F.floor((F.size("v") + 1) / 2).cast("int")).alias("level"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(6))
    labelled = documents.select("doc_id", "text").filter("text is not null").join(rated.hint("shuffle_hash"), "doc_id")
    return labelled.select("text", "level", F.when(part < 3, TRAIN).when(part == 3, WEIGH).otherwise(MAP).alias("part"))


def fit_levels(labelled: DataFrame) -> Levels:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(LEVELS), 3, CELLS), np.int64)
        for batch in batches:
            for text, level in zip(batch["text"], batch["level"]):
                for order, cells in enumerate(cells_of(tokens_of(text))):
                    np.add.at(sums[int(level) - 1, order], cells, 1)
        blocks = sums.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": at, "n": [blocks[i].tobytes() for i in at]})

    def add(blocks: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": blocks["block"].iloc[:1], "n": [sum(np.frombuffer(n, np.int64) for n in blocks["n"]).tobytes()]})

    kind = "block int, n binary"
    summed = labelled.filter(F.col("part") == TRAIN).select("text", "level").mapInPandas(count, kind).groupBy("block").applyInPandas(add, kind)
    counts = np.zeros((len(LEVELS), 3, CELLS), np.float32)
    for row in summed.collect():  # as many rows as the table has blocks
        counts.reshape(-1, BLOCK)[row.block] = np.frombuffer(row.n, np.int64)
    model = Levels(counts)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    # Tokens that no model was trained on, counted by their probabilities in quarter steps of a power of two: the grid
    # has a bounded number of cells, however long the texts.
    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, level in zip(batch["text"], batch["level"]):
                p = sent.value.parts(tokens_of(text))[:3, int(level) - 1]
                steps, n = np.unique(np.where(p > 0, np.maximum(np.round(4 * np.log2(np.maximum(p, 1e-9))), -80), -99).astype(int), axis=1, return_counts=True)
                yield pd.DataFrame({"level": int(level), "tri": steps[0], "bi": steps[1], "one": steps[2], "n": n})

    cells = labelled.filter(F.col("part") == WEIGH).select("text", "level").mapInPandas(grid, "level int, tri int, bi int, one int, n long").groupBy("level", "tri", "bi", "one").agg(F.sum("n").alias("n")).toPandas()
    for level, group in cells.groupby("level"):
        steps = group[["tri", "bi", "one"]].to_numpy()
        probabilities = np.column_stack([np.where(steps > -99, 2.0 ** (steps / 4), 0.0), np.full(len(group), 1 / CELLS)])
        model.weights[:, int(level) - 1] = fit_weights(probabilities, group["n"].to_numpy(float))
    weights = model.weights

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, m = replace(sent.value, weights=weights), Moments()
        for batch in batches:
            if len(batch):
                m = m + Moments.of(np.column_stack([fitted.features(list(batch["text"])), batch["level"]]))
        if m.n:
            yield pd.DataFrame({"n": [m.n], "mean": [m.mean.tobytes()], "spread": [m.spread.tobytes()]})

    of_tasks = labelled.filter(F.col("part") == WEIGH).select("text", "level").mapInPandas(moments, "n long, mean binary, spread binary").collect()
    model.fit_projection(sum((Moments(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["spread"]).reshape(34, 34)) for r in of_tasks), Moments()))
    center, slope = model.center, model.slope

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = replace(sent.value, weights=weights, center=center, slope=slope)
        for batch in batches:
            yield pd.DataFrame({"score": fitted.scores(fitted.features(list(batch["text"]))), "level": batch["level"].to_numpy()})

    model.edges = fit_edges(staged(labelled.filter(F.col("part") == MAP).select("text", "level").mapInPandas(scores, "score double, level int"), "scores"))
    return model


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = 40) -> DataFrame:
    """(doc_id, reading_level int, score double) of each row whose lang is English and whose text has at
    least least_words words. Null texts and languages give no row; without labels every level is 1."""
    labelled = staged(labelled_documents(documents.filter(english(F.col("lang"))), labels), "labelled")
    model = documents.sparkSession.sparkContext.broadcast(fit_levels(labelled))
    discard(labelled)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = model.value
        for batch in batches:
            texts = _strings(batch.column(1))
            kept = [i for i, t in enumerate(texts) if t and len(words_of(t)) >= least_words]
            scores = levels.scores(levels.features([texts[i] for i in kept])).tolist()
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([levels.level(s) for s in scores], pa.int32()), pa.array(scores, pa.float64())], names=["doc_id", "reading_level", "score"]
            )

    chosen = documents.filter(english(F.col("lang")) & (F.length("text") >= 2 * least_words - 1)).select("doc_id", "text")
    return chosen.mapInArrow(run, f"doc_id {kind}, reading_level int, score double")
