"""Records of one thing across sources without a key: Gaussian mixtures over similarity vectors.

Pairs come from blocks of two agreeing attributes within a span of time. A two-component mixture with
regularised variances separates matched from unmatched pairs without labels. Transitivity (if a is b and b is c,
then a is c) is enforced in every round of expectation-maximisation: after the posteriors are worked out and before
the components are fitted to them, those of three pairs that break p(a, c) >= p(a, b) + p(b, c) - 1 are moved by a
third of what is missing each, the implied one up, the other two down. Pairs that are implied but share no block
become candidates. The mixture itself works on counts of similarity vectors, whose grid has one
size however many pairs there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.vacancies import same_place
from tidewell.session import relieve, staged

DAY = 86_400_000_000
#: Steps of each similarity on the grid.
STEPS = 20
#: Edits from which two titles or companies are as unlike as can be.
MOST_EDITS = 5
#: Added to every variance, so that no component shrinks to a point.
RIDGE = 4e-3
FEATURES = ("f_title", "f_company", "f_place", "f_rank", "f_time")


def candidates(rows: DataFrame, days: int) -> DataFrame:
    """(a, b), a < b, of rows of different sources that agree in two of title, company and place (of company
    and place in a word of the title too) and lie at most about twice `days` apart."""
    slot = F.floor(F.col("at") / F.lit(days * DAY)).cast("long")
    keyed = rows.filter("at is not null").select(
        "id", "source", slot.alias("slot"),
        F.explode(F.concat(
            F.when((F.col("title") != "") & (F.col("company") != ""), F.array(F.xxhash64(F.lit(1), "title", "company", "rank"))).otherwise(F.array().cast("array<bigint>")),
            F.when((F.col("title") != "") & F.col("place").isNotNull(), F.array(F.xxhash64(F.lit(2), "title", "place", "rank"))).otherwise(F.array().cast("array<bigint>")),
            F.when((F.col("company") != "") & F.col("place").isNotNull(), F.transform(F.split("title", " "), lambda w: F.xxhash64(F.lit(3), "company", "place", w))).otherwise(F.array().cast("array<bigint>")),
        )).alias("key"),
    )
    near = keyed.select(F.col("id").alias("x"), F.col("source").alias("xs"), "key", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    met = keyed.join(near, ["key", "slot"]).filter("id < x and source <> xs")
    return met.select(F.col("id").alias("a"), F.col("x").alias("b")).distinct()


def _alike(x: str, y: str) -> Column:
    """1 less a share of MOST_EDITS for each edit; 0 where both are empty, which says nothing for a match."""
    return F.when((F.col(x) == "") & (F.col(y) == ""), 0.0).otherwise(1 - F.least(F.levenshtein(x, y), F.lit(MOST_EDITS)) / F.lit(MOST_EDITS))


def similarities(pairs: DataFrame, rows: DataFrame, days: int) -> DataFrame:
    """(a, b, FEATURES) of pairs at most `days` apart; features are similarities times STEPS."""
    side = lambda s: rows.select(*(F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in ("id", "title", "rank", "company", "place_id", "place", "at")))
    gap = F.abs(F.col("a_at") - F.col("b_at")) / DAY
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(gap <= days)
    return both.select(
        "a", "b", _alike("a_title", "b_title").alias("f_title"), _alike("a_company", "b_company").alias("f_company"), same_place("a", "b").alias("f_place"),
        (F.col("a_rank") == F.col("b_rank")).cast("double").alias("f_rank"), (1 - gap / days).alias("f_time"),
    ).select("a", "b", *(F.round(F.col(f) * STEPS).cast("int").alias(f) for f in FEATURES))


class Mixture:
    """Two Gaussians with independent features: 0 unmatched, 1 matched."""

    def __init__(self, grid: np.ndarray, weight: np.ndarray, start: np.ndarray) -> None:
        self.x, self.n, self.post = grid / STEPS, weight, start
        # An unknown place says nothing for either component.
        self.known = np.ones_like(self.x)
        self.known[:, FEATURES.index("f_place")] = grid[:, FEATURES.index("f_place")] != STEPS / 2
        self.maximise()

    def maximise(self) -> None:
        mass = np.stack([self.n * (1 - self.post), self.n * self.post]) + 1e-9
        self.share = mass.sum(1) / mass.sum()
        size = mass @ self.known + 1e-9
        self.mean = mass @ (self.x * self.known) / size
        self.var = np.stack([m @ ((self.x - mu) ** 2 * self.known) / k for m, mu, k in zip(mass, self.mean, size)]) + RIDGE

    def expect(self) -> None:
        apart = (self.x[None] - self.mean[:, None]) ** 2 / self.var[:, None] + np.log(self.var)[:, None]
        log = np.log(self.share)[:, None] - 0.5 * (apart * self.known).sum(2)
        log -= log.max(0)
        p = np.exp(log)
        self.post = p[1] / p.sum(0)

    def on(self, grid: np.ndarray, weight: np.ndarray) -> Mixture:
        """These components, as they are, over other vectors."""
        other = Mixture(grid, weight, np.full(len(grid), 0.5))
        other.share, other.mean, other.var = self.share, self.mean, self.var
        other.expect()
        return other

    def fit(self, rounds: int = 60) -> None:
        for _ in range(rounds):
            before = self.post
            self.expect()
            self.maximise()
            if np.abs(before - self.post).max() < 1e-4:
                break


def _triangles(pairs: DataFrame) -> DataFrame:
    """(a, mid, b, cell1, cell2): each two of pairs (a, b, cell) that meet in one row `mid`; they imply (a, b)."""
    ways = pairs.select("a", "b", "cell").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cell"))
    one, two = ways.select(F.col("b").alias("mid"), F.col("a").alias("x"), F.col("cell").alias("cell1")), ways.select(F.col("a").alias("mid"), F.col("b").alias("y"), F.col("cell").alias("cell2"))
    return one.join(two, "mid").filter("x < y").select(F.col("x").alias("a"), "mid", F.col("y").alias("b"), "cell1", "cell2")


def _cell() -> Column:
    """The number of a similarity vector on the grid."""
    out = F.lit(0)
    for f in FEATURES:
        out = out * (STEPS + 1) + F.col(f)
    return out.cast("int").alias("cell")


def match_across(rows: DataFrame, days: int = 10, rounds: int = 5) -> DataFrame:
    """(a, b, confidence, FEATURES) of candidate pairs and of pairs that these imply; rows as vacancy_fields gives
    them. confidence: posterior of being matched, after transitivity. Rows without any time, and empty tables, give
    no pair; rows given twice must have ids of their own."""
    spark = rows.sparkSession
    relieve(spark)
    pairs = staged(similarities(candidates(rows, days), rows, days).select("a", "b", *FEATURES, _cell()), "similarities")
    relieve(spark)
    # The vectors that occur: at most 6 x 6 x 3 x 2 x 21, by the steps that features have.
    cells = pairs.groupBy(*FEATURES, "cell").count().toPandas()
    if not len(cells):
        return pairs.select("a", "b", F.lit(None).cast("double").alias("confidence"), *FEATURES)
    start = lambda grid: (grid[:, :4].min(1) >= 0.5 * STEPS) * (grid[:, :2].min(1) >= 0.6 * STEPS) * 0.98 + 0.01
    grid = cells[list(FEATURES)].to_numpy(float)
    mixture = Mixture(grid, cells["count"].to_numpy(float), start(grid))
    mixture.fit()

    # A row for each vector on the grid: small by the bound above.
    posteriors = lambda: spark.createDataFrame([(int(c), float(p)) for c, p in zip(cells["cell"], mixture.post)], "cell int, p double")
    likely = lambda: pairs.join(F.broadcast(posteriors().filter("p >= 0.5").select("cell")), "cell", "left_semi")
    sources = lambda x: rows.select(F.col("id").alias(x), F.col("source").alias(f"{x}_source"))
    implied = _triangles(likely()).select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti").join(sources("a"), "a").join(sources("b"), "b").filter("a_source <> b_source")
    pairs = staged(pairs.unionByName(similarities(implied.select("a", "b"), rows, days).select("a", "b", *FEATURES, _cell())), "similarities")
    cells = pairs.groupBy(*FEATURES, "cell").count().toPandas()
    grid = cells[list(FEATURES)].to_numpy(float)
    mixture = mixture.on(grid, cells["count"].to_numpy(float))
    triangles = staged(_triangles(pairs).join(pairs.select("a", "b", "cell"), ["a", "b"]), "triangles")
    relieve(spark)

    def moves() -> DataFrame:
        """(a, b, cell, move): how far constraints move posteriors; of several each way the furthest."""
        p = F.broadcast(posteriors())
        of = lambda c, name: p.select(F.col("cell").alias(c), F.col("p").alias(name))
        third = ((F.col("p1") + F.col("p2") - 1 - F.col("p3")) / 3).alias("v")
        broken = triangles.join(of("cell1", "p1"), "cell1").join(of("cell2", "p2"), "cell2").join(of("cell", "p3"), "cell").filter("p1 + p2 - 1 > p3").select("a", "mid", "b", "cell", "cell1", "cell2", third)
        pair = lambda x, y, cell, v: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(cell).alias("cell"), v.alias("v"))
        each = F.explode(F.array(pair("a", "b", "cell", F.col("v")), pair("a", "mid", "cell1", -F.col("v")), pair("mid", "b", "cell2", -F.col("v"))))
        return broken.select(each.alias("m")).select("m.*").groupBy("a", "b", "cell").agg((F.greatest(F.max("v"), F.lit(0.0)) + F.least(F.min("v"), F.lit(0.0))).alias("move"))

    for _ in range(rounds):
        before = mixture.post
        moved = {r.cell: r.by for r in moves().groupBy("cell").agg(F.sum("move").alias("by")).collect()}
        mixture.post = np.array([min(max(p + moved.get(c, 0.0) / n, 0.0), 1.0) for c, p, n in zip(cells["cell"], mixture.post, cells["count"])])
        mixture.maximise()
        mixture.expect()
        relieve(spark)
        if np.abs(mixture.post - before).max() < 1e-4:
            break
    scored = pairs.join(F.broadcast(posteriors()), "cell").join(moves().select("a", "b", "move"), ["a", "b"], "left")
    return scored.select("a", "b", F.greatest(F.least(F.col("p") + F.coalesce("move", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("confidence"), *FEATURES)


def matched(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of at least this confidence."""
    return scored.filter(F.col("confidence") >= least)
