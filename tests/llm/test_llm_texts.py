"""Token ids, leaks and reading levels against other implementations and brute force."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import leaks as L
from tidewell.llm import reading as R
from tidewell.llm.tokens import Encoder, Prefixes, encode_corpus, vocabulary_file

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "   ", "a", " a", "a  b", "a   b", "a \n\n b", "\t\tx y   z", "don't WON'T we'll", "日本語 テキスト🎉🎉", "é́�", "<|endoftext|> x", "x" * 3000, "1234567 89,10", "a\r\n\r\n  b \x1c c \x85 d"]


@pytest.fixture(scope="module")
def other():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return Encoder(vocabulary_file())


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text, coder, other):
    assert coder.encode(text) == other.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=60))
def test_ids_of_any_text(text):
    coder, other = _both()
    assert coder.encode(text) == other.encode_ordinary(text)


_kept = []


def _both():
    if not _kept:
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _kept.extend([Encoder(vocabulary_file()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _kept


def test_appends_and_edits_are_exact(coder, other):
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randint(1, 300)))
        p = Prefixes(coder.vocabulary, data[:100])
        p.append(data[100:])
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 5))
        new = bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(0, 4)))
        done = p.edit(a, b, new)
        whole = Prefixes(coder.vocabulary, data[:a] + new + data[b:])
        assert p.data == whole.data and p.last == whole.last and done <= len(p.data) - a
        assert b"".join(coder.vocabulary.bytes_of[t] for t in p.tokens()) == p.data
        assert p.tokens() == other.encode_ordinary(p.data.decode())


def test_corpus_ids(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, " ", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in encode_corpus(rows).collect())
    assert got == [(1, (64, 275)), (2, ()), (3, ()), (3, (220,))]
    assert encode_corpus(rows.limit(0)).count() == 0


def _naive(docs, items, least):
    out = set()
    for d, text in docs:
        w = L.words_of(text)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for k, item in items:
            v = L.words_of(item)
            if any(tuple(v[i : i + least]) in grams for i in range(len(v) - least + 1)):
                out.add((d, k))
    return out


def test_leaks_are_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = [(1, None), (2, ""), (3, "?!")]
    for i in range(40):
        parts = [" ".join(word() for _ in range(20))]
        k, at = rng.randint(0, 11), rng.randint(0, 20)
        parts.append(" , ".join(items[k][1].split()[at : at + rng.randint(4, 10)]).upper())
        docs.append((10 + i, "\n".join(parts)))
    docs.append((10, docs[3][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(d, e, longest=6).collect()}
    assert got == _naive([x for x in docs if x[1]], [x for x in items if x[1]], 6)
    assert L.find_leaks(d, e.limit(0)).count() == 0 and L.find_leaks(d.limit(0), e).count() == 0


def test_tiles_cover_reordered_passages():
    item = np.arange(1, 41)
    doc = np.concatenate([[0], item[20:40], [0, 0], item[0:20], [0]])
    seeds = [(i, j) for i in range(len(doc) - 4) for j in range(37) if (doc[i : i + 4] == item[j : j + 4]).all()]
    found = L.tiles(doc, item, seeds, 4)
    assert sorted(found) == [(1, 20, 20), (23, 0, 20)]


def _longest_first(doc, item, least):
    """Greedy tiling by trying every start against every start, again and again."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(n)
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n


def test_coverage_finds_reordered_passages_as_brute_force(spark):
    """Items cut into runs of 4 to 9 words and shuffled, whole or in part: no run of 13 words is left."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(40))) for i in range(10)]
    docs = []
    for i in range(30):
        words, cuts, at = items[rng.randint(0, 9)][1].split(), [], 0
        while at < 40:
            n = rng.randint(4, 9)
            cuts.append(words[at : at + n])
            at += n
        rng.shuffle(cuts)
        docs.append((i, " -- ".join(" ".join(c).title() + ", x" for c in cuts[: rng.randint(1, len(cuts))])))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.longest, r.covered, r.tiles) for r in L.find_leaks(d, e, longest=L.SEED, coverage=0.5).collect()}
    want = {}
    for i, text in docs:
        for k, passage in items:
            found = _longest_first(L.words_of(text), L.words_of(passage), L.SEED)
            if sum(found) >= 20:
                want[i, k] = (found[0], sum(found), len(found))
    assert got == want and len(want) >= 8 and L.find_leaks(d, e, longest=13).count() < len(want)


def test_stretches():
    marks = np.array([1, 1, 0, 1, 0, 1, 1, 1], bool)
    assert L.in_stretches(marks, 2).astype(int).tolist() == [1, 1, 0, 0, 0, 1, 1, 1]
    assert (L.in_stretches(marks, 1) == marks).all() and not L.in_stretches(marks, 4).any() and not len(L.in_stretches(marks[:0], 2))


def test_seed_map_has_every_seed(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS h").repartition(7)
    bits = L.seed_map(rows)
    assert len(bits) == L.BITS and all(bits[r.h % L.BITS] for r in rows.collect()) and bits.sum() <= 5000


def test_isotonic_is_monotone_and_optimal():
    x = np.array([3.0, 1.0, 2.0, 4.0, 5.0])
    y = np.array([1, 1, 3, 2, 3])
    at, fit = R.isotonic(x, y)
    assert list(at) == [1, 2, 3, 4, 5] and (np.diff(fit) >= 0).all() and np.allclose(fit, [1, 2, 2, 2, 3])


def test_quantiles_over_words_are_brute_force():
    rng = np.random.RandomState(2)
    of = np.sort(np.concatenate([np.arange(7), rng.randint(0, 7, 60)]))
    values, words = rng.rand(len(of)).round(1), rng.randint(1, 9, len(of))
    got = R.word_quantiles(values, words, of, 7)
    for t in range(7):
        spread = np.sort(np.repeat(values[of == t], words[of == t]))
        for q, v in zip(R.QUANTILES, got[t]):
            # The value is one around which the share of words lies, up to the words of one sentence.
            assert (spread < v).sum() <= q * len(spread) + 8 and (spread > v).sum() <= (1 - q) * len(spread) + 8


def test_weights_are_fitted():
    """No other weights make the tokens more likely."""
    rng = np.random.RandomState(4)
    grid = np.array([[0.5, 0.1, 0.05, 0.01], [0.0, 0.4, 0.05, 0.01], [0.0, 0.0, 0.2, 0.01], [0.0, 0.0, 0.0, 0.01]])
    w = R.fit_weights(grid, np.array([600.0, 250.0, 120.0, 30.0]), 200)
    like = lambda v: (np.array([600.0, 250.0, 120.0, 30.0]) * np.log(grid @ v)).sum()
    assert abs(w.sum() - 1) < 1e-9
    for _ in range(300):
        other = rng.dirichlet(np.ones(4))
        assert like(w) >= like(other) - 1e-6


def test_edges_are_those_of_the_isotonic_fit(spark):
    """Scores that occur often, runs that fall, levels that never come: as pooling all scores in one place does."""
    rng = np.random.RandomState(6)
    for n, spread, levels in ((400, 30, (1, 2, 3)), (300, 3000, (1, 2, 3)), (50, 10, (1, 2)), (50, 10, (3, 3)), (50, 10, (1, 1)), (1, 5, (2, 2)), (0, 5, (1, 2))):
        x = rng.randint(-spread, spread, n) / 8
        y = np.clip(np.round(2 + x / spread * 8 + rng.randn(n)), levels[0], levels[-1]).astype(int)
        values, of = np.unique(x, return_inverse=True)
        want = []
        at, fit = R.isotonic(np.array(x), np.bincount(of, y, len(values))[of] / np.bincount(of, minlength=len(values))[of] if n else y)
        for step in (1, 2):
            above = np.flatnonzero(fit >= step + 0.5 - 1e-9)
            want.append(np.inf if not len(above) else -np.inf if above[0] == 0 else (at[above[0] - 1] + at[above[0]]) / 2)
        rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, level int").repartition(3)
        assert R.fit_edges(rows) == want


def test_projection_of_moments_is_ridge_regression():
    rng = np.random.RandomState(8)
    x = rng.randn(200, 33) * rng.rand(33) + 5
    x[:, 4] = 2.7
    y = rng.randint(1, 4, 200)
    rows = np.column_stack([x, y])
    model = R.Levels(np.ones((3, 3, 8)))
    model.fit_projection(sum((R.Moments.of(r) for r in np.split(rows, [1, 50, 130])), R.Moments()))
    x = np.delete(x, 4, axis=1)
    z = (x - x.mean(0)) / x.std(0)
    assert model.slope[4] == 0 and np.allclose(np.delete(model.slope, 4) * x.std(0), np.linalg.solve(z.T @ z + R.RIDGE * np.eye(32), z.T @ (y - y.mean())))


def test_every_labelled_document_counts(spark):
    """More than the 6000 documents that were once the most: words, weights and mapping come from all of them."""
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat('word', id % 3 + 1) AS text", "'en' AS lang")
    letters = docs.selectExpr("doc_id", "translate(text, '123', 'abc') AS text", "lang")
    labels = docs.selectExpr("doc_id", "'r' AS rater", "cast(doc_id % 3 + 1 AS int) AS reading_level")
    labelled = R.labelled_documents(letters, labels)
    parts = {r["part"]: r["count"] for r in labelled.groupBy("part").count().collect()}
    assert sum(parts.values()) == 7000 and min(parts.values()) > 1000
    model = R.fit_levels(labelled)
    assert model.counts[:, 0].sum() == 3 * parts[R.TRAIN]  # one word between two ends each
    assert [model.level(s) for s in model.scores(model.features(["worda", "wordb", "wordc"]))] == [1, 2, 3]


def test_reading_levels_on_held_out_rows(spark, small):
    root = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/reading_labels.parquet")
    held = labels.filter("doc_id % 4 = 0")
    out = R.reading_levels(docs, labels.filter("doc_id % 4 <> 0"))
    sure = held.groupBy("doc_id").agg({"reading_level": "avg", "*": "count"}).toDF("doc_id", "mean", "n").filter("n >= 2 and mean = cast(mean as int)")
    both = out.join(sure, "doc_id").count()
    hits = out.join(sure, "doc_id").filter("reading_level = mean").count()
    assert both > 100 and hits / both > 0.97


def test_reading_levels_odd_rows(spark):
    long = "We wash the cups. " * 20
    docs = spark.createDataFrame([(1, long, "en"), (2, long, None), (3, None, "en"), (4, "short text", "EN"), (5, long, " en_US"), (6, long, "fr"), (7, long, "english")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    assert {r.doc_id for r in R.reading_levels(docs, none).collect()} == {1, 5, 7}
    labels = spark.createDataFrame([(1, "r", 3), (1, None, None), (99, "r", 2)], "doc_id long, rater string, reading_level int")
    assert R.reading_levels(docs, labels).count() == 3
