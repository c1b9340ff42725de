import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from thermalake.llm import brownlm, queries


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def brute(rows):
    train = [words(t) for d, t in rows if crc32(str("" if d is None else d).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    n, v, end = sum(count.values()) + len(train), len(count) + bool(train), len(train)
    out = {}
    for d, t in rows:
        own = words(t)
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(count[w] for w in own), end])
        out[d] = (len(own) + 1, sum(count[w] > 0 for w in own) + (end > 0), n, base)
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 1)


def test_base_counts_with_a_small_lexicon(spark, monkeypatch):
    monkeypatch.setattr(brownlm, "LEXICON", 30)
    rng = np.random.default_rng(9)
    vocabulary = ["the", "The", "of", *[f"w{i}" for i in range(300)]]
    rows = [(i, " ".join(vocabulary[int(k)] for k in rng.zipf(1.4, 40) % 303)) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "é É 日本 x, y."), (None, "the null id"), (903, "the " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "3 AS n", "1 AS row")
    out = (brownlm.fold_of("doc_id", 5) == 1).alias("held_out")
    for lexicon in (30, 100_000):
        model = brownlm.learn(docs.filter(~out), lexicon=lexicon, units=20, n_classes=6)
        scored = brownlm.score(docs, model).selectExpr("*", f"{model.n_tokens}L AS train_tokens")
        check(scored.select("*", out).collect(), rows)
    again = brownlm.score(docs.unionByName(docs), model)
    assert again.count() == 2 * len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert brownlm.held_out_scores(docs.limit(0)).count() == 0
    row = brownlm.score(docs, brownlm.learn(docs.limit(0))).first()
    assert row.n_known == 0 and row.base_score == pytest.approx(0) and row.score < 0


def test_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "b a c c", "a", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = brownlm.learn(docs, lexicon=100, units=2, n_classes=3)
    assert np.allclose((10**model.transition).sum(1), 1)
    lookup = model.lookup.value
    by_class = Counter()
    for word, at in lookup.items():
        by_class[model.place_class[at]] += 10 ** (model.log_count[at] - model.emission[model.place_class[at]])
    for c, mass in by_class.items():
        assert mass + 0.5 / 10 ** model.emission[c] == pytest.approx(1)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    left, right = list(range(1, 11)), list(range(11, 21))
    pairs = np.zeros((21, 21), int)
    for _ in range(4000):
        a, b = rng.choice(left), rng.choice(right)
        pairs[a, b] += 1
        pairs[b, rng.choice(left)] += 1
    classes = brownlm.exchange(pairs, 6, 10)
    assert not {classes[i] for i in left} & {classes[i] for i in right}
    assert classes[0] == 0 and 0 not in classes[1:]


def test_words_beyond_the_first_units_are_exchanged(spark):
    rng = np.random.default_rng(5)
    left, right = [f"a{i:03d}x" for i in range(60)], [f"b{i:03d}x" for i in range(60)]  # of one shape
    pick = lambda side: side[min(int(rng.zipf(1.3)), 10**6) % 60]
    texts = [" ".join(pick(side) for _ in range(20) for side in (left, right)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    model = brownlm.learn(docs, lexicon=1000, units=6, n_classes=6)
    lookup = model.lookup.value
    classes = lambda side: {int(model.place_class[lookup[w.encode()]]) for w in side if w.encode() in lookup}
    assert len(lookup) > 100
    assert not classes(left) & classes(right)


def test_sweeps_choose_as_the_exchange_does():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(0.7, (40, 40)).astype(float)
    own = np.r_[0, rng.integers(1, 5, 39)]
    member = np.eye(5)[own]
    beside = np.concatenate([(member.T @ pairs).T, pairs @ member, np.diagonal(pairs)[:, None]], 1)[1:]
    got = brownlm.best_classes(beside, own[1:], member.T @ pairs @ member)
    for u in range(1, 40):
        levels = []
        for c in range(1, 5):
            other = np.eye(5)[np.where(np.arange(40) == u, c, own)]
            levels.append(brownlm.level(other.T @ pairs @ other))
        assert levels[got[u - 1] - 1] == pytest.approx(max(levels), abs=1e-6)


def test_encoded_rows_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(brownlm, "_RUN", 4)
    docs = spark.createDataFrame([("a b a b c a a",), ("",), (None,), ("b",), ("c c c c c c",)], "text string").coalesce(1)
    lookup = spark.sparkContext.broadcast(brownlm.Lookup({b"a": 0, b"b": 1, b"c": 2}))
    units = np.r_[1, 2, 3, np.full(brownlm.SHAPES, 4)]
    got = brownlm.count_unit_pairs(brownlm.encode(docs, lookup), units, 5)
    want = np.zeros((5, 5), int)
    for text in ([1, 2, 1, 2, 3, 1, 1], [], [], [2], [3] * 6):
        for a, b in zip([0, *text], [*text, 0], strict=True):
            want[a, b] += 1
    assert (got == want).all()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op9_lm_brown_classes(spark, sf).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_scores(texts, train, model, n_classes):
    """Class bigram log probabilities of texts, from counts of the training texts under the model's classes."""
    lookup = model.lookup.value
    place = lambda w: lookup[w] if w in lookup else len(lookup) + brownlm.shape(w)
    cls = lambda w: int(model.place_class[place(w)])
    table, count = np.zeros((n_classes, n_classes)), Counter()
    for t in train:
        own = [0, *map(cls, words(t)), 0]
        for a, b in zip(own, own[1:], strict=False):
            table[a, b] += 1
        count.update(words(t))
    types = Counter(map(cls, count))
    out = []
    for t in texts:
        own, total = [0, *map(cls, words(t)), 0], 0.0
        for a, b in zip(own, own[1:], strict=False):
            share = (table[:, b].sum() + 0.5) / (table.sum() + 0.5 * n_classes)
            total += math.log10((table[a, b] + n_classes * share) / (table[a].sum() + n_classes))
        for w in words(t):
            total += math.log10((count[w] + 0.5) / (table[:, cls(w)].sum() + 0.5 * (types[cls(w)] + 1)))
        out.append(total)  # the end is all of its class
    return out


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(120)] + ["end.", "a,", "12", "Longer-Words"]
    train = [" ".join(vocabulary[int(k) % 124] for k in rng.zipf(1.3, 30)) for _ in range(150)] + ["", None]
    texts = [*train[:20], "never seen words. w1", "W1 w1 unseen!", None, " \n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for lexicon in (40, 10_000):
        model = brownlm.learn(spark.createDataFrame([(t,) for t in train], "text string"), lexicon=lexicon, units=12, n_classes=7)
        got = {r.doc_id: r.score for r in brownlm.score(docs, model).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts, train, model, 7))


def test_words_seen_once_fill_the_lexicon(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(50)),) for i in range(60)], "text string")
    model = brownlm.learn(docs, lexicon=1000, units=20, n_classes=6)
    assert 850 < len(model.lookup.value) < 1150
