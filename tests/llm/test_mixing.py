import numpy as np
import pytest

from thermalake.llm import mixing


CLASHES = ("row", "rows", "taken", "text_hash", "_id", "_hash", "_of", "_at", "_copies", "_copy", "_text_hash", "source_size", "whole", "pi", "tie", "blocks", "block")


def brute_targets(sizes, share=1.5):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(spark, n=3000):
    rng = np.random.default_rng(7)
    names = ["a", "b", "é", "z", "zz", None, "tiny"]
    rows = [(int(i), "w " * int(rng.integers(0, 60)), names[min(int(rng.integers(0, 18)) // 3, 5)]) for i in range(n)]
    rows += [(n, "one", "tiny"), (n + 1, "long " * 4000, "a"), (None, "x y", "b"), (5, "w w", "a"), (5, "w w", "a"), (n + 2, None, "void"), (n + 3, "", "void")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' AS size", "2 AS copies", "0 AS target", *[f"7 AS {c}" for c in CLASHES])


def test_targets_and_takes(spark):
    rows, docs = corpus(spark)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    targets = {r.source: r for r in mixing.source_targets(docs.selectExpr("source", "size(filter(split(coalesce(text, ''), ' '), x -> x <> '')) AS size", "1L AS rows")).collect()}
    assert {s: r.target for s, r in targets.items()} == pytest.approx(want)
    got = mixing.mix_sources(docs, block=64).collect()
    again = mixing.mix_sources(docs.repartition(7), block=64).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    by_target = {}
    for r in got:
        assert r.copies in (0, 1, 2)
        by_target.setdefault((r.target, r.source_size), [0, r])[0] += r["size"] * r.copies
    for (target, _), (taken, _) in by_target.items():
        assert abs(taken - target) <= max(8, 0.01 * target)
    mixed = mixing.mixed_documents(docs, block=64)
    assert mixed.columns == docs.columns
    words = mixed.select('text').selectExpr("sum(size(filter(split(coalesce(text, ''), ' '), x -> x <> '')))").first()[0]
    assert words == sum(r["size"] * r.copies for r in got)
    clashing = mixed.select(*CLASHES).distinct().collect()
    assert [tuple(r) for r in clashing] == [(7,) * len(CLASHES)]
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).columns == docs.columns


def test_rows_that_repeat(spark):
    """A third of all rows are one row: it flies once, and its copies are shared evenly."""
    rows = [(i, "w " * (i % 9), "a") for i in range(6000)] + [(7, "v v v", "a")] * 3000 + [(8, "u u", "b")] * 10_000 + [(9, "only", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    units = mixing.mixed_units(docs)
    assert units.count() == 6003
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for doc, n, size in ((7, 3000, 3), (8, 10_000, 2)):
        copies = [r.copies for r in got if r.doc_id == doc and r["size"] == size]
        assert len(copies) == n and max(copies) - min(copies) <= 1 and max(copies) <= 2
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        assert sum(r["size"] * r.copies for r in own) == pytest.approx(own[0].target, abs=10)
    mixed = mixing.mixed_documents(docs)
    assert mixed.filter("doc_id = 8 AND text = 'u u'").count() == sum(r.copies for r in got if r.doc_id == 8 and r["size"] == 2)
    assert mixed.count() == sum(r.copies for r in got)


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(2)
    size = rng.integers(0, 500, 5000).astype(float)
    pi = mixing.fly(np.full(5000, 0.37), size, rng)
    assert ((pi > 0) & (pi < 1)).sum() <= 2
    assert pi.sum() == pytest.approx(0.37 * 5000) and pi @ size == pytest.approx(0.37 * size.sum())
    draws = np.mean([mixing.fly(np.full(9, 0.37), np.arange(9.0), np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(draws - 0.37).max() < 0.04
    assert set(mixing.land(np.array([1, 0.5, 0.5]), np.array([9.0, 4, 7]), 15.9)) <= {0.0, 1.0}
