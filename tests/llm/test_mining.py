import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.llm import mining

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [NAN] * 8, 1), (9003, [INF] + [1.0] * 7, 1), (9004, [None] + [1.0] * 7, 1), (9050, [0.0] * 8, 2), (9006, [], 1), (9100, [1.0, 2.0], 3), (9101, [1.0, 2.0], 3), (9102, [1.0, 0.5], 4), (9007, [1e300] * 8, 1)]


def sample(n=500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(size=8) * 0.6
        rows.append((i, [float(x) for x in v.astype(np.float32)], None if i % 97 == 5 else int(i % 12) % 10))
    rows += [(3000 + i, rows[0][1], i % 3) for i in range(150)]  # one vector many times, under three labels
    return rows + ODD


def brute(rows, least=50, most=95):
    held = []
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e6:
            held.append((i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, own in held:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label) for i, y, label in held if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == own][:5]:
            wrong = [r for r in scored if r[2] != own and -50 * s <= -100 * r[0] <= -95 * s][:3]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(wrong)]
    return sorted(out)


@pytest.mark.parametrize("block, bands, anchors", [(2048, 64, 512), (60, 4, 3)])
def test_against_brute_force(spark, monkeypatch, block, bands, anchors):
    for name, value in (("BLOCK", block), ("BANDS", bands), ("ANCHORS", anchors), ("SAMPLE", 100)):
        monkeypatch.setattr(mining, name, value)
    rows = sample()
    table = spark.createDataFrame([*rows, rows[3], (None, rows[3][1], 1)], "vec_id long, embedding array<float>, label int").withColumns({"band": F.lit("x"), "score": F.lit(7), "side": F.lit(1)})
    got = sorted(tuple(r) for r in mining.hard_negatives(table, F.col("vec_id") % 50 == 0).collect())
    want = brute(rows)
    assert got == want and len(want) > 60


def test_large_numbers_and_no_rows(spark):
    rows = [(i, [float(1 << 20) * (i // 5 % 5 + 1), 3.0, float(i)], i % 3) for i in range(0, 200, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = []
    held = [(i, [int(256 * x) for x in v], (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    for a, x, own in held:
        if a % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), i, c) for i, y, c in held if i != a)
            for s, p, _ in [r for r in scored if r[2] == own][:5]:
                want += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate([r for r in scored if r[2] != own and -50 * s <= -100 * r[0] <= -95 * s][:3])]
    got = sorted(tuple(r) for r in mining.hard_negatives(table, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(want) and want
    assert mining.hard_negatives(table.limit(0), F.lit(True)).count() == 0
    assert mining.hard_negatives(table, F.lit(False)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (400, 12))
    pivots = mining.Pivots(x[:100], float((x**2).sum(1).max()))
    away = pivots.distances(pivots.lengthened(x))
    pivot = away.argmin(1)
    key = away[np.arange(400), pivot]
    low, high = pivots.scores(x[:50], pivot, key, key)
    true = x[:50] @ x.T
    assert (low <= true).all() and (true <= high).all()
    assert (mining.products(x, x) == x @ x.T).all()
