import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermalake.llm import ann, embdedup
from thermalake.llm.tiles import Quantised, tile_product

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, "a"), (9002, [0.0] * 16, "a"), (9003, [NAN] + [1.0] * 15, "a"), (9004, [INF] + [1.0] * 15, "a"), (9005, [None] + [1.0] * 15, "a"), (9006, [], "a"), (9007, [1.0, 2.0], "a"), (9008, [1.0, 2.1], "a")]


def sample(spark, n=700):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(0, 60)] + rng.normal(size=16) * 0.25
        rows.append((i, [float(x) for x in v.astype(np.float32)], ["a", "b", None][min(int(rng.integers(0, 5)) // 2, 2)]))
    rows += [(1000 + i, rows[0][1], "a") for i in range(150)] + ODD
    table = spark.createDataFrame([*rows, rows[3], (None, rows[3][1], "a")], "vec_id long, embedding array<float>, label string")
    return rows, table.withColumns({"dim": F.lit("x"), "side": F.lit(7), "links": F.lit(1)})


def good(v):
    return v is not None and None not in v and np.isfinite(v).all() and np.any(v)


def test_links_against_brute_force(spark):
    rows, table = sample(spark)
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    for i, a, la in rows:
        for j, b, lb in rows:
            if i < j and la == lb is not None and good(a) and good(b) and len(a) == len(b):
                if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    low = {i: i for i in ids}
    for _ in ids:
        new = {i: min([low[i], *[low[j] for j in links[i]]]) for i in ids}
        if new == low:
            break
        low = new
    got = sorted(tuple(r) for r in embdedup.near_duplicates(table, block=100).filter("vec_id IS NOT NULL").collect())
    assert got == sorted((i, len(links[i]), low[i], low[i] == i) for i in ids)
    assert [tuple(r) for r in embdedup.near_duplicates(table).filter("vec_id IS NULL").collect()] == [(None, 0, None, True)]
    assert embdedup.near_duplicates(table.limit(0)).count() == 0


def test_short_lists_stream_past_their_query(spark):
    """No task gathers a query's lists: the merge holds the k best so far, whatever the lists and the batches are cut into."""
    _, table = sample(spark, 60)
    plan = ann.nearest(table, F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
    rng = np.random.default_rng(7)
    rows = [(int(q), int(v), float(rng.integers(0, 40))) for q in (0, 20, 60) for v in rng.permutation(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 700], strict=True)], names=["query_id", "vec_id", "score"]) for at in range(0, len(rows), 700)]
    got = [tuple(r.values()) for b in ann.merged(iter(batches), 7) for r in b.to_pylist()]
    best = {q: sorted(((-s, v) for p, v, s in rows if p == q))[:7] for q in (0, 20, 60)}
    assert got == [(q, n + 1, v, -s) for q, found in best.items() for n, (s, v) in enumerate(found)]


def test_nearest_against_brute_force(spark, monkeypatch):
    rows, table = sample(spark)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(ann, "MERGED", 3)
    held = {i: np.array(v, float) for i, v, _ in rows if good(v)}
    want = []
    for q, x in held.items():
        if q % 20 == 0:
            scores = sorted((-(x * y).cumsum()[-1], i) for i, y in held.items() if i != q and len(y) == len(x))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])]
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(table.filter("vec_id IN (0, 1, 9007)"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 1)]


@pytest.mark.parametrize("dim", [1, 64, 1500])
def test_bounds_are_rigorous(dim):
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(40, dim)) * 1e3, rng.standard_cauchy(size=(50, dim))
    near, bound = tile_product(Quantised(a), Quantised(b))
    assert (np.abs(near - a @ b.T) <= bound).all()


def test_vectors_of_extreme_size(spark):
    rows = [(i, [s * x for x in (1.0, 2.0, 3.0)], "a") for i, s in enumerate((1e200, 2e200, 1e-200, 3e-310, 1.0))] + [(9, [0.0, 0.0, 1e200], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embdedup.near_duplicates(table).collect()) == [(i, 4, 0, i == 0) for i in range(5)] + [(9, 0, 9, True)]
    got = ann.nearest(table, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 9, 4, 2, 3] and got[0].score == INF


@pytest.mark.parametrize("operator", ["dedup", "nearest"])
def test_dense_groups_of_long_vectors_stay_within_memory(operator):
    """One tile of near copies at 1,024 dimensions: the arrays that are alive at once stay below 1 GB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, dim = (1024, 1024) if operator == "dedup" else (700, 1024)
    rows = (rng.normal(size=dim) + rng.normal(size=(n, dim)) * 1e-3).astype(np.float32)
    if operator == "nearest":
        rows[:] = rows[0]
    side = np.zeros(n, np.int32) if operator == "dedup" else (np.arange(n) >= 100).astype(np.int32)
    table = pa.table({"vec_id": np.arange(n), "side": side, "dim": np.full(n, dim), "j": np.zeros(n, np.int32), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float32()))})
    tracemalloc.start()
    out = embdedup.tile_links(table, 0.93) if operator == "dedup" else ann.tile_nearest(table, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    if operator == "dedup":
        assert out["links"].to_pylist() == [n - 1] * n and set(out["low"].to_pylist()) == {0}
    else:
        assert out["vec_id"].to_pylist() == list(range(100, 120)) * 100
