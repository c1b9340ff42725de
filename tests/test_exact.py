"""Fits and sums that don't depend on partitions, refits of resamplings, and fits that go on after a loss."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.operators import exact, fits
from thermalake.sources import versions


def overlapping(spark, n=1200):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal([0, 0], [1, 0.7], (n // 2, 2)), rng.normal([2.5, 1.5], [0.6, 1], (n // 3, 2)), rng.normal([-1, 3], [0.8, 0.5], (n // 6, 2))])
    x[::10] = x[0]  # rows that repeat
    rows = [tuple(map(float, r)) for r in x]
    return x, spark.createDataFrame([*rows, (None, 1.0)], "a double, b double")


@pytest.mark.parametrize("values", [[1e16, 1.0, -1e16, 3e-300, 5e-324], [0.1] * 1000 + [1e9, -1e9], [1e300, 1e300, -1e300], [-2.5, 7e-12, 3.0]])
def test_sums_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    whole = float(sum(map(Fraction, values)))
    apart: dict = {}
    for place, digits in exact.taken_apart(np.array(values)):
        apart[place] = apart.get(place, 0) + int(digits.sum())
    assert exact.put_together([{"at": 0, "place": p, "digit": d} for p, d in apart.items()])[0] == whole
    got = {k: exact.exact_sums(df.repartition(k), {"v": F.col("v")})["v"] for k in (1, 3, 7)}
    assert len(set(got.values())) == 1
    assert got[1] == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-30 * max(map(abs, values)))


def test_sums_of_odd_rows(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (2.0, 1.0, None)], "a double, b double, c double")
    got = exact.exact_sums(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})
    assert got["a"] == 3.0 and math.isnan(got["b"]) and got["c"] == 0.0
    assert exact.exact_sums(df.limit(0), {"a": F.col("a")}) == {"a": 0.0}
    blocks = exact.blocked(df, [F.col("a")], size=1)
    assert list(exact.block_sums(blocks, lambda x, n: np.array([x.sum(), np.inf]))[:1]) == [3.0]
    assert math.isnan(exact.block_sums(blocks, lambda x, n: np.array([x.sum(), np.inf]))[1])
    assert exact.block_sums(exact.blocked(df.limit(0), [F.col("a")]), lambda x, n: x.sum(0)).size == 0


def test_kept_blocks_give_the_sums_of_the_table(spark, monkeypatch):
    """Passes over kept blocks plan no query, have no more tasks than blocks or cores, and add up to the last bit whether tasks or the driver join them."""
    df = spark.range(30_000).select((F.rand(3) - 0.5).alias("a"), F.when(F.col("id") % 7 > 0, F.exp(F.randn(4) * 9)).alias("b"))
    blocks = exact.blocked(df, [F.col("a"), F.col("b")], size=400)
    step = lambda x, n: np.r_[n.sum(), n @ x, n @ x**2, np.inf if x[:, 0].max() > 0.4999 else 1.0]
    held = exact.kept(blocks)
    assert held.getNumPartitions() == spark.sparkContext.defaultParallelism and exact.kept(exact.blocked(df.limit(9), [F.col("a")])).getNumPartitions() == 1
    one = exact.block_sums(held, step)
    monkeypatch.setattr(exact, "_FEW_TASKS", 1)
    assert one.tobytes() == exact.block_sums(held, step).tobytes() == exact.block_sums(blocks, step).tobytes() and one[0] > 25_000
    assert exact.block_sums(exact.kept(exact.blocked(df.limit(0), [F.col("a")])), lambda x, n: x.sum(0)).size == 0


def bits(model):
    return [model[k].tobytes() for k in ("weight", "mean", "covariance")] + [model["loglik"], model["rounds"], str(model["attempts"])]


def test_a_mixture_is_the_same_to_the_last_bit_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", 100)
    _, df = overlapping(spark)
    columns = [F.col("a"), F.col("b")]
    models = [fits.mixture(df.repartition(k), columns, 3, starts=3, tol=1e-5) for k in (3, 8, 13)]
    assert bits(models[0]) == bits(models[1]) == bits(models[2])
    wide = [F.col("a") * (i + 1) + F.col("b") * F.col("b") * 0.1 * i for i in range(10)]
    grams = [fits.gram(df.repartition(k), wide, F.lit(1.0)) for k in (3, 8, 13)]
    assert (grams[0] == grams[1]).all() and (grams[0] == grams[2]).all()
    lines = [fits.fit_polynomial(df.repartition(k), [F.col("a")], F.col("b"), degree=2) for k in (3, 8, 13)]
    assert lines[0] == lines[1] == lines[2]


def test_sweeps_share_passes_and_equal_single_fits(spark):
    _, df = overlapping(spark, 600)
    columns = [F.col("a"), F.col("b")]
    both = fits.mixtures(df, columns, [1, 2], starts=2)
    assert bits(both[2]) == bits(fits.mixture(df, columns, 2, starts=2))
    got = fits.candidates(df, columns, (1, 2), least_rows=50, starts=2, held_out=df.filter("a > -1"))
    assert [sum(c["rows"]) for c in got] == [c["n"] for c in got] == [df.filter("a > -1 AND b IS NOT NULL").count()] * 2
    with pytest.raises(ValueError, match="per component"):
        fits.candidates(df, columns, (2,), least_rows=400)
    with pytest.raises(ValueError, match="a component of 2"):
        fits.candidates(df, columns, (2,), least_rows=150, starts=2, held_out=df.filter("a < 1.2"))


def test_a_fit_goes_on_where_it_was_cut_off(spark, tmp_path, monkeypatch):
    _, df = overlapping(spark, 600)
    columns, settings = [F.col("a"), F.col("b")], {"starts": 2, "tol": 1e-7}
    whole = fits.mixtures(df, columns, [2, 3], **settings)
    keeper = fits.Keeper(spark, str(tmp_path / "states"), every=2)
    passes, plain = [], fits.block_sums

    def counted(blocks, reduce, stop=None):
        passes.append(1)
        if stop is not None and len(passes) > stop:
            raise ConnectionError("the driver is lost")
        return plain(blocks, reduce)

    monkeypatch.setattr(fits, "block_sums", lambda b, r: counted(b, r, stop=11))
    with pytest.raises(ConnectionError):
        fits.mixtures(df, columns, [2, 3], keep=keeper, **settings)
    passes.clear()
    monkeypatch.setattr(fits, "block_sums", counted)
    again = fits.mixtures(df.repartition(6), columns, [2, 3], keep=keeper, **settings)
    assert {k: bits(m) for k, m in again.items()} == {k: bits(m) for k, m in whole.items()}
    rounds = max(a["rounds"] for m in whole.values() for a in m["attempts"])
    assert len(passes) == 2 + rounds - 8  # 9 rounds ended before the loss, of which 8 were stored
    passes.clear()
    assert bits(fits.mixtures(df, columns, [2, 3], keep=keeper, **settings)[3]) == bits(whole[3]) and len(passes) == 2
    other = fits.mixtures(df.filter("a > 0"), columns, [2, 3], keep=keeper, **settings)
    assert other[2]["n"] != whole[2]["n"]  # a state of other rows is not taken up


def test_refits_against_numpy(spark):
    x, df = overlapping(spark, 600)
    columns = [F.col("a"), F.col("b")]
    base = fits.mixture(df, columns, 3, starts=2)
    order = fits.log_densities(x, base["weight"], base["mean"], base["covariance"])
    labelled = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, order.argmax(1), strict=True)], "a double, b double, label int")
    got = fits.refit_stability(labelled, columns, F.col("label"), 3, replicates=3, starts=2, seed=5, tol=1e-7)
    assert [g["replicate"] for g in got] == [0, 1, 2]
    different, counts = np.unique(x, axis=0, return_counts=True)
    models = fits.refits(labelled.repartition(7), columns, 3, 3, seed=5, starts=2, tol=1e-7)
    for r, (g, m) in enumerate(zip(got, models, strict=True)):
        drawn = fits.resampling_counts(different, counts.astype(float), 5, r)
        # a plain round of expectation maximisation over the drawn rows leaves the model where it is
        rows = np.repeat(different, drawn.astype(int), axis=0)
        logs = fits.log_densities(rows, m["weight"], m["mean"], m["covariance"])
        share = np.exp(logs - np.log(np.exp(logs).sum(1))[:, None])
        assert share.sum(0) / len(rows) == pytest.approx(m["weight"], abs=2e-3) and share.T @ rows / share.sum(0)[:, None] == pytest.approx(m["mean"], abs=5e-3)
        own, other = order.argmax(1), fits.log_densities(x, m["weight"], m["mean"], m["covariance"]).argmax(1)
        same = lambda a: a[:, None] == a[None, :]
        i = np.triu_indices(len(x), 1)
        p, q = same(own)[i], same(other)[i]
        both, first, second, every = (p & q).sum(), p.sum(), q.sum(), len(p)
        assert g["ari"] == pytest.approx((both - first * second / every) / ((first + second) / 2 - first * second / every))
        import itertools

        sets = lambda a: [set(np.flatnonzero(a == c)) for c in range(3)]
        jaccard = [[len(s & t) / max(len(s | t), 1) for t in sets(other)] for s in sets(own)]
        best = max(itertools.permutations(range(3)), key=lambda p: sum(jaccard[c][p[c]] for c in range(3)))
        assert g["jaccard"] == pytest.approx([jaccard[c][best[c]] for c in range(3)]) and g["least"] == min(g["jaccard"])


def test_labels_permuted_and_absent():
    table = np.array([[0, 2, 0], [2, 0, 0], [0, 0, 0]], float)
    assert fits.rand_index(table) == 1.0 and fits.matched_jaccard(table) == [1.0, 1.0, None]
    counts = fits.resampling_counts(np.random.default_rng(1).normal(size=(20_000, 2)), np.ones(20_000), 3, 0)
    assert counts.mean() == pytest.approx(1, abs=0.03) and counts.var() == pytest.approx(1, abs=0.06)
    many = fits.resampling_counts(np.random.default_rng(2).normal(size=(20_000, 2)), np.full(20_000, 400.0), 3, 0)
    assert many.mean() == pytest.approx(400, abs=1) and many.std() == pytest.approx(20, abs=0.5)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path)
    versions.publish_table(spark.range(3).coalesce(1), path)
    old = versions.read_table(spark, path)

    def fails(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, fails)
    assert versions.read_table(spark, path).count() == 3 and len(list((tmp_path / "out").glob("version-*"))) == 1

    def overtaken(folder):
        spark.range(7).write.parquet(folder)
        versions.publish_table(spark.range(5), path)

    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, overtaken)
    assert versions.read_table(spark, path).count() == 5 and old.count() == 3  # who began on the old version still reads it
    assert versions.prune(spark, path, keep=1) == 1 and versions.read_table(spark, path).count() == 5
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|FileNotFound"):
        old.count()
