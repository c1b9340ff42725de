import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.operators.variants import Variant, checked_closure, held_out_variants


def cases(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [10, 2] + [250, 5]
    regime = rng.choice(["clear", "cloudy"], n)
    y = 3 * x[:, 0] - x[:, 1] ** 2 + np.where(regime == "clear", 20, -20) + rng.normal(size=n)
    w = rng.random(n) + 0.1
    fold = rng.integers(0, 4, n)
    rare = np.arange(n) % 40 == 0  # a regime of one fold alone
    regime, fold = np.where(rare, "rare", regime), np.where(rare, 2, fold)
    return x, y, w, fold, regime


def test_variants_against_numpy(spark):
    x, y, w, fold, regime = cases()
    rows = [(i, *map(float, a), float(b), float(c), int(f), str(r)) for i, (a, b, c, f, r) in enumerate(zip(x, y, w, fold, regime, strict=True))]
    rows += [(900, None, 1.0, 1.0, 1.0, 0, "clear"), (901, 250.0, 5.0, None, 1.0, 1, "cloudy")]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, w double, fold int, regime string").repartition(5)
    a, b = F.col("a"), F.col("b")
    wanted = [Variant("nominal", [a, b]), Variant("cubic", [a, b], 3), Variant("by regime", [a, b], 2, F.col("regime")), Variant("one input", [a])]
    out = held_out_variants(df, ["id"], wanted, F.col("y"), F.col("w"), F.col("fold"), 4)
    got = {(r.id, r.variant): r for r in out.collect()}
    assert len(got) == len(rows) * 4

    def design(x, degree):
        z = (x - x.mean(0)) / x.std(0)
        terms = [np.ones(len(z))]
        if x.shape[1] == 1:
            return np.column_stack([*terms, z])
        for d in range(1, degree + 1):
            terms += [z[:, 0] ** i * z[:, 1] ** (d - i) for i in range(d + 1)]
        return np.column_stack(terms)

    for name, columns, degree, split in (("nominal", [0, 1], 1, False), ("cubic", [0, 1], 3, False), ("by regime", [0, 1], 2, True), ("one input", [0], 1, False)):
        m = design(x[:, columns], degree)
        for k in range(4):
            for g in ["clear", "cloudy", "rare"] if split else [None]:
                train = (fold != k) & ((regime == g) if split else True)
                test = np.flatnonzero((fold == k) & ((regime == g) if split else True))
                if train.sum() < m.shape[1]:
                    assert all(not got[i, name].supported and got[i, name].prediction is None for i in test)
                    continue
                root = np.sqrt(w[train])[:, None]
                c = np.linalg.lstsq(m[train] * root, y[train] * root[:, 0], rcond=None)[0]
                for i in test:
                    assert got[i, name].prediction == pytest.approx(m[i] @ c, abs=1e-6) and got[i, name].residual == pytest.approx(m[i] @ c - y[i], abs=1e-6)
    assert not any(got[i, "by regime"].supported for i in np.flatnonzero(regime == "rare"))
    assert not got[900, "nominal"].supported and got[901, "nominal"].supported and got[901, "nominal"].residual is None
    again = held_out_variants(df.repartition(11), ["id"], wanted, F.col("y"), F.col("w"), F.col("fold"), 4)
    assert {(r.id, r.variant): r for r in again.collect()} == got
    stored = spark.createDataFrame([(i, got[i, "nominal"].residual) for i in range(240)], "case int, r double").withColumnRenamed("case", "id")
    kept = out.filter("id < 900")
    assert checked_closure(kept, ["id"], "nominal", stored, "r").count() == 960
    for wrong in (stored.withColumn("r", F.col("r") + 1e-3), stored.filter("id > 0"), stored.unionByName(spark.createDataFrame([(777, 0.0)], "id int, r double"))):
        with pytest.raises(ValueError, match="does not close"):
            checked_closure(kept, ["id"], "nominal", wrong, "r")
    assert held_out_variants(df.filter("id = 901"), ["id"], [Variant("v", [F.lit(1.0)])], F.col("w"), F.col("w"), F.col("fold"), 4).first().supported is False
    with pytest.raises(ValueError, match="share a name"):
        held_out_variants(df, ["id"], [wanted[0]] * 2, F.col("y"), F.col("w"), F.col("fold"), 4)
