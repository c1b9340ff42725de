import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalake.operators import fits, labelers


def features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, float("inf"), 0.0, 0.0)]
    return x, spark.createDataFrame(rows, "id int, a double, b double, c double")


def test_labelers_agree_and_leave_incomplete_rows_unlabelled(spark):
    x, df = features(spark)
    rng = np.random.default_rng(3)
    weight, mean = np.array([0.5, 0.2, 0.3]), rng.normal(size=(3, 3))
    root = rng.normal(size=(3, 3, 3))
    cov = root @ root.transpose(0, 2, 1) + np.eye(3)
    model = labelers.ModelLabeler(lambda b: fits.log_densities(b, weight, mean, cov).argmax(1), 3)
    got = labelers.labelled(df, [F.col(c) for c in "abc"], {"e": labelers.MixtureLabeler(weight, mean, cov), "m": model}).collect()
    want = fits.log_densities(x, weight, mean, cov).argmax(1)
    assert all(r.e == r.m == (want[r.id] if r.id < 900 else None) for r in got) and len(got) == 503
    assert labelers.labelled(df.limit(0), [F.col("a")], {"m": model}).count() == 0


def test_a_label_is_made_once_however_often_it_is_named(spark):
    _, df = features(spark)
    labeler = labelers.MixtureLabeler(np.full(3, 1 / 3), np.eye(3), np.stack([np.eye(3)] * 3))
    label = F.col("e")
    used = labelers.labelled(df, [F.col(c) for c in "abc"], {"e": labeler}).select("id", F.when(label.between(0, 2), label).alias("known")).na.drop()
    # three for the density and three for the shares; as one expression there were dozens, and code past the virtual machine's 64 KB
    assert used._jdf.queryExecution().optimizedPlan().toString().count("EXP(") == 6
    assert used.count() == 500


@pytest.mark.parametrize(
    "predict, message",
    [(lambda b: np.zeros(len(b)), "not whole numbers"), (lambda b: np.full(len(b), 3), "outside 0 to 2"), (lambda b: np.full(len(b), -1), "outside"), (lambda b: np.zeros(1, int), "shape"), (lambda b: b.fill(0), "read-only")],
)
def test_the_contract_of_batches_is_checked(spark, predict, message):
    _, df = features(spark)
    with pytest.raises(Exception, match=message):
        labelers.labelled(df, [F.col("a"), F.col("b")], {"m": labelers.ModelLabeler(predict, 3, "bad")}).agg(F.sum("m")).collect()
