"""Readers, writers and model tables, and that they fail loudly."""

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thermalake.operators import fits
from thermalake.sources import models, records, tables

NAN = float("nan")


def test_shape_libraries_are_checked(spark, tmp_path):
    path = str(tmp_path / "shapes")
    rows = [(s, c, [-0.1 * s]) for s in range(3) for c in ("a", "b")]
    write = lambda r, form="linear": models.write_shapes(spark.createDataFrame(r, "scene int, channel string, parameters array<double>"), path, form, seed=1)
    read = lambda **wanted: models.read_shapes(spark, path, 3, ["a", "b"], **wanted)
    write(rows)
    got = {(r.scene, r.channel): r for r in read(seed=1).collect()}
    assert len(got) == 6 and got[0, "a"].integral == pytest.approx(1) and got[2, "b"].parameters == [-0.2]
    with pytest.raises(ValueError):
        read(seed=2)
    for bad in (rows[:-1], [*rows, (3, "a", [0.0])], [*rows[:-1], rows[0]], [*rows[:-1], (2, "b", [NAN])], [*rows[:-1], (2, "b", [9.0])], [*rows[:-1], (2, "b", [0.1, 0.1])]):
        write(bad)
        with pytest.raises(ValueError):
            read()
    write([(s, c, [0.1, 0.05]) for s, c, _ in rows], "quadratic")
    assert read(form="quadratic").count() == 6
    with pytest.raises(ValueError):
        read()


def test_polynomials_and_mixtures_are_stored(spark, tmp_path):
    fit = fits.Polynomial((250.0, 260.0), (10.0, 12.0), 2, 1.5, (1.0, 2.0, 3.0, 4.0, 5.0))
    models.write_polynomial(spark, fit, str(tmp_path / "p"), form="x")
    assert models.read_polynomial(spark, str(tmp_path / "p"), 2, form="x") == fit
    for values, wanted in ((3, {}), (2, {"form": "y"}), (2, {"degree": 3})):
        with pytest.raises(ValueError):
            models.read_polynomial(spark, str(tmp_path / "p"), values, **wanted)
    model = {"weight": np.array([0.25, 0.75]), "mean": np.array([[0.0, 1.0], [2.0, 3.0]]), "covariance": np.array([[[2.0, 0.5], [0.5, 1.0]], [[1.0, 0.0], [0.0, 3.0]]])}
    models.write_mixture(spark, model, str(tmp_path / "m"))
    got = models.read_mixture(spark, str(tmp_path / "m"), 2)
    for c, cov in zip(got["components"], model["covariance"], strict=True):
        u = np.array(c["precision_cholesky"])
        assert np.allclose(u, np.triu(u)) and np.allclose(u @ u.T, np.linalg.inv(cov))
    for change in ({"weight": np.array([0.5, 0.6])}, {"covariance": -model["covariance"]}):
        models.write_mixture(spark, model | change, str(tmp_path / "m"))
        with pytest.raises(ValueError):
            models.read_mixture(spark, str(tmp_path / "m"), 2)


def test_a_model_is_fitted_once(spark, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return spark.createDataFrame([(1,)], "x int")

    read = lambda: len(calls)
    for about, n in (({"seed": 1}, 1), ({"seed": 1}, 1), ({"seed": 2}, 2)):
        assert models.stored_or_fitted(spark, str(tmp_path / "once"), fit, read, **about) == n


def test_records_and_diagnostics(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"identity": {"a": 1},\n "value": 2}')
    assert records.record(spark, str(tmp_path / "r.json"), {"a": 1})["value"] == 2
    with pytest.raises(ValueError, match="a"):
        records.record(spark, str(tmp_path / "r.json"), {"a": 2})
    (tmp_path / "d.csv").write_text("n_components,rmse,note\n6,0.5,fine\n7,,0.25\n")
    assert [tuple(r) for r in records.diagnostics(spark, str(tmp_path / "d.csv")).orderBy("n_components").collect()] == [(6, 0.5, None), (7, None, 0.25)]
    (tmp_path / "e.csv").write_text("n_components,rmse\n6,0.5\n6,0.4\n")
    with pytest.raises(PySparkException):
        records.diagnostics(spark, str(tmp_path / "e.csv")).collect()
    (tmp_path / "f.csv").write_text("scenario,mode,stage,degree,scene_index,regime,abi_scene,fold,weight,truth,residual\ns,goal,x,three,1,clear,0,0,1,1,1\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        records.residuals(spark, str(tmp_path / "f.csv")).collect()


def test_products_keep_units_and_counts(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("y"), (F.col("id") * 1.0).alias("flux_g16"), F.lit(270.0).alias("bt_14"))
    records.write_product(df, str(tmp_path / "p"), {"day": 246}, ["y"])
    got, about, units = records.read_product(spark, str(tmp_path / "p"))
    assert got.count() == 200 and about == {"day": 246} and units == {"flux_g16": "W m-2", "bt_14": "K"}
    assert records.write_counted(df, str(tmp_path / "c")) == 200
    assert records.replayed(spark, str(tmp_path / "c"), 200, df.columns).count() == 200
    for bad in (lambda: records.write_counted(df.limit(99), str(tmp_path / "c")), lambda: records.replayed(spark, str(tmp_path / "c"), 199, df.columns), lambda: records.replayed(spark, str(tmp_path / "c"), 200, ["y"])):
        with pytest.raises(ValueError):
            bad()
    records.atomically(spark, str(tmp_path / "a"), lambda p: df.write.parquet(p))
    records.atomically(spark, str(tmp_path / "a"), lambda p: df.limit(3).write.parquet(p))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    with pytest.raises(ZeroDivisionError):
        records.atomically(spark, str(tmp_path / "a"), lambda p: 1 // 0)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 200


def test_values_and_groups_are_checked(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (2, 1, 3.0)], "g int, fold int, v double")
    assert records.checked_numbers(df, ["v"]).count() == records.one_fold_each(df, "g", "fold").count() == 3
    for bad in (df.union(spark.createDataFrame([(3, 0, NAN)], df.schema)), df.union(spark.createDataFrame([(3, 0, None)], df.schema))):
        with pytest.raises(PySparkException):
            records.checked_numbers(bad, ["v"]).collect()
    with pytest.raises(PySparkException):
        records.one_fold_each(df.union(spark.createDataFrame([(2, 0, 1.0)], df.schema)), "g", "fold").collect()
    dirty = spark.createDataFrame([((1.0, [NAN, 2.0]),)], "s struct<a: double, b: array<double>>")
    assert tables.finite_numbers(dirty).first().s.b == [None, 2.0]


def test_catalogues(spark):
    paths = spark.createDataFrame([(f"/d/ABI-C{c:02d}_{s}_s2023246.nc",) for s in ("G16", "G18") for c in (8, 11) if (s, c) != ("G18", 11)], "path string")
    missing = records.missing_files(tables.catalogue(paths), ["G16", "G18"], [8, 11], 246)
    assert [tuple(r) for r in missing.collect()] == [("G18", 11)]
    scenes = spark.createDataFrame([("/x/clear_0012.nc",), ("/x/cloud_0012.nc",)], "path string")
    assert {r.id for r in records.paired_scenes(scenes, F.substring_index(F.substring_index("path", "/", -1), "_", 1)).collect()} == {12}
    with pytest.raises(PySparkException):
        records.paired_scenes(spark.createDataFrame([("/x/clear_12a.nc",)], "path string"), F.lit("c")).collect()


def test_pixels_and_paths(spark, tmp_path):
    rows = [(246, 0, 0, "G16", [1.0, NAN], NAN, 3), (246, 1, 5, "G18", [2.0, 3.0], 45.0, None)]
    spark.createDataFrame(rows, tables.PIXELS).write.parquet(str(tmp_path / "px"))
    got = {r.y: r for r in tables.read_pixels(spark, str(tmp_path / "px")).collect()}
    assert got[0].rad == [1.0, None] and got[0].lza is None and got[1].lza == 45.0
    assert tables.product_path("/r/", "Nominal Flux", 7, "G16") == "/r/nominal_flux/day=007/satellite=G16"
    assert tables.row_slabs(23, 10, 4) == [(0, 8), (8, 16), (16, 20)] and tables.row_slabs(20, 7) == [(0, 7), (7, 14), (14, 20)]
