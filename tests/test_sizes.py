"""What decides how queries grow: who is broadcast, and by what rows are exchanged."""

from thermalake.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_draws_are_made_behind_the_join_with_transitions(spark):
    text = plan(spark, "monte_carlo_transitions")
    assert text.index("Generate explode") < text.index("BroadcastHashJoin")


def test_spectra_are_not_exchanged_by_wavelength(spark):
    for name in ("band_fluxes", "equivalent_radiances", "blackbody_roundtrip"):
        assert "hashpartitioning(_at" not in plan(spark, name), name


def test_views_are_exchanged_before_they_are_copied(spark):
    text = plan(spark, "noisy_geometry")
    assert text.rindex("Generate") < text.index("hashpartitioning(l_orderkey")


def test_rows_of_a_shape_fit_are_not_exchanged_for_its_parameters(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept, seen = DataFrame.groupBy, []
    monkeypatch.setattr(DataFrame, "groupBy", lambda df, *c: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *c))
    registry.queries()["quadratic_shape_library"](spark, SF)
    assert len(seen) > 1 and not any("SortMergeJoin" in p for p in seen)


def test_products_stay_where_rows_are(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from thermalake.operators import exact, fits

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)) * 10.0 ** rng.integers(-3, 4, 12)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(12)))
    columns = [F.col(f"c{i}") for i in range(12)]
    seen = [fits.gram(d, columns, F.lit(1.0)) for d in (df.repartition(7), df.coalesce(1))]
    assert (seen[0] == seen[1]).all()
    one = np.column_stack([np.ones(len(x)), x])
    assert np.allclose(seen[0], one.T @ one, rtol=1e-12, atol=1e-9 * np.outer(*[np.sqrt((one**2).sum(0))] * 2).min())
    assert exact.exact_products(df.filter("c0 IS NULL"), columns, lambda r: [(r, r)]) == []


def test_regressions_exchange_no_rows(spark, monkeypatch):
    from thermalake.operators import exact, fits

    def fail(*_):
        raise AssertionError("rows are exchanged")

    monkeypatch.setattr(exact, "blocked", fail)
    monkeypatch.setattr(fits, "blocked", fail)
    registry.queries()["stored_polynomial"](spark, SF)
    registry.queries()["held_out_variants"](spark, SF)


def test_boxes_of_few_pixels_cost_no_dense_image():
    import numpy as np

    from thermalake.operators import tiles

    y, x = np.array([0, 1, 100_000, 100_000]), np.array([0, 1, 100_000, 99_998])  # a dense piece would have 10^10 places
    (n, mean, sd), (wide, *_) = tiles.box_moments(y, x, np.array([[1.0, 3.0, 5.0, np.nan]]), [1, 2])
    assert n.tolist() == [[2, 2, 1, 0]] and wide.tolist() == [[2, 2, 1, 1]]
    assert np.allclose(mean[0, :3], [2.0, 2.0, 5.0]) and np.allclose(sd[0, :3], [1.0, 1.0, 0.0])


def test_few_and_many_pixels_have_the_same_boxes(monkeypatch):
    import numpy as np

    from thermalake.operators import tiles

    rng = np.random.default_rng(5)
    y, x, values = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.normal(size=(2, 300)) + 1e4
    values[0, ::7] = np.nan
    few = tiles.box_moments(y, x, values, [2, 4])
    monkeypatch.setattr(tiles, "_SPARSE", 0.0)
    for a, b in zip(few, tiles.box_moments(y, x, values, [2, 4]), strict=True):
        assert (a[0] == b[0]).all() and np.allclose(a[1], b[1], equal_nan=True) and np.allclose(a[2], b[2], atol=1e-6, equal_nan=True)


def test_states_of_mixtures_share_their_products():
    import numpy as np

    from thermalake.operators import fits

    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 2)) * 3.0
    for narrow in (1.0, 1e-9):  # the second is too narrow for squares and goes its own way
        states = [(np.array([0.2, 0.3, 0.5]), rng.normal(size=(3, 2)), np.stack([np.array([[1.0, 0.2], [0.2, 0.5]]) * s * narrow for s in (1, 2, 3)])) for _ in range(4)]
        counts = [rng.poisson(1.0, len(x)).astype(float) for _ in states]
        want = np.concatenate([fits.mixture_statistics(x, n, s) for n, s in zip(counts, states, strict=True)])
        assert np.allclose(fits.many_statistics(x, counts, states), want, rtol=1e-9, atol=1e-8)


def test_nearest_of_dense_sources_forms_few_pairs(spark, monkeypatch):
    import numpy as np

    from thermalake.operators import grid

    rng = np.random.default_rng(9)
    sources = [(float(a), float(o), i) for i, (a, o) in enumerate(zip(rng.uniform(-3, 3, 3000), rng.uniform(-3, 3, 3000), strict=True))]
    sources += [(a, o, v + 10_000) for a, o, v in sources[:500]]  # the same places again
    targets = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-9, 9, 200), rng.uniform(-9, 9, 200), strict=True))]
    steps, kept = [], grid.cut
    monkeypatch.setattr(grid, "cut", lambda df: steps.append(1) or kept(df))
    out = grid.nearest_within(spark.createDataFrame(targets, "id long, lat double, lon double"), spark.createDataFrame(sources, "lat double, lon double, v long"), "lat", "lon", "v", 600_000.0)
    got = {r["id"]: r["v"] for r in out.collect()}
    lat, lon = (np.radians(np.array([s[i] for s in sources[:3000]])) for i in (0, 1))
    for i, a, o in targets:
        a, o = np.radians(a), np.radians(o)
        d = 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - o) / 2) ** 2))
        assert got[i] == (int(d.argmin()) if d.min() <= 600_000.0 else None)
    assert steps  # smaller cubes were tried
