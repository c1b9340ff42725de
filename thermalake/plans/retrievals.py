"""Retrieval queries over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import physics
from thermalake.operators import constrained, retrieval, weighted
from thermalake.sources.models import hemisphere
from thermalake.sources.tables import table


def quadratic_shape_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovers two-parameter shapes from the ratios that they make."""
    p, q = (physics.angular_basis(a, True) for a in (F.col("l_quantity") * 1.3, F.col("l_tax") * 800.0))
    b1, b2 = F.when(F.col("l_returnflag") == "A", -0.1).when(F.col("l_returnflag") == "N", -0.25).otherwise(-0.4), F.when(F.col("l_linestatus") == "F", 0.05).otherwise(0.1)
    ratio = (1.0 + b1 * p[0] + b2 * p[1]) / (1.0 + b1 * q[0] + b2 * q[1])
    out = retrieval.quadratic_shapes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], p, q, ratio, hemisphere())
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("b1", "b2", "rmse")])


QUADRATIC = """SELECT l_returnflag, l_linestatus, count(*) AS n, CASE l_returnflag WHEN 'A' THEN -0.1 WHEN 'N' THEN -0.25 ELSE -0.4 END::DOUBLE AS b1,
  CASE l_linestatus WHEN 'F' THEN 0.05 ELSE 0.1 END::DOUBLE AS b2, 0.0::DOUBLE AS rmse FROM lineitem GROUP BY 1, 2"""


def library_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a case, its line items are views under a shape known by flag."""
    b = F.when(F.col("l_returnflag") == "A", -0.1).otherwise(-0.3)
    shape = 1.0 + b * (F.col("l_quantity") / 50.0 - 0.5)
    radiance = F.when(F.col("l_quantity") <= 48, F.col("l_extendedprice") / 1000.0)
    out = retrieval.library_flux(table(spark, sf_dir, "lineitem"), ["l_orderkey"], radiance, shape, F.lit(0.97))
    return out.select("l_orderkey", "views", *[F.round(c, 4).alias(c) for c in ("amplitude", "flux")])


LIBRARY_FLUX = """WITH v AS (SELECT l_orderkey, 1.0 + CASE WHEN l_returnflag = 'A' THEN -0.1 ELSE -0.3 END * (l_quantity / 50.0 - 0.5) AS s, CASE WHEN l_quantity <= 48 THEN l_extendedprice / 1000.0 END AS l FROM lineitem),
a AS (SELECT l_orderkey, count(l) AS views, sum(l * s) / sum(s * s) FILTER (l IS NOT NULL) AS amplitude FROM v GROUP BY 1)
SELECT l_orderkey, views, round(amplitude, 4) AS amplitude, round(pi() * amplitude * 0.97, 4) AS flux FROM a"""

#: The views that each geometry has.
GEOMETRIES = {"all": (1, 2, 3, 4, 5, 6, 7), "clustered": (1, 2, 3), "wide": (1, 4, 7), "single": (2,)}


def geometry_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the retrieval from four subsets of the line numbers as views."""
    df = table(spark, sf_dir, "lineitem").withColumn("basis", F.col("l_quantity") / 50.0 - 1.0)
    out = retrieval.geometry_study(df, "l_orderkey", "l_linenumber", GEOMETRIES, F.col("basis"), 30.0 + 5.0 * F.col("basis") + F.col("l_discount"), 0.1, F.lit(95.0))
    return out.select("geometry", "cases", "unidentifiable", *[F.round(c, 4).alias(c) for c in ("bias", "rmse")])


GEOMETRY = (
    "WITH g(geometry, view) AS (VALUES " + ", ".join(f"('{name}', {v})" for name, views in GEOMETRIES.items() for v in views) + """),
v AS (SELECT geometry, l_orderkey, l_quantity / 50.0 - 1.0 AS b, 30.0 + 5.0 * (l_quantity / 50.0 - 1.0) + l_discount AS l FROM lineitem JOIN g ON view = l_linenumber),
f AS (SELECT geometry, l_orderkey, CASE WHEN var_pop(b) > 1e-12 THEN pi() * (regr_intercept(l, b) + 0.1 * regr_slope(l, b)) END - 95.0 AS e FROM v GROUP BY 1, 2)
SELECT geometry, count(*) AS cases, count(*) FILTER (e IS NULL) AS unidentifiable, round(avg(e), 4) AS bias, round(sqrt(avg(e * e)), 4) AS rmse FROM f GROUP BY 1"""
)


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's cells of two error sources and their sum, in fixed order."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000.0 - 1.5).alias("spectral"), (F.col("o_orderkey") % 13 / 13.0).alias("angular"))
    return retrieval.budget_table(weighted.component_budget(o, ["spectral", "angular"], F.lit(1.0)), ["total", "spectral", "angular"])


_CELL = "SELECT {0} AS position, '{1}' AS component, format('{{:+.3f}}', avg({1})) AS bias, format('{{:+.3f}}', sqrt(avg({1} * {1}))) AS rmse FROM l"
BUDGET_REPORT = """WITH o AS (SELECT o_totalprice / 100000.0 - 1.5 AS spectral, o_orderkey % 13 / 13.0 AS angular FROM orders), l AS (SELECT *, spectral + angular AS total FROM o) """ + " UNION ALL ".join(
    _CELL.format(i, c) for i, c in enumerate(("total", "spectral", "angular"))
)

#: The angles of the views, and the coordinates of the limb at 90 degrees.
VIEWS = (0.0, 20.0, 40.0, 55.0, 68.0)


def case_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude, shape and flux of every order from five views; steep shapes would be negative at the limb and are held at zero there."""
    geometry = constrained.Geometry(VIEWS, 2)
    level, b1, b2 = F.col("o_totalprice") / 5000.0 + 40.0, F.col("o_orderkey") % 13 / 2.0 - 0.9, F.col("o_custkey") % 5 / 20.0 + 0.03
    noise = lambda i: 0.01 * ((F.col("o_orderkey") * (i + 3)) % 11 - 5)
    views = F.array(*[level * (1.0 + b1 * float(row[1]) + b2 * float(row[2])) + noise(i) for i, row in enumerate(geometry.design)])
    out = constrained.retrieve(table(spark, sf_dir, "orders").select("o_orderkey", views.alias("views")), "views", geometry)
    return out.select("o_orderkey", F.round("amplitude", 5).alias("amplitude"), F.round(F.col("shape")[0], 5).alias("b1"), F.round(F.col("shape")[1], 5).alias("b2"), F.round("flux", 4).alias("flux"), F.round("rmse", 5).alias("rmse"), "constrained")


def _case_retrievals_sql() -> str:
    """The free fit by its pseudo-inverse; where the shape at 90 degrees is below the margin, the fit that holds it there."""
    g = constrained.Geometry(VIEWS, 2)
    limb = g.bounds[-1]
    spread = np.linalg.inv(g.design.T @ g.design) @ limb
    push = spread / (limb @ spread)
    views = [f"(level * (1.0 + b1 * {float(r[1])!r} + b2 * {float(r[2])!r}) + 0.01 * ((o_orderkey * {i + 3}) % 11 - 5))" for i, r in enumerate(g.design)]
    dot = lambda names, weights: " + ".join(f"{n} * ({float(w)!r})" for n, w in zip(names, weights, strict=True))
    l, f, c = ([f"{n}{i}" for i in range(k)] for n, k in (("l", 5), ("f", 3), ("c", 3)))
    left = " + ".join(f"pow(l{i} - ({dot(c, r)}), 2)" for i, r in enumerate(g.design))
    return f"""WITH o AS (SELECT *, o_totalprice / 5000.0 + 40.0 AS level, o_orderkey % 13 / 2.0 - 0.9 AS b1, o_custkey % 5 / 20.0 + 0.03 AS b2 FROM orders),
v AS (SELECT o_orderkey, {", ".join(f"{x} AS l{i}" for i, x in enumerate(views))} FROM o),
e AS (SELECT *, {", ".join(f"{dot(l, r)} AS f{i}" for i, r in enumerate(g.inverse))} FROM v),
h AS (SELECT *, {dot(f, limb)} AS low FROM e),
k AS (SELECT *, {", ".join(f"f{i} - CASE WHEN low < 0 THEN low * ({float(p)!r}) ELSE 0 END AS c{i}" for i, p in enumerate(push))} FROM h)
SELECT o_orderkey, round(c0, 5) AS amplitude, round(c1 / c0, 5) AS b1, round(c2 / c0, 5) AS b2, round(pi() * ({dot(c, g.integral)}), 4) AS flux, round(sqrt(({left}) / 5), 5) AS rmse, low < 0 AS constrained FROM k"""


QUERIES = {
    "case_retrievals": (case_retrievals, _case_retrievals_sql()),
    "quadratic_shape_library": (quadratic_shape_library, QUADRATIC),
    "library_fluxes": (library_fluxes, LIBRARY_FLUX),
    "geometry_study": (geometry_study, GEOMETRY),
    "budget_report": (budget_report, BUDGET_REPORT),
}
