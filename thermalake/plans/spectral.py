"""Spectra, bands and stored models over the driver's tables: customers stand for spectra, nations for scenes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import geo, physics
from thermalake.operators import fits, scenes, spectra
from thermalake.plans.models import EXACT, TEMPERATURES, TRUE_SHAPES
from thermalake.plans.products import VIEW
from thermalake.sources import models as stored
from thermalake.sources.tables import table
from thermalake.streaming.incremental import shared_folder

#: Wavelengths in micrometres from 4 to 20, and bands with logistic edges.
GRID = [4.0 + 0.25 * i for i in range(65)]
BANDS = {"ch08": (5.8, 6.7), "ch11": (8.3, 8.8), "ch14": (10.8, 11.7), "ch16": (13.0, 13.6)}
SLOPE = 40.0


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.lit(220.0) + F.col("c_custkey") % 100 + F.col("c_acctbal") / 1000.0).alias("t"))


_X = physics.PLANCK_H * physics.PLANCK_C / physics.PLANCK_K
_FLUX = 2 * math.pi * physics.PLANCK_H * physics.PLANCK_C**2
_LEVEL = f"({_FLUX!r} / pow(w * 1e-6, 5) / (exp({_X!r} / (w * 1e-6 * t)) - 1) * {1e-6 / math.pi!r})"
_GRID_SQL = (
    "g AS (SELECT i, 4.0 + 0.25 * i AS w, 0.25 / 3 * CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS s FROM generate_series(0, 64) AS g(i)),\n"
    "b(channel, low, high) AS (VALUES " + ", ".join(f"('{c}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for c, (lo, hi) in BANDS.items()) + "),\n"
    f"k AS (SELECT channel, w, s / (1 + exp(-{SLOPE!r} * (w - low))) / (1 + exp(-{SLOPE!r} * (high - w))) AS k FROM b, g)"
)
_CASES_SQL = "c AS (SELECT c_custkey, 220.0 + c_custkey % 100 + c_acctbal / 1000.0 AS t FROM customer)"


def band_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band radiances of black bodies of the customers' temperatures."""
    kernels = spectra.band_kernels(spark, GRID, spectra.logistic_bands(GRID, BANDS, SLOPE))
    own = spectra.blackbody_spectra(_cases(spark, sf_dir), F.col("t"), GRID)
    got = spectra.band_integrals(own, ["c_custkey"], F.col("wavelength"), F.col("radiance"), kernels, len(GRID))
    return got.select("c_custkey", "channel", F.round("integral", 8).alias("radiance"))


BAND_FLUXES = f"WITH {_CASES_SQL}, {_GRID_SQL} SELECT c_custkey, channel, round(sum({_LEVEL} * k), 8) AS radiance FROM c, k GROUP BY 1, 2"


def equivalent_radiances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent radiances per wavenumber of the same spectra, and the temperatures of a channel's centre."""
    kernels = spectra.band_kernels(spark, GRID, spectra.logistic_bands(GRID, BANDS, SLOPE), equivalent=True)
    own = spectra.blackbody_spectra(_cases(spark, sf_dir), F.col("t"), GRID)
    got = spectra.band_integrals(own, ["c_custkey"], F.col("wavelength"), F.col("radiance"), kernels, len(GRID))
    return got.select("c_custkey", "channel", F.round("integral", 6).alias("radiance"))


EQUIVALENT = f"""WITH {_CASES_SQL}, {_GRID_SQL}, n AS (SELECT channel, sum(k * 1e4 / (w * w)) AS n FROM k GROUP BY 1)
SELECT c_custkey, channel, round(1000 * sum({_LEVEL} * k) / any_value(n), 6) AS radiance FROM c, k JOIN n USING (channel) GROUP BY 1, 2"""

#: The constants of the Planck function per wavenumber, in mW and centimetres.
PLANCK_1, PLANCK_2 = 1.191042972e-5, 1.438776877


def _coefficients() -> dict[str, tuple[float, float]]:
    centre = {c: 2e4 / (lo + hi) for c, (lo, hi) in BANDS.items()}
    return {c: (PLANCK_1 * v**3, PLANCK_2 * v) for c, v in centre.items()}


def blackbody_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the temperatures of black bodies, one for each account balance, are missed when found from a band at its centre."""
    cases = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 80.0 + 195.0).alias("temperature"))
    got = spectra.roundtrip(spark, GRID, spectra.logistic_bands(GRID, BANDS, SLOPE), _coefficients(), cases=cases)
    return got.select("channel", "temperatures", F.round("error", 6).alias("error"))


ROUNDTRIP = f"""WITH c AS (SELECT DISTINCT c_acctbal / 80.0 + 195.0 AS t FROM customer), {_GRID_SQL}, n AS (SELECT channel, sum(k * 1e4 / (w * w)) AS n FROM k GROUP BY 1),
l AS (SELECT t, channel, 1000 * sum({_LEVEL} * k) / any_value(n) AS l FROM c, k JOIN n USING (channel) GROUP BY 1, 2), f(channel, fk1, fk2) AS (VALUES """ + ", ".join(f"('{c}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for c, (a, b) in _coefficients().items()) + """)
SELECT channel, count(*) AS temperatures, round(max(abs(fk2 / ln(1 + fk1 / l) - t)), 6) AS error FROM l JOIN f USING (channel) GROUP BY 1"""


def power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power law that radiances were made with, found from them, and its inverse."""
    df = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"), physics.power_law(F.col("p_retailprice"), 0.0125, 4.6).alias("y"))
    a, b = spectra.power_law_fit(df, F.col("x"), F.col("y"))
    far = F.max(F.abs(physics.inverse_power_law(F.col("y"), a, b) / F.col("x") - 1.0))
    return df.agg(F.count("*").alias("n"), F.lit(round(a, 8)).alias("a"), F.lit(round(b, 8)).alias("b"), (far < 1e-6).alias("inverse"))


POWER_LAW = "SELECT count(*) AS n, 0.0125::DOUBLE AS a, 4.6::DOUBLE AS b, true AS inverse FROM part"


def stored_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape library is written, read with its checks, and applied: mean corrected radiances per scene and channel."""
    rows = [(s, c, [b * f]) for s, b in enumerate(TRUE_SHAPES) for c, f in (("low", 0.5), ("high", 1.0))]
    path = shared_folder(spark, "shapes")
    stored.write_shapes(spark.createDataFrame(rows, "scene int, channel string, parameters array<double>"), path, "linear", seed=42)
    library = stored.read_shapes(spark, path, len(TRUE_SHAPES), ["low", "high"], "linear", seed=42)
    px = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("own"), (F.col("l_quantity") * 1.3).alias("angle"), (F.col("l_extendedprice") / 1000.0).alias("radiance"))
    met = px.join(library, F.col("own") == F.col("scene"))
    fixed = physics.correct_radiance(F.col("radiance"), F.col("angle"), [F.col("parameters")[0]], F.col("integral"))
    return met.groupBy("scene", "channel").agg(F.count(fixed).alias("n"), F.round(F.avg(fixed), 6).alias("corrected"))


_BASE = math.log(math.cos(math.radians(55.0)) + 2.0)
STORED_SHAPES = (
    "WITH s(scene, channel, b, i) AS (VALUES "
    + ", ".join(f"({s}, '{c}', {b * f!r}::DOUBLE, {physics.angular_integral([b * f])!r}::DOUBLE)" for s, b in enumerate(TRUE_SHAPES) for c, f in (("low", 0.5), ("high", 1.0)))
    + f"""), p AS (SELECT l_linenumber - 1 AS own, l_quantity * 1.3 AS angle, l_extendedprice / 1000.0 AS l FROM lineitem)
SELECT scene, channel, count(*) AS n, round(avg(l * i / (1 + b * (ln(cos(radians(angle)) + 2.0) / {_BASE!r} - 1))), 6) AS corrected FROM p JOIN s ON own = scene GROUP BY 1, 2"""
)


def stored_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadratic regression is fitted, written, read with its checks, and applied: mean predictions per flag."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.expr(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)], F.expr(EXACT[2]).alias("y"))
    values, path = [F.col(f"t{i}") for i in range(6)], shared_folder(spark, "polynomial")
    stored.write_polynomial(spark, fits.fit_polynomial(df, values, F.col("y"), degree=2), path, form="nominal")
    fit = stored.read_polynomial(spark, path, 6, form="nominal", degree=2)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(fit.column(values)), 5).alias("prediction"))


STORED_POLYNOMIAL = f"SELECT l_returnflag, count(*) AS n, round(avg({EXACT[2]}), 5) AS prediction FROM lineitem GROUP BY 1"


def stored_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture is fitted to clusters, written, read with its checks, and labels every row: rows per cluster and label order."""
    k = F.col("o_orderkey") % 7
    place = F.when(k < 4, 0).when(k < 6, 1).otherwise(2)
    df = table(spark, sf_dir, "orders").select(place.alias("place"), (place * 18.0 + F.col("o_custkey") % 10 / 10.0).alias("x"), (F.col("o_totalprice") / 100000.0).alias("y"))
    path = shared_folder(spark, "mixture")
    stored.write_mixture(spark, fits.mixture(df, [F.col("x"), F.col("y")], 3), path, seed=42)
    model = stored.read_mixture(spark, path, 3, seed=42)
    _, post = scenes.responsibilities([F.col("x"), F.col("y")], model["components"])
    order = {int(c): i for i, c in enumerate(np.argsort(model["mean"][:, 0]))}
    label = F.element_at(F.array(*[F.lit(order[c]) for c in range(3)]), scenes.first_argmax(post).cast("int") + 1)
    return df.select("place", label.alias("label")).groupBy("place", "label").agg(F.count("*").alias("n"))


STORED_MIXTURE = "SELECT k::INTEGER AS place, k::INTEGER AS label, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 < 4 THEN 0 WHEN o_orderkey % 7 < 6 THEN 1 ELSE 2 END AS k FROM orders) GROUP BY k"


def parallax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where cloud tops of 0 to 15 km stand; one of seven heights is null."""
    height = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 16 * 1000.0)
    place = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 81 - 40.0).alias("lat"), (F.col("c_custkey") * 7 % 90 - 120.0).alias("lon"), height.alias("height"))
    lat, lon = geo.parallax(F.col("lat"), F.col("lon"), F.col("height"), VIEW)
    return place.select("c_custkey", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


_Q = (VIEW.polar / VIEW.equatorial) ** 2
PARALLAX = f"""WITH p AS (SELECT c_custkey, c_custkey % 81 - 40.0::DOUBLE AS lat, c_custkey * 7 % 90 - 120.0::DOUBLE AS lon, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 16 * 1000.0 ELSE 0 END::DOUBLE AS h FROM customer),
g AS (SELECT *, atan(tan(radians(lat)) * {_Q!r}) AS phi, radians(lon - {VIEW.longitude!r}) AS east FROM p),
d AS (SELECT *, {VIEW.polar!r} / sqrt(1 - {1 - _Q!r} * cos(phi) * cos(phi)) AS rad FROM g),
s AS (SELECT *, {VIEW.distance!r} - rad * cos(phi) * cos(east) AS sx, -rad * cos(phi) * sin(east) AS sy, rad * sin(phi) AS sz FROM d),
x AS (SELECT *, asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) AS x, atan(sz / sx) AS y, pow(({VIEW.equatorial!r} + h) / ({VIEW.polar!r} + h), 2) AS ratio FROM s),
a AS (SELECT *, pow(sin(x), 2) + pow(cos(x), 2) * (pow(cos(y), 2) + ratio * pow(sin(y), 2)) AS a, -2 * {VIEW.distance!r} * cos(x) * cos(y) AS b, {VIEW.distance**2!r} - pow({VIEW.equatorial!r} + h, 2) AS c FROM x),
r AS (SELECT *, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS r FROM a),
e AS (SELECT *, {VIEW.distance!r} - r * cos(x) * cos(y) AS ex, -r * sin(x) AS ey, r * cos(x) * sin(y) AS ez FROM r)
SELECT c_custkey, round(degrees(atan(ratio * ez / sqrt(ex * ex + ey * ey))), 5) AS lat, round({VIEW.longitude!r} - degrees(atan(ey / ex)), 5) AS lon FROM e"""

QUERIES = {
    "band_fluxes": (band_fluxes, BAND_FLUXES),
    "equivalent_radiances": (equivalent_radiances, EQUIVALENT),
    "blackbody_roundtrip": (blackbody_roundtrip, ROUNDTRIP),
    "power_law": (power_law, POWER_LAW),
    "stored_shapes": (stored_shapes, STORED_SHAPES),
    "stored_polynomial": (stored_polynomial, STORED_POLYNOMIAL),
    "stored_mixture": (stored_mixture, STORED_MIXTURE),
    "parallax": (parallax, PARALLAX),
}
