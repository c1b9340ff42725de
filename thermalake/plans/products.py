"""Flux products over the driver's tables: line items stand for pixels, months for days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions import geo, physics
from thermalake.functions.numbers import rounded
from thermalake.functions.physics import angular_integral
from thermalake.operators import grid, moments
from thermalake.sources.tables import table

FK1, FK2 = 20000.0, 1300.0
#: Shape parameters of the scenes, by return flag.
SHAPES = {"A": -0.1, "N": -0.25, "R": -0.4}
LINEAR = (0.18, 0.16, 0.17, 0.2, 0.15, 0.14)
VIEW = geo.View(-75.2)


def r(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels: radiances of six channels, an angle, a scene; some values are made invalid."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    base = price / 987.654321
    radiance = [F.when(quantity <= 48, base * f + 20.0) for f in (0.2, 0.5, 0.6, 0.7, 0.8, 0.4)]
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_partkey",
        "l_orderkey",
        F.col("l_returnflag").alias("scene"),
        F.col("l_linestatus").alias("status"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("month"),
        (quantity * 1.6).alias("angle"),
        (F.col("l_discount") * 600.0 + 10.0).alias("angle2"),
        *[x.alias(f"rad{i}") for i, x in enumerate(radiance)],
        price.alias("price"),
        quantity.alias("quantity"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
    )


PIXELS_SQL = """
px AS (SELECT l_suppkey, l_partkey, l_orderkey, l_returnflag AS scene, l_linestatus AS status,
  (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS month, l_quantity * 1.6 AS angle, l_discount * 600.0 + 10.0 AS angle2,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.2 + 20.0 END AS rad0,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.5 + 20.0 END AS rad1,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.6 + 20.0 END AS rad2,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.7 + 20.0 END AS rad3,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.8 + 20.0 END AS rad4,
  CASE WHEN l_quantity <= 48 THEN l_extendedprice / 987.654321 * 0.4 + 20.0 END AS rad5,
  l_extendedprice AS price, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem)"""

_LIMB = f"(ln(cos(radians(A)) + 2.0) / {math.log(math.cos(math.radians(55.0)) + 2.0)!r} - 1.0)"


def with_scene_shape(df: DataFrame) -> DataFrame:
    """The pixel's shape parameter and its integral from a table of one row per scene."""
    spark = df.sparkSession
    rows = [(scene, b, angular_integral([b])) for scene, b in SHAPES.items()]
    shapes = spark.createDataFrame(rows, "_scene string, b double, integral double")
    return df.join(F.broadcast(shapes), F.col("scene") == F.col("_scene")).drop("_scene")  # a fixed number of rows


_SHAPES_SQL = (
    "adm(scene, b, integral) AS (VALUES "
    + ", ".join(f"('{s}', {b!r}::DOUBLE, {angular_integral([b])!r}::DOUBLE)" for s, b in SHAPES.items())
    + ")"
)


#: The radiance of the highest valid temperature: below it, and above zero, a temperature is valid.
HIGHEST = FK1 / math.expm1(FK2 / physics.BT_LIMIT)


def chain(df: DataFrame, angle: str, out: str) -> DataFrame:
    """The table with the flux of each pixel: shape correction, temperatures in single precision, regression, flux.

    Temperatures rise with radiances, so the lowest and the highest of the six
    tell whether all are valid. Tests of each channel, for two views, would
    make the generated method too large for the virtual machine to compile.
    """
    df = df.withColumn("_factor", correction(F.col(angle)))
    own = [F.col(f"rad{i}") for i in range(6)]
    bt = [physics.stored(physics.temperature_of_positive(l * F.col("_factor"), FK1, FK2)) for l in own]
    valid = (F.least(*own) > 0) & (F.greatest(*own) * F.col("_factor") < HIGHEST)  # NaN compares as the largest value
    df = df.withColumn("_effective", F.when(valid, physics.polynomial(bt, LINEAR, 1.0, 1)))
    return df.withColumn(out, physics.broadband_flux(F.col("_effective"))).drop("_factor", "_effective")


def correction(angle: Column) -> Column:
    """What a radiance of the pixel's scene is multiplied by; null where the angle is out of range or the shape not positive."""
    shape = physics.radiance_shape(angle, [F.col("b")])
    return F.when(angle.between(0.0, physics.MAX_ZENITH) & (shape > 0), F.col("integral") / shape)


def _chain_sql(angle: str) -> str:
    shape = f"(1.0 + b * {_LIMB.replace('A', angle)})"
    bt = [f"CAST({FK2} / ln(1.0 + {FK1} / (rad{i} * integral / {shape})) AS FLOAT)::DOUBLE" for i in range(6)]
    t = "(1.0" + "".join(f" + {c!r} * {x}" for c, x in zip(LINEAR, bt, strict=True)) + ")"
    flux = f"({physics.STEFAN_BOLTZMANN!r} * {t} * {t} * {t} * {t})"
    return f"CASE WHEN {angle} BETWEEN 0.0 AND 70.0 AND {flux} BETWEEN 50.0 AND 1000.0 THEN {flux} END"


def gridded_flux_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean fluxes of two views and the spread of their difference, per supplier: the whole product chain."""
    px = with_scene_shape(pixels(spark, sf_dir))
    flux = chain(chain(px, "angle", "f1"), "angle2", "f2")
    out = moments.pixel_means(flux, ["l_suppkey", "month"], F.col("f1"), F.col("f2"))
    return out.select("l_suppkey", "month", *[r(F.col(c), 2).alias(c) for c in ("mean_first", "mean_second", "std_diff")], "n_both")


GRIDDED_SQL = f"""WITH {PIXELS_SQL}, {_SHAPES_SQL},
f AS (SELECT l_suppkey, month, {_chain_sql("angle")} AS f1, {_chain_sql("angle2")} AS f2 FROM px JOIN adm USING (scene))
SELECT l_suppkey, month, round(avg(f1), 2) AS mean_first, round(avg(f2), 2) AS mean_second,
  round(stddev_pop(f1 - f2), 2) AS std_diff, count(f1 - f2) AS n_both FROM f GROUP BY l_suppkey, month"""


def monthly_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    out = moments.pixel_means(px, ["l_suppkey", "month"], F.col("rad0"), F.when(F.col("tax") < 0.07, F.col("rad3")))
    return out.select("l_suppkey", "month", *[r(F.col(c), 6).alias(c) for c in ("mean_first", "mean_second", "std_diff")], "n_both")


MONTHLY_SQL = f"""WITH {PIXELS_SQL}, v AS (SELECT *, CASE WHEN tax < 0.07 THEN rad3 END AS b FROM px)
SELECT l_suppkey, month, round(avg(rad0), 6) AS mean_first, round(avg(b), 6) AS mean_second,
  round(stddev_pop(rad0 - b), 6) AS std_diff, count(rad0 - b) AS n_both FROM v GROUP BY ALL"""


def cell_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.cell_sums(pixels(spark, sf_dir), [], "l_partkey", "l_suppkey", F.col("rad1"), 5)
    return out.select(F.col("cy").cast("long"), F.col("cx").cast("long"), r(F.col("total"), 3).alias("total"), "n", r(F.col("mean")).alias("mean"))


CELLS_SQL = f"""WITH {PIXELS_SQL} SELECT floor(l_partkey / 5)::BIGINT AS cy, floor(l_suppkey / 5)::BIGINT AS cx,
  round(sum(rad1), 3) AS total, count(rad1) AS n, round(avg(rad1), 4) AS mean FROM px GROUP BY ALL"""


def complete_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.complete_footprints(pixels(spark, sf_dir), [], "l_partkey", "l_suppkey", F.col("price") > 1000, 2)
    return out.select(F.col("cy").cast("long"), F.col("cx").cast("long"))


FOOTPRINTS_SQL = f"""WITH {PIXELS_SQL}, g AS (SELECT l_partkey AS gy, l_suppkey AS gx, price FROM px)
SELECT floor(gy / 2)::BIGINT AS cy, floor(gx / 2)::BIGINT AS cx FROM g GROUP BY 1, 2
HAVING bool_and(price > 1000) AND count(DISTINCT (gy, gx)) = 4"""

EDGES = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0)


def angle_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of a difference by angle bin; the overflow bin is reported."""
    px = pixels(spark, sf_dir).withColumn("bin", physics.angle_bin(F.col("angle"), EDGES))
    out = moments.population_summary(moments.state(px, ["bin"], F.col("rad3") - F.col("rad0")))
    return out.select("bin", "n", *[r(F.col(c)).alias(c) for c in ("bias", "sd", "rmse")])


BINS_SQL = f"""WITH {PIXELS_SQL}, b AS (SELECT CASE WHEN angle >= 0 AND angle < 60 THEN floor(angle / 10)
  WHEN angle >= 60 AND angle <= 70 THEN 6 ELSE 7 END::INTEGER AS bin, rad3 - rad0 AS d FROM px)
SELECT bin, count(d) AS n, round(avg(d), 4) AS bias, round(stddev_pop(d), 4) AS sd,
  round(sqrt(avg(d) * avg(d) + var_pop(d)), 4) AS rmse FROM b GROUP BY bin"""


def angle_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens = lambda c: F.least(F.greatest(F.floor(F.col(c) / 10.0), F.lit(0)), F.lit(8)).cast("long")
    d = F.col("rad1") - F.col("rad5")
    out = pixels(spark, sf_dir).groupBy(tens("angle").alias("b1"), tens("angle2").alias("b2"))
    out = out.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.count(d).alias("n"))
    return out.select("b1", "b2", r(F.col("mean")).alias("mean"), F.when(F.col("n") > 1, r(F.col("sd"))).alias("sd"), "n")


HEATMAP_SQL = f"""WITH {PIXELS_SQL}, b AS (SELECT least(greatest(floor(angle / 10.0), 0), 8)::BIGINT AS b1,
  least(greatest(floor(angle2 / 10.0), 0), 8)::BIGINT AS b2, rad1 - rad5 AS d FROM px)
SELECT b1, b2, round(avg(d), 4) AS mean, CASE WHEN count(d) > 1 THEN round(stddev_pop(d), 4) END AS sd, count(d) AS n
FROM b GROUP BY ALL"""


def brightness_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    bt = physics.brightness_temperature(F.col("o_totalprice") / 1000.0 - 50.0, FK1, FK2, 0.5, 0.999)
    back = physics.planck_radiance(bt, FK1, FK2, 0.5, 0.999)
    return table(spark, sf_dir, "orders").select("o_orderkey", r(bt, 6).alias("bt"), r(back, 6).alias("radiance"), F.coalesce(physics.valid_bt(bt), F.lit(False)).alias("valid"))


BT_SQL = f"""WITH l AS (SELECT o_orderkey, CASE WHEN o_totalprice / 1000.0 - 50.0 > 0 THEN o_totalprice / 1000.0 - 50.0 END AS l FROM orders),
t AS (SELECT o_orderkey, ({FK2} / ln(1 + {FK1} / l) - 0.5) / 0.999 AS bt FROM l)
SELECT o_orderkey, round(bt, 6) AS bt, round({FK1} / (exp({FK2} / (0.999 * bt + 0.5)) - 1), 6) AS radiance,
  coalesce(bt > 0 AND bt < 1000, false) AS valid FROM t"""


def angular_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = with_scene_shape(pixels(spark, sf_dir).filter("angle <= 70"))
    px = px.withColumns(
        {
            "fixed": physics.correct_radiance(F.col("rad2"), F.col("angle"), [F.col("b")], F.col("integral")),
            "ratio": physics.radiance_shape(F.col("angle"), [F.col("b")]) / physics.radiance_shape(F.lit(0.0), [F.col("b")]),
        }
    )
    fixed, back = F.col("fixed"), physics.shape_from_ratio(F.col("ratio"), F.col("angle"), F.lit(0.0))
    return px.groupBy("scene").agg(
        F.count(fixed).alias("n"), r(F.avg(fixed)).alias("corrected"), r(F.avg(physics.spectral_irradiance(fixed)), 6).alias("irradiance"), r(F.avg(back), 6).alias("recovered")
    )


ADM_SQL = f"""WITH {PIXELS_SQL}, {_SHAPES_SQL}, c AS (SELECT scene, b, angle,
  rad2 * integral / (1.0 + b * {_LIMB.replace('A', 'angle')}) AS f FROM px JOIN adm USING (scene) WHERE angle <= 70)
SELECT scene, count(f) AS n, round(avg(f), 4) AS corrected, round(avg(pi() * f / 1000.0), 6) AS irradiance,
  round(avg(CASE WHEN abs(angle) > 0 THEN b END), 6) AS recovered FROM c GROUP BY scene"""

_CUBIC = [((i * 37) % 11 - 5) / 100.0 for i in range(83)]


def polynomial_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions of degree 1 to 3 in six scaled measures; 6, 27 and 83 terms."""
    x = [F.col(f"rad{i}") / 100.0 for i in range(6)]
    px = pixels(spark, sf_dir)
    n = {1: 6, 2: 27, 3: 83}
    return px.groupBy("scene", "status").agg(
        *[r(F.avg(physics.polynomial(x, _CUBIC[: n[d]], 0.5, d)), 6).alias(f"degree{d}") for d in (1, 2, 3)]
    )


def _polynomial_sql(degree: int) -> str:
    import itertools

    terms = [c for size in range(1, degree + 1) for c in itertools.combinations_with_replacement(range(6), size)]
    body = "".join(f" + {k!r} * " + " * ".join(f"(rad{i} / 100.0)" for i in c) for k, c in zip(_CUBIC, terms, strict=False))
    return f"round(avg(0.5{body}), 6) AS degree{degree}".replace("+ -", "- ")


POLYNOMIAL_SQL = f"WITH {PIXELS_SQL} SELECT scene, status, {', '.join(_polynomial_sql(d) for d in (1, 2, 3))} FROM px GROUP BY ALL"


def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zenith angles, scan angles and the way back, and equal-area coordinates, for places made of keys."""
    place = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 101 - 50.0).alias("lat"), geo.normalize_longitude(F.col("c_custkey") * 7 % 110 - 130.0).alias("lon")
    )
    x, y = geo.to_scan_angles(F.col("lat"), F.col("lon"), VIEW)
    seen = place.withColumns({"sx": x, "sy": y, "zenith": geo.local_zenith(F.col("lat"), F.col("lon"), VIEW)})
    lat, lon = geo.from_scan_angles(F.col("sx"), F.col("sy"), VIEW)
    radius = geo.authalic_radius(VIEW.equatorial, VIEW.polar)
    px, py = geo.sinusoidal(F.col("lat"), F.col("lon"), -75.0, radius)
    blat, blon = geo.inverse_sinusoidal(px, py, -75.0, radius)
    return seen.select(
        "c_custkey", r(F.col("zenith")).alias("zenith"), r(F.col("sx"), 7).alias("scan_x"), r(F.col("sy"), 7).alias("scan_y"),
        r(lat).alias("lat_back"), r(lon).alias("lon_back"), r(px, 0).alias("plane_x"), r(py, 0).alias("plane_y"), r(blat, 6).alias("plane_lat"), r(blon, 6).alias("plane_lon"),
    )


_R = geo.authalic_radius(VIEW.equatorial, VIEW.polar)
_Q = (VIEW.polar / VIEW.equatorial) ** 2
GEODESY_SQL = f"""WITH p AS (SELECT c_custkey, c_custkey % 101 - 50.0::DOUBLE AS lat, c_custkey * 7 % 110 - 130.0::DOUBLE AS lon FROM customer),
g AS (SELECT *, atan(tan(radians(lat)) * {_Q!r}) AS phi, radians(lon - {VIEW.longitude!r}) AS east FROM p),
h AS (SELECT *, {VIEW.polar!r} / sqrt(1 - {1 - _Q!r} * cos(phi) * cos(phi)) AS rad FROM g),
s AS (SELECT *, {VIEW.distance!r} - rad * cos(phi) * cos(east) AS sx, -rad * cos(phi) * sin(east) AS sy, rad * sin(phi) AS sz,
  acos(cos(phi) * cos(east)) AS beta FROM h),
v AS (SELECT *, {VIEW.distance!r} * ({VIEW.distance!r} - sx) >= sy * sy + {1 / _Q!r} * sz * sz AS seen FROM s)
SELECT c_custkey,
  round(degrees(asin(least({VIEW.distance!r} * sin(beta) / sqrt({VIEW.distance!r} * {VIEW.distance!r} + rad * rad - 2 * {VIEW.distance!r} * rad * cos(beta)), 1.0))), 4) AS zenith,
  CASE WHEN seen THEN round(asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)), 7) END AS scan_x, CASE WHEN seen THEN round(atan(sz / sx), 7) END AS scan_y,
  CASE WHEN seen THEN round(lat, 4) END AS lat_back, CASE WHEN seen THEN round(lon, 4) END AS lon_back,
  round({_R!r} * radians(lon + 75.0) * cos(radians(lat)), 0) AS plane_x, round({_R!r} * radians(lat), 0) AS plane_y,
  round(lat, 6) AS plane_lat, round(lon, 6) AS plane_lon FROM v"""


def lognormal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, sd = F.col("o_totalprice") / 1000.0, F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice") / 20000.0)
    z = (F.col("o_orderkey") % 7 - 3) / 2.0
    out = physics.lognormal_radiance(level, sd, z)
    nedt = physics.noise_sd(F.lit(0.4), FK1, FK2)
    return table(spark, sf_dir, "orders").select("o_orderkey", r(out, 6).alias("noisy"), r(nedt, 6).alias("sd_at_255"))


_A = FK2 / 255.0
LOGNORMAL_SQL = f"""WITH b AS (SELECT o_orderkey, o_totalprice / 1000.0 AS l, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice / 20000.0 END AS sd,
  (o_orderkey % 7 - 3) / 2.0 AS z FROM orders), v AS (SELECT *, ln(1 + (sd / l) * (sd / l)) AS v FROM b)
SELECT o_orderkey, round(CASE WHEN sd = 0 THEN l ELSE exp(ln(l) + sqrt(v) * z - v / 2) END, 6) AS noisy,
  round(0.4 * {FK1} * exp({_A!r}) * {FK2} / pow((exp({_A!r}) - 1) * 255.0, 2), 6) AS sd_at_255 FROM v"""


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).groupBy(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"))
    px = px.agg(F.avg("rad1").alias("v")).withColumn("v", F.when((F.col("x") + F.col("y")) % 13 != 0, F.col("v") + 1e6))
    out = grid.box_statistics(px, [], "y", "x", "v", 2)
    return out.select("y", "x", "box_n", rounded(F.col("box_mean"), 3).alias("box_mean"), rounded(F.col("box_sd"), 3).alias("box_sd"))


BOX_SQL = f"""WITH {PIXELS_SQL}, g AS (SELECT l_partkey AS y, l_suppkey AS x, avg(rad1) AS v FROM px GROUP BY 1, 2),
k AS (SELECT y, x, CASE WHEN (x + y) % 13 <> 0 THEN v END AS v FROM g), d(d) AS (VALUES (-2), (-1), (0), (1), (2)),
a AS (SELECT k.y, k.x, k.y + d AS o FROM k, d)
SELECT a.y, a.x, count(b.v) AS box_n, round(avg(b.v) + 1e6, 3) AS box_mean, round(stddev_pop(b.v), 3) AS box_sd
FROM a JOIN k b ON b.y = a.o AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.y, a.x"""


def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier nearest to each customer within 600 km on the sphere, near the poles and across the date line too."""
    targets = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 17 % 1799 / 10.0 - 89.9).alias("lat"), (F.col("c_custkey") * 31 % 3600 / 10.0 - 180.0).alias("lon"))
    sources = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 13 % 179 - 89.25).alias("lat"), (F.col("s_suppkey") * 29 % 360 - 179.65).alias("lon"), F.col("s_suppkey").alias("value"))
    out = grid.nearest_within(targets, sources, "lat", "lon", "value", 600_000.0)
    return out.select("c_custkey", "value", r(F.col("distance"), 2).alias("distance"))


NEAREST_SQL = """WITH t AS (SELECT c_custkey, c_custkey * 17 % 1799 / 10.0 - 89.9 AS a, c_custkey * 31 % 3600 / 10.0 - 180.0 AS o FROM customer),
s AS (SELECT s_suppkey * 13 % 179 - 89.25 AS b, s_suppkey * 29 % 360 - 179.65 AS p, s_suppkey AS value FROM supplier),
d AS (SELECT t.c_custkey, value, 2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(p - o) / 2), 2), 1))) AS d FROM t, s),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 6), value) AS k FROM d WHERE d <= 600000.0)
SELECT t.c_custkey, value, round(d, 2) AS distance FROM t LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (c_custkey)"""


def regrid_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse-then-retrieve minus retrieve-then-average over complete cells, and the closure of stored precision."""
    px = pixels(spark, sf_dir).select(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"), "rad3")
    px = px.withColumns({"cy": F.floor(F.col("y") / 4), "cx": F.floor(F.col("x") / 4)})
    # one exchange of the rows by cell serves both means; few rows repeat a place, so sums before it would only be wider
    parts = max(spark.sparkContext.defaultParallelism, -(-px.count() // 500_000))
    px = px.repartition(parts, "cy", "cx").groupBy("cy", "cx", "y", "x").agg(F.avg("rad3").alias("rad"))
    bt = lambda c: physics.brightness_temperature(c, FK1, FK2)
    out = px.groupBy("cy", "cx").agg(
        F.count("rad").alias("n"), bt(F.avg("rad")).alias("coarse"), F.avg(bt(F.col("rad"))).alias("fine")
    )
    return out.select(F.col("cy").cast("long"), F.col("cx").cast("long"), "n", r(F.col("coarse") - F.col("fine"), 5).alias("difference"))


REGRID_SQL = f"""WITH {PIXELS_SQL}, g AS (SELECT l_partkey AS y, l_suppkey AS x, avg(rad3) AS rad FROM px GROUP BY 1, 2)
SELECT floor(y / 4)::BIGINT AS cy, floor(x / 4)::BIGINT AS cx, count(rad) AS n,
  round({FK2} / ln(1 + {FK1} / avg(rad)) - avg({FK2} / ln(1 + {FK1} / rad)), 5) AS difference FROM g GROUP BY 1, 2"""

QUERIES = {
    "gridded_flux_budget": (gridded_flux_budget, GRIDDED_SQL),
    "monthly_pixel_stats": (monthly_pixel_stats, MONTHLY_SQL),
    "cell_sums": (cell_sums, CELLS_SQL),
    "complete_footprints": (complete_footprints, FOOTPRINTS_SQL),
    "angle_bins": (angle_bins, BINS_SQL),
    "angle_heatmap": (angle_heatmap, HEATMAP_SQL),
    "brightness_temperatures": (brightness_temperatures, BT_SQL),
    "angular_correction": (angular_correction, ADM_SQL),
    "polynomial_regressions": (polynomial_regressions, POLYNOMIAL_SQL),
    "geodesy": (geodesy, GEODESY_SQL),
    "lognormal_noise": (lognormal_noise, LOGNORMAL_SQL),
    "box_statistics": (box_statistics, BOX_SQL),
    "nearest_neighbour": (nearest_neighbour, NEAREST_SQL),
    "regrid_closure": (regrid_closure, REGRID_SQL),
}
