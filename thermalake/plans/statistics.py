"""Statistical queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermalake.functions.physics import safe_ratio, spectral_features
from thermalake.operators import integrate, joins, moments, sampling, scenes, weighted
from thermalake.sources.tables import table


def r(x, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, keep: list[str], floats: list[str], digits: int = 4) -> DataFrame:
    return df.select(*keep, *[r(c, digits).alias(c) for c in floats])


def _errors(spark, sf_dir) -> DataFrame:
    """Line items as errors: a difference that is null for large quantities."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "e", F.when(F.col("l_quantity") <= 48, F.col("l_extendedprice") / 1000.0 - F.col("l_quantity") * 1.5)
    )


_E = "CASE WHEN l_quantity <= 48 THEN l_extendedprice / 1000.0 - l_quantity * 1.5 END"


def group_moments(spark, sf_dir):
    out = moments.population_summary(moments.state(_errors(spark, sf_dir), ["l_returnflag", "l_linestatus"], F.col("e")), F.lit(40.0))
    return rounded(out, ["l_returnflag", "l_linestatus", "n"], ["mean", "sd", "rmse", "bias_percent", "rmse_percent"])


GROUP_MOMENTS = f"""WITH e AS (SELECT l_returnflag, l_linestatus, {_E} AS e FROM lineitem)
SELECT l_returnflag, l_linestatus, count(e) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS sd, round(sqrt(avg(e * e)), 4) AS rmse,
  round(100 * avg(e) / 40.0, 4) AS bias_percent, round(100 * sqrt(avg(e * e)) / 40.0, 4) AS rmse_percent FROM e GROUP BY ALL"""


def merge_moments(spark, sf_dir):
    """Daily states merged to one per flag; equals the moments of all rows."""
    e = _errors(spark, sf_dir).withColumn("day", F.to_date("l_shipdate"))
    out = moments.merge(moments.state(e, ["l_returnflag", "day"], F.col("e")), ["l_returnflag"])
    return out.select("l_returnflag", "n", r("mean").alias("mean"), r(F.sqrt(F.col("m2") / F.col("n"))).alias("sd"))


MERGE_MOMENTS = f"""SELECT l_returnflag, count({_E}) AS n, round(avg({_E}), 4) AS mean, round(stddev_pop({_E}), 4) AS sd FROM lineitem GROUP BY 1"""


def sample_summary(spark, sf_dir):
    return rounded(moments.sample_summary(_errors(spark, sf_dir), ["l_linestatus"], F.col("e")), ["l_linestatus", "n"], ["mean", "sd", "rmse"])


SAMPLE_SUMMARY = f"""SELECT l_linestatus, count({_E}) AS n, round(avg({_E}), 4) AS mean, round(stddev_samp({_E}), 4) AS sd,
  round(sqrt(avg(({_E}) * ({_E}))), 4) AS rmse FROM lineitem GROUP BY 1"""


def paired_variant(spark, sf_dir):
    df = _errors(spark, sf_dir)
    variant = F.when(F.col("l_tax") < 0.07, F.col("e") * (1 + F.col("l_discount")))
    out = moments.paired_summary(df, ["l_returnflag"], variant, F.when(F.col("l_discount") < 0.09, F.col("e")), F.col("l_extendedprice") / 1000.0)
    return rounded(out, ["l_returnflag", "n", "lost", "gained"], ["mean", "sd", "rmse", "mean_percent", "rmse_percent"])


PAIRED_VARIANT = f"""WITH v AS (SELECT l_returnflag, {_E} AS e, l_tax, l_discount, l_extendedprice / 1000.0 AS ref FROM lineitem),
p AS (SELECT *, CASE WHEN l_tax < 0.07 THEN e * (1 + l_discount) END AS a, CASE WHEN l_discount < 0.09 THEN e END AS b FROM v)
SELECT l_returnflag, count(a - b) AS n, count(*) FILTER (b IS NOT NULL AND a IS NULL) AS lost, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS gained,
  round(avg(a - b), 4) AS mean, round(stddev_samp(a - b), 4) AS sd, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse,
  round(avg(100 * (a - b) / ref), 4) AS mean_percent, round(sqrt(avg(pow(100 * (a - b) / ref, 2))), 4) AS rmse_percent FROM p GROUP BY 1"""


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("band", F.least(F.floor(F.abs("value") / 20.0), F.lit(4)).cast("int"))


_BAND = "least(floor(abs(value) / 20.0), 4)::INTEGER"


def contingency(spark, sf_dir):
    return scenes.contingency(_labelled(spark, sf_dir), "event_type", "band")


CONTINGENCY = f"SELECT event_type AS a, {_BAND} AS b, count(*) AS n FROM events GROUP BY 1, 2"


def rand_index(spark, sf_dir):
    """Agreement of two labelings of the orders."""
    o = table(spark, sf_dir, "orders").withColumn("b", F.concat("o_orderpriority", F.when(F.col("o_totalprice") > 200000, "x").otherwise("y")))
    return rounded(scenes.adjusted_rand(scenes.contingency(o, "o_orderpriority", "b")), ["n"], ["ari"], 8)


RAND_INDEX = """WITH c AS (SELECT o_orderpriority AS a, o_orderpriority || CASE WHEN o_totalprice > 200000 THEN 'x' ELSE 'y' END AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS ra,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS rb, (SELECT sum(n) FROM c) AS n)
SELECT n::BIGINT AS n, round((s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 8) AS ari FROM s"""


def majority_vote(spark, sf_dir):
    out = scenes.majority(_labelled(spark, sf_dir), "user_id", "event_type", F.col("value"))
    return rounded(out.withColumnRenamed("event_type", "label"), ["user_id", "label", "votes", "views", "distinct_labels", "ties", "tied_labels"], ["vote_fraction"], 6)


MAJORITY = """WITH v AS (SELECT user_id, event_type, count(*) AS votes, avg(value) AS m FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, m DESC, event_type) AS k, sum(votes) OVER (PARTITION BY user_id) AS views,
  max(votes) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS distinct_labels FROM v),
t AS (SELECT user_id, count(*) AS ties, string_agg(event_type, ';' ORDER BY event_type) AS tied_labels FROM k WHERE votes = top GROUP BY 1)
SELECT user_id, event_type AS label, votes, views::BIGINT AS views, distinct_labels, ties, tied_labels, round(votes / views, 6) AS vote_fraction FROM k JOIN t USING (user_id) WHERE k = 1"""

#: The population's shares of the market segments; one of them does not occur.
POPULATION = (("AUTOMOBILE", 0.3), ("BUILDING", 0.25), ("FURNITURE", 0.2), ("MACHINERY", 0.1), ("NOWHERE", 0.15))
_POPULATION = "pop(seg, share) AS (VALUES " + ", ".join(f"('{s}', {v}::DOUBLE)" for s, v in POPULATION) + ")"


def population_weights(spark, sf_dir):
    pop = spark.createDataFrame(POPULATION, "c_mktsegment string, share double")
    out = weighted.population_weights(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", pop, "share")
    return out.select("c_custkey", r("weight", 9).alias("weight"), r("coverage", 6).alias("coverage"))


POPULATION_WEIGHTS = f"""WITH {_POPULATION}, n AS (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1),
w AS (SELECT seg, share / n AS w, sum(share) OVER () AS cover FROM n JOIN pop USING (seg))
SELECT c_custkey, round(w / cover, 9) AS weight, round(cover, 6) AS coverage FROM customer LEFT JOIN w ON c_mktsegment = seg"""


def error_classes(spark, sf_dir):
    """Orders stand for files, their line items for realizations."""
    out = weighted.error_classes(_errors(spark, sf_dir), "l_orderkey", F.col("e"), (F.col("l_orderkey") % 5 + 1).cast("double"))
    return rounded(out, ["scene_negative"], ["bias", "random_variance", "scene_variance", "rmse"], 3)


ERROR_CLASSES = f"""WITH e AS (SELECT l_orderkey, {_E} AS e FROM lineitem),
f AS (SELECT count(e) AS r, avg(e) AS m, coalesce(var_samp(e), 0) AS v, avg(e * e) AS s, (l_orderkey % 5 + 1)::DOUBLE AS w FROM e GROUP BY l_orderkey HAVING count(e) > 0),
t AS (SELECT sum(w) AS w1 FROM f), b AS (SELECT sum(w * m) / any_value(w1) AS bias, any_value(w1) AS w1 FROM f, t),
q AS (SELECT any_value(bias) AS bias, sum(w / w1 * v) AS random_variance, sqrt(sum(w / w1 * s)) AS rmse,
  sum(w / w1 * (m - bias) * (m - bias)) FILTER (m IS NOT NULL) AS spread, sum(w / w1 * (1 - w / w1) * v / r) FILTER (r > 0) AS own FROM f, b)
SELECT round(bias, 3) AS bias, round(random_variance, 3) AS random_variance, round(spread - own, 3) AS scene_variance, round(rmse, 3) AS rmse, spread - own < 0 AS scene_negative FROM q"""


def _order_errors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000.0 - 150.0).alias("e"), ((F.col("o_orderkey") % 7) / 7.0).alias("w")
    )


_ORDER_ERRORS = "e AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice / 1000.0 - 150.0 AS e, (o_orderkey % 7) / 7.0 AS w FROM orders)"


def weighted_errors(spark, sf_dir):
    out = weighted.weighted_errors(_order_errors(spark, sf_dir), ["o_orderstatus"], F.col("e"), F.col("w"))
    return rounded(out, ["o_orderstatus", "n"], ["bias", "sd", "rmse", "max_abs", "ess"])


WEIGHTED_ERRORS = f"""WITH {_ORDER_ERRORS}, b AS (SELECT o_orderstatus, sum(w * e) / sum(w) AS bias, sum(w) AS w1 FROM e GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, round(any_value(bias), 4) AS bias,
  round(sqrt(sum(w / w1 * (e - bias) * (e - bias)) / (1 - sum(w / w1 * w / w1))), 4) AS sd, round(sqrt(sum(w / w1 * e * e)), 4) AS rmse,
  round(max(CASE WHEN w > 0 THEN abs(e) END), 4) AS max_abs, round(1 / sum(w / w1 * w / w1), 4) AS ess FROM e JOIN b USING (o_orderstatus) GROUP BY 1"""


def weighted_breakdown(spark, sf_dir):
    out = weighted.weighted_breakdown(_order_errors(spark, sf_dir), "o_orderstatus", "o_orderpriority", F.col("e"), F.col("w"))
    return rounded(out, ["o_orderstatus", "o_orderpriority", "set_id", "n"], ["bias", "rmse", "share"], 5)


WEIGHTED_BREAKDOWN = f"""WITH {_ORDER_ERRORS}, g AS (SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS set_id, count(*) AS n, sum(w) AS w,
  sum(w * e) / sum(w) AS bias, sqrt(sum(w * e * e) / sum(w)) AS rmse FROM e GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority)))
SELECT o_orderstatus, o_orderpriority, set_id, n, round(bias, 5) AS bias, round(rmse, 5) AS rmse, round(w / max(w) OVER (), 5) AS share FROM g"""


def weighted_p95(spark, sf_dir):
    out = weighted.weighted_quantile(_order_errors(spark, sf_dir), ["o_orderpriority"], "e", "w", 0.95)
    return rounded(out, ["o_orderpriority"], ["quantile"])


WEIGHTED_P95 = f"""WITH {_ORDER_ERRORS}, p AS (SELECT o_orderpriority, e, sum(w) AS w FROM e WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT *, (sum(w) OVER (PARTITION BY o_orderpriority ORDER BY e) - w / 2) / sum(w) OVER (PARTITION BY o_orderpriority) AS p FROM p),
l AS (SELECT *, lag(p) OVER (PARTITION BY o_orderpriority ORDER BY e) AS p0, lag(e) OVER (PARTITION BY o_orderpriority ORDER BY e) AS e0 FROM c)
SELECT o_orderpriority, round(coalesce(max(CASE WHEN p >= 0.95 AND (p0 IS NULL OR p0 < 0.95) THEN coalesce(e0 + (0.95 - p0) / (p - p0) * (e - e0), e) END), max(e)), 4) AS quantile FROM l GROUP BY 1"""


def paired_covariance(spark, sf_dir):
    first, second = F.col("e"), F.sqrt(F.abs("e")) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    out = weighted.paired_covariance(_order_errors(spark, sf_dir), ["o_orderstatus"], first, second, F.col("w"))
    return rounded(out, ["o_orderstatus"], ["mean_first", "mean_second", "var_first", "var_second", "covariance", "var_total"], 3)


PAIRED_COVARIANCE = f"""WITH {_ORDER_ERRORS}, p AS (SELECT o_orderstatus AS s, e AS a, sqrt(abs(e)) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS b, w FROM e),
m AS (SELECT s, sum(w) AS w1, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM p GROUP BY 1),
c AS (SELECT s, any_value(ma) AS ma, any_value(mb) AS mb, 1 - sum(w / w1 * w / w1) AS free, sum(w / w1 * (a - ma) * (a - ma)) AS aa, sum(w / w1 * (b - mb) * (b - mb)) AS bb, sum(w / w1 * (a - ma) * (b - mb)) AS ab FROM p JOIN m USING (s) GROUP BY s)
SELECT s AS o_orderstatus, round(ma, 3) AS mean_first, round(mb, 3) AS mean_second, round(aa / free, 3) AS var_first, round(bb / free, 3) AS var_second, round(ab / free, 3) AS covariance, round((aa + bb + 2 * ab) / free, 3) AS var_total FROM c"""


def source_covariances(spark, sf_dir):
    """All pairs of four error sources."""
    e = _errors(spark, sf_dir)
    out = moments.scatter(e, {"e": F.col("e"), "discount": F.when(F.col("e").isNotNull(), F.col("l_discount") * 100), "tax": F.when(F.col("e").isNotNull(), F.col("l_tax") * 100), "quantity": F.when(F.col("e").isNotNull(), F.col("l_quantity"))})
    return rounded(out, ["i", "j", "n"], ["mean_i", "mean_j", "covariance"])


_SOURCES = {"e": "e", "discount": "l_discount * 100", "tax": "l_tax * 100", "quantity": "l_quantity"}
SOURCE_COVARIANCES = f"WITH e AS (SELECT *, {_E} AS e FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{i}' AS i, '{j}' AS j, count(*) AS n, round(avg({a}), 4) AS mean_i, round(avg({b}), 4) AS mean_j, round(covar_pop({b}, {a}), 4) AS covariance FROM e WHERE e IS NOT NULL"
    for k, (i, a) in enumerate(_SOURCES.items()) for j, b in list(_SOURCES.items())[k:]
)


def scatter_matrix(spark, sf_dir):
    e = F.col("embedding")
    out = moments.scatter(table(spark, sf_dir, "embeddings"), {f"{i:02d}": e[i].cast("double") for i in range(10)})
    return rounded(out, ["i", "j", "n"], ["mean_i", "mean_j", "covariance"], 6)


SCATTER = " UNION ALL ".join(
    f"SELECT '{i:02d}' AS i, '{j:02d}' AS j, count(*) AS n, round(avg(embedding[{i + 1}]::DOUBLE), 6) AS mean_i, round(avg(embedding[{j + 1}]::DOUBLE), 6) AS mean_j, round(covar_pop(embedding[{j + 1}]::DOUBLE, embedding[{i + 1}]::DOUBLE), 6) AS covariance FROM embeddings"
    for i in range(10) for j in range(i, 10)
)


def exact_percentiles(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    price = sampling.quantiles(df, ["l_returnflag"], F.col("l_extendedprice"), [0.01, 0.5, 0.95])
    quantity = sampling.quantiles(df, ["l_returnflag"], F.col("l_quantity"), [0.5]).select(F.col("l_returnflag").alias("_flag"), F.col("q0").alias("median"))
    out = price.join(quantity, F.col("l_returnflag").eqNullSafe(F.col("_flag")))
    return out.select("l_returnflag", r("q0").alias("p01"), r("q1").alias("p50"), r("q2").alias("p95"), r("median").alias("median_quantity"))


PERCENTILES = """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(median(l_quantity), 4) AS median_quantity FROM lineitem GROUP BY 1"""


def between_day_spread(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"))
    out = daily.groupBy("event_type").agg(F.count("*").alias("days"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("low"), F.max("m").alias("high"))
    return rounded(out.withColumn("relative", safe_ratio(F.col("sd"), F.col("mean"))), ["event_type", "days"], ["mean", "sd", "low", "high", "relative"], 5)


SPREAD = """WITH d AS (SELECT event_type, ts::DATE AS d, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS days, round(avg(m), 5) AS mean, round(stddev_samp(m), 5) AS sd, round(min(m), 5) AS low, round(max(m), 5) AS high, round(coalesce(stddev_samp(m) / nullif(avg(m), 0), 0), 5) AS relative FROM d GROUP BY 1"""


def transition_matrix(spark, sf_dir):
    return rounded(scenes.transition_matrix(table(spark, sf_dir, "events"), "user_id", "ts", "event_type"), ["a", "b", "n"], ["probability", "cumulative"], 6)


TRANSITIONS = """WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS probability, round(sum(n) OVER (PARTITION BY a ORDER BY b) / sum(n) OVER (PARTITION BY a), 6) AS cumulative FROM c"""


def change_probability(spark, sf_dir):
    cells = scenes.transition_matrix(table(spark, sf_dir, "events"), "user_id", "ts", "event_type").select("a", "b", "n")
    return rounded(scenes.change_probability(cells), [], ["change_probability"], 6)


CHANGE = """WITH l AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)
SELECT round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS change_probability FROM l WHERE b IS NOT NULL"""


def angular_support(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("bin", F.floor(F.col("l_quantity") / 5).cast("int"))
    return rounded(scenes.angular_support(df, "l_returnflag", "bin", 7), ["l_returnflag", "n", "occupied"], ["coverage", "effective_bins"], 5)


SUPPORT = """WITH c AS (SELECT l_returnflag, floor(l_quantity / 5) AS bin, count(*) AS n FROM lineitem WHERE floor(l_quantity / 5) < 7 GROUP BY 1, 2)
SELECT l_returnflag, sum(n)::BIGINT AS n, count(*) AS occupied, round(count(*) / 7, 5) AS coverage, round(pow(sum(n), 2) / sum(n * n), 5) AS effective_bins FROM c GROUP BY 1"""


def label_order(spark, sf_dir):
    out = scenes.label_order(table(spark, sf_dir, "part"), "p_type", F.col("p_retailprice"))
    return out.select("p_type", r("score").alias("score"), F.col("position").cast("long"))


LABEL_ORDER = "SELECT p_type, round(avg(p_retailprice), 4) AS score, row_number() OVER (ORDER BY avg(p_retailprice), p_type) - 1 AS position FROM part GROUP BY 1"


def _diagnostics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.sqrt(F.avg(F.col("p_retailprice") * F.col("p_retailprice"))).alias("rmse"), F.count("*").alias("n"))


_DIAGNOSTICS = "d AS (SELECT p_size, sqrt(avg(p_retailprice * p_retailprice)) AS rmse, count(*) AS n FROM part GROUP BY 1)"


def plateau(spark, sf_dir):
    out = scenes.plateau(_diagnostics(spark, sf_dir), "p_size", "rmse")
    return rounded(out, ["p_size", "n", "plateau"], ["rmse", "improvement"], 6)


PLATEAU = f"""WITH {_DIAGNOSTICS}, l AS (SELECT *, lag(rmse) OVER (ORDER BY p_size) AS b FROM d)
SELECT p_size, n, round(rmse, 6) AS rmse, round((b - rmse) / b, 6) AS improvement, (b - rmse) / b < 0.01 AS plateau FROM l"""


def neighbour_delta(spark, sf_dir):
    out = scenes.neighbours(_diagnostics(spark, sf_dir).filter("p_size % 7 <> 3"), "p_size", ["rmse", "n"])
    return rounded(out, ["p_size", "n_below", "n_above"], ["rmse_below", "rmse_above"])


NEIGHBOURS = f"""WITH {_DIAGNOSTICS}, k AS (SELECT * FROM d WHERE p_size % 7 <> 3)
SELECT a.p_size, a.n - b.n AS n_below, a.n - c.n AS n_above, round(a.rmse - b.rmse, 4) AS rmse_below, round(a.rmse - c.rmse, 4) AS rmse_above
FROM k a LEFT JOIN k b ON b.p_size = a.p_size - 1 LEFT JOIN k c ON c.p_size = a.p_size + 1"""


def scenario_diff(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    observed = s.filter("c_custkey % 9 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")))
    return joins.difference(s.filter("c_custkey % 10 <> 2"), observed, "c_custkey", ["c_nationkey", "c_mktsegment"])


SCENARIO_DIFF = """WITH e AS (SELECT * FROM customer WHERE c_custkey % 10 <> 2), o AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 1),
s AS (SELECT coalesce(e.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'missing' WHEN e.c_custkey IS NULL THEN 'unexpected'
  WHEN e.c_nationkey IS DISTINCT FROM o.c_nationkey OR e.c_mktsegment IS DISTINCT FROM o.c_mktsegment THEN 'mismatch' END AS status FROM e FULL JOIN o ON e.c_custkey = o.c_custkey)
SELECT * FROM s WHERE status IS NOT NULL"""


def reservoir(spark, sf_dir):
    return sampling.smallest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") * 2654435761 % 4294967296, 100, ["o_orderkey"])


RESERVOIR = "SELECT o_orderkey, o_custkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey LIMIT 100"


def per_day_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sampling.capped(e, "day", F.col("event_id") * 2654435761 % 4294967296, 5, ["event_id"]).select("day", "event_id", F.col("rank").cast("long"))


PER_DAY_CAP = """WITH k AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY (event_id * 2654435761) % 4294967296, event_id) AS rank FROM events)
SELECT * FROM k WHERE rank <= 5"""


def second_choice(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", scenes.first_argmax(e).cast("long").alias("first"), scenes.second_choice(e).cast("long").alias("second"))


SECOND_CHOICE = """WITH u AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM u)
SELECT vec_id, max(CASE WHEN k = 1 THEN i END) AS first, max(CASE WHEN k = 2 THEN i END) AS second FROM k GROUP BY 1"""


def switched_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit("switched to").alias("second"))
    out = sampling.switch_labels(o, "o_orderpriority", "second", 0.1, F.col("o_orderkey") * 2654435761 % 4294967296, ["o_orderkey"])
    return out.groupBy("o_orderpriority", "switched").agg(F.count("*").alias("n"))


SWITCHED = """WITH k AS (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) <= floor(0.1 * (SELECT count(*) FROM orders)) AS switched FROM orders)
SELECT CASE WHEN switched THEN 'switched to' ELSE o_orderpriority END AS o_orderpriority, switched, count(*) AS n FROM k GROUP BY 1, 2"""


def response_interpolation(spark, sf_dir):
    series = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4.0).alias("wl"), (F.col("n_regionkey") + 1.0).alias("response"))
    points = table(spark, sf_dir, "part").select((F.col("p_size") * 2.5 - 5.0).alias("wl")).distinct()
    return rounded(joins.interpolate(points, series, "wl", "response"), ["wl"], ["response"], 6)


INTERPOLATION = """WITH s AS (SELECT n_nationkey * 4.0::DOUBLE AS wl, n_regionkey + 1.0::DOUBLE AS v FROM nation), p AS (SELECT DISTINCT p_size * 2.5 - 5.0::DOUBLE AS wl FROM part),
b AS (SELECT p.wl, (SELECT max(s.wl) FROM s WHERE s.wl <= p.wl) AS lo, (SELECT min(s.wl) FROM s WHERE s.wl >= p.wl) AS hi FROM p)
SELECT b.wl, round(CASE WHEN lo IS NULL OR hi IS NULL THEN 0.0 WHEN lo = hi THEN a.v ELSE a.v + (b.wl - lo) * (c.v - a.v) / (hi - lo) END, 6) AS response
FROM b LEFT JOIN s a ON a.wl = lo LEFT JOIN s c ON c.wl = hi"""


def simpson_integrals(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.datediff("ts", F.lit("1970-01-01")).alias("d")).agg(F.avg("value").alias("v"))
    return rounded(integrate.integrals(daily, ["event_type"], "d", F.col("v")), ["event_type", "n"], ["integral"], 3)


SIMPSON = """WITH d AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY x)),
h AS (SELECT *, x1 - x AS h0, x2 - x1 AS h1 FROM k),
s AS (SELECT event_type, any_value(n) AS n, sum(CASE WHEN i % 2 = 1 AND x2 IS NOT NULL AND i + 2 <= n - (1 - n % 2) THEN (h0 + h1) / 6 * (y * (2 - h1 / h0) + y1 * (h0 + h1) * (h0 + h1) / (h0 * h1) + y2 * (2 - h0 / h1)) ELSE 0 END)
  + sum(CASE WHEN n % 2 = 0 AND i = n - 2 THEN (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) * y2 + (h1 * h1 + 3 * h0 * h1) / (6 * h0) * y1 - h1 * h1 * h1 / (6 * h0 * (h0 + h1)) * y ELSE 0 END) AS integral FROM h GROUP BY 1)
SELECT event_type, n::INTEGER AS n, round(integral, 3) AS integral FROM s"""


def angle_match(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 + F.when(F.col("s_suppkey") % 3 == 0, 1e-9).otherwise(0.0)).alias("angle"))
    available = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 5.0).alias("angle"))
    return joins.within_tolerance(wanted, available, "angle").select("s_suppkey", "matches", "matched")


ANGLE_MATCH = """WITH w AS (SELECT s_suppkey, s_suppkey % 90 + CASE WHEN s_suppkey % 3 = 0 THEN 1e-9 ELSE 0.0 END AS a FROM supplier), b AS (SELECT n_nationkey * 5.0::DOUBLE AS b FROM nation)
SELECT s_suppkey, count(b) AS matches, min(b) AS matched FROM w LEFT JOIN b ON abs(a - b) <= 1e-8 + 1e-5 * abs(b) GROUP BY 1"""


def feature_projection(spark, sf_dir):
    bt = [F.col("embedding")[i].cast("double") for i in (0, 3, 4, 6, 7, 8)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r(f, 6).alias(f"f{i}") for i, f in enumerate(spectral_features(bt))])


_BT = [f"embedding[{i + 1}]::DOUBLE" for i in (0, 3, 4, 6, 7, 8)]
FEATURES = "SELECT vec_id, " + ", ".join(f"round({f}, 6) AS f{i}" for i, f in enumerate([*_BT, *[f"{_BT[3]} - {_BT[j]}" for j in (1, 4, 0, 5)]])) + " FROM embeddings"


def js_divergence(spark, sf_dir):
    return rounded(scenes.divergence(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "F", "O"), [], ["js_divergence"], 8)


JS = """WITH n AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM n)
SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 8) AS js_divergence FROM s"""


def histogram(spark, sf_dir):
    """Fixed bins with an underflow and an overflow bin."""
    bin_ = F.width_bucket(F.col("l_extendedprice"), F.lit(10000.0), F.lit(90000.0), F.lit(40)).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", bin_.alias("bin")).agg(F.count("*").alias("n"))


HISTOGRAM = """SELECT l_returnflag, CASE WHEN l_extendedprice < 10000 THEN 0 WHEN l_extendedprice >= 90000 THEN 41 ELSE floor((l_extendedprice - 10000) / 2000) + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2"""


def slugs(spark, sf_dir):
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "_"), "^_+|_+$", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey", slug.alias("slug"), F.regexp_extract("p_brand", r"([0-9]+)", 1).alias("number"), F.substring_index("p_type", " ", -1).alias("last"), F.substring_index("p_name", " ", -1).rlike("^[0-9]+$").alias("numbered")
    )


SLUGS = """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_extract(p_brand, '([0-9]+)', 1) AS number,
  string_split(p_type, ' ')[-1] AS last, regexp_matches(string_split(p_name, ' ')[-1], '^[0-9]+$') AS numbered FROM part"""


def budget_quadrature(spark, sf_dir):
    parts = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, "bias").otherwise("variance").alias("kind"),
        F.when(F.col("s_suppkey") % 2 == 0, "random").otherwise("systematic").alias("averaging_class"),
        F.filter(F.array(F.lit("all"), F.when(F.col("s_suppkey") % 5 == 0, "fifth")), lambda x: x.isNotNull()).alias("requirement_ids"),
        (F.abs("s_acctbal") / 1000.0).alias("value"),
    )
    one = lambda req, avg: weighted.budget(parts, req, avg).withColumns({"requirement": F.lit(req), "averaging": F.lit(avg)})
    out = one("all", "random").unionByName(one("fifth", "systematic")).unionByName(one("all", None).withColumn("averaging", F.lit("any")))
    return rounded(out, ["requirement", "averaging", "n"], ["variance", "uncertainty", "bias"], 6)


_BUDGET = """SELECT '{0}' AS requirement, '{1}' AS averaging, count(*) AS n, round(sum(value) FILTER (kind = 'variance'), 6) AS variance, round(sqrt(sum(value) FILTER (kind = 'variance')), 6) AS uncertainty, round(sum(value) FILTER (kind = 'bias'), 6) AS bias FROM p WHERE {2}"""
BUDGET = """WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'bias' ELSE 'variance' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'random' ELSE 'systematic' END AS a, abs(s_acctbal) / 1000.0 AS value FROM supplier) """ + " UNION ALL ".join(
    (_BUDGET.format("all", "random", "a = 'random'"), _BUDGET.format("fifth", "systematic", "a = 'systematic' AND s_suppkey % 5 = 0"), _BUDGET.format("all", "any", "true"))
)

#: A mixture of three components in two dimensions.
MIXTURE = (
    {"weight": 0.5, "mean": [0.0, 0.0], "precision_cholesky": [[1.0, 0.2], [0.0, 1.5]]},
    {"weight": 0.3, "mean": [0.1, -0.1], "precision_cholesky": [[2.0, 0.0], [0.0, 1.0]]},
    {"weight": 0.2, "mean": [-0.2, 0.1], "precision_cholesky": [[1.0, -0.3], [0.0, 0.8]]},
)


def mixture_entropy(spark, sf_dir):
    z = [F.col("embedding")[i].cast("double") for i in (0, 1)]
    density, post = scenes.responsibilities(z, MIXTURE)
    df = table(spark, sf_dir, "embeddings").select("vec_id", density.alias("density"), post.alias("post"))
    entropy = -F.aggregate("post", F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    df = df.withColumns({"label": scenes.first_argmax(F.col("post")).cast("long"), "entropy": entropy})
    out = df.groupBy("label").agg(F.count("*").alias("n"), F.sum("density").alias("loglik"), F.sum("entropy").alias("entropy"), F.count_if(F.array_max("post") < 0.8).alias("ambiguous"))
    return rounded(out, ["label", "n", "ambiguous"], ["loglik", "entropy"], 5)


def _mixture_sql() -> str:
    import math

    logs = []
    for c in MIXTURE:
        u, m = c["precision_cholesky"], c["mean"]
        const = math.log(c["weight"]) + math.log(u[0][0]) + math.log(u[1][1]) - math.log(2 * math.pi)
        logs.append(f"{const!r} - pow((a - {m[0]}) * {u[0][0]}, 2) / 2 - pow((a - {m[0]}) * {u[0][1]} + (b - {m[1]}) * {u[1][1]}, 2) / 2")
    body = ", ".join(f"{x} AS l{i}" for i, x in enumerate(logs))
    return f"""WITH z AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), l AS (SELECT *, {body} FROM z),
d AS (SELECT *, greatest(l0, l1, l2) + ln(exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS d FROM l),
p AS (SELECT *, exp(l0 - d) AS p0, exp(l1 - d) AS p1, exp(l2 - d) AS p2 FROM d),
k AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END::BIGINT AS label, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) AS e FROM p)
SELECT label, count(*) AS n, round(sum(d), 5) AS loglik, round(sum(e), 5) AS entropy, count(*) FILTER (greatest(p0, p1, p2) < 0.8) AS ambiguous FROM k GROUP BY 1"""


def product_closure(spark, sf_dir):
    """A stored single-precision product against its recomputation."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 7.0).alias("v"))
    written = own.filter("o_orderkey % 11 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 13 != 0, F.col("v").cast("float").cast("double")))
    return rounded(joins.closure(own, written, ["o_orderkey"], "v"), ["n", "validity_mismatch", "unmatched"], ["max_difference"], 6)


CLOSURE = """WITH o AS (SELECT o_orderkey, o_totalprice / 7.0 AS v FROM orders), w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN v::FLOAT::DOUBLE END AS u FROM o WHERE o_orderkey % 11 <> 0)
SELECT count(w.o_orderkey) AS n, count(*) FILTER (w.o_orderkey IS NOT NULL AND u IS NULL) AS validity_mismatch, count(*) FILTER (w.o_orderkey IS NULL) AS unmatched, round(max(abs(v - u)), 6) AS max_difference FROM o LEFT JOIN w USING (o_orderkey)"""


def residual_pairs(spark, sf_dir):
    """Two stages of each order paired strictly on their key."""
    o = table(spark, sf_dir, "orders")
    long = o.select("o_orderkey", F.lit("spectral").alias("stage"), (F.col("o_totalprice") / 1000.0).alias("err")).unionByName(
        o.select("o_orderkey", F.lit("end_to_end").alias("stage"), (F.col("o_totalprice") / 900.0).alias("err"))
    )
    out = joins.strict_pairs(long, ["o_orderkey"], "stage", "spectral", "end_to_end", ["err"])
    return out.select("o_orderkey", r(F.col("err_second") - F.col("err_first"), 5).alias("increment"))


RESIDUAL_PAIRS = "SELECT o_orderkey, round(o_totalprice / 900.0 - o_totalprice / 1000.0, 5) AS increment FROM orders"


def crossing_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("fold", F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 5).otherwise(F.col("o_custkey") % 5))
    return joins.crossing_groups(o, "o_custkey", "fold")


CROSSING = "SELECT o_custkey, count(DISTINCT CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 5 ELSE o_custkey % 5 END) AS folds FROM orders GROUP BY 1 HAVING folds > 1"


def occupancy(spark, sf_dir):
    """Counts by day and type, by type, and over all, with each type's share of its day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = e.rollup("event_type", "day").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).over(Window.partitionBy("day"))
    return out.select("event_type", "day", "n", r(F.when(F.col("day").isNotNull(), share), 6).alias("share"))


OCCUPANCY = """WITH c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d')))
SELECT event_type, day, n, round(CASE WHEN day IS NOT NULL THEN n / sum(n) OVER (PARTITION BY day) END, 6) AS share FROM c"""

QUERIES = {
    "group_moments": (group_moments, GROUP_MOMENTS),
    "merge_moments": (merge_moments, MERGE_MOMENTS),
    "sample_summary": (sample_summary, SAMPLE_SUMMARY),
    "paired_variant": (paired_variant, PAIRED_VARIANT),
    "contingency": (contingency, CONTINGENCY),
    "rand_index": (rand_index, RAND_INDEX),
    "majority_vote": (majority_vote, MAJORITY),
    "population_weights": (population_weights, POPULATION_WEIGHTS),
    "error_classes": (error_classes, ERROR_CLASSES),
    "weighted_errors": (weighted_errors, WEIGHTED_ERRORS),
    "weighted_breakdown": (weighted_breakdown, WEIGHTED_BREAKDOWN),
    "weighted_p95": (weighted_p95, WEIGHTED_P95),
    "paired_covariance": (paired_covariance, PAIRED_COVARIANCE),
    "source_covariances": (source_covariances, SOURCE_COVARIANCES),
    "scatter_matrix": (scatter_matrix, SCATTER),
    "exact_percentiles": (exact_percentiles, PERCENTILES),
    "between_day_spread": (between_day_spread, SPREAD),
    "transition_matrix": (transition_matrix, TRANSITIONS),
    "change_probability": (change_probability, CHANGE),
    "angular_support": (angular_support, SUPPORT),
    "label_order": (label_order, LABEL_ORDER),
    "plateau": (plateau, PLATEAU),
    "neighbour_delta": (neighbour_delta, NEIGHBOURS),
    "scenario_diff": (scenario_diff, SCENARIO_DIFF),
    "reservoir": (reservoir, RESERVOIR),
    "per_day_cap": (per_day_cap, PER_DAY_CAP),
    "second_choice": (second_choice, SECOND_CHOICE),
    "switched_labels": (switched_labels, SWITCHED),
    "response_interpolation": (response_interpolation, INTERPOLATION),
    "simpson_integrals": (simpson_integrals, SIMPSON),
    "angle_match": (angle_match, ANGLE_MATCH),
    "feature_projection": (feature_projection, FEATURES),
    "js_divergence": (js_divergence, JS),
    "histogram": (histogram, HISTOGRAM),
    "slugs": (slugs, SLUGS),
    "budget_quadrature": (budget_quadrature, BUDGET),
    "mixture_entropy": (mixture_entropy, _mixture_sql()),
    "product_closure": (product_closure, CLOSURE),
    "residual_pairs": (residual_pairs, RESIDUAL_PAIRS),
    "crossing_groups": (crossing_groups, CROSSING),
    "occupancy": (occupancy, OCCUPANCY),
}
