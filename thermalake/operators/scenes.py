"""Scene labels: votes, agreement, transitions and diagnostics of classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermalake.functions.physics import limb_value
from thermalake.operators.sampling import quantiles


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """One row (n, ari) of a contingency table (a, b, n); 1 where the index is degenerate."""
    pairs = lambda n: n * (n - 1) / 2.0
    sets = cells.groupingSets([[], [F.col("a")], [F.col("b")], [F.col("a"), F.col("b")]], F.col("a"), F.col("b")).agg(
        F.grouping_id().alias("g"), F.sum("n").cast("double").alias("n")
    )
    part = lambda g: F.sum(F.when(F.col("g") == g, pairs(F.col("n"))).otherwise(0.0))
    sums = sets.agg(
        F.max("n").alias("n"), part(3).alias("t"), part(1).alias("ra"), part(2).alias("rb"), part(0).alias("s")
    )
    expected = F.try_divide(F.col("ra") * F.col("rb"), F.col("t"))
    most = (F.col("ra") + F.col("rb")) / 2.0
    ari = F.try_divide(F.col("s") - expected, most - expected)
    return sums.select(F.col("n").cast("long").alias("n"), F.coalesce(ari, F.lit(1.0)).alias("ari"))


def majority(df: DataFrame, file: str, label: str, posterior: Column) -> DataFrame:
    """(file, label, votes, views, vote_fraction, ties): the most frequent label, then mean posterior, then smallest."""
    votes = df.groupBy(file, label).agg(F.count("*").alias("votes"), F.avg(posterior).alias("mean_posterior"))
    order = Window.partitionBy(file).orderBy(F.desc("votes"), F.desc("mean_posterior"), F.asc(label))
    every = Window.partitionBy(file)
    ranked = votes.withColumns(
        {"_rank": F.row_number().over(order), "views": F.sum("votes").over(every), "_top": F.max("votes").over(every), "distinct_labels": F.count("*").over(every)}
    )
    ties = F.sum(F.when(F.col("votes") == F.col("_top"), 1).otherwise(0)).over(every)
    names = F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("votes") == F.col("_top"), F.col(label).cast("string"))).over(every)), ";"
    )
    return (
        ranked.withColumns({"ties": ties, "tied_labels": names})
        .filter("_rank = 1")
        .select(file, label, "votes", "views", (F.col("votes") / F.col("views")).alias("vote_fraction"), "distinct_labels", "ties", "tied_labels")
    )


def transition_matrix(df: DataFrame, sequence: str, order: str, label: str) -> DataFrame:
    """(a, b, n, probability, cumulative) of following labels of each sequence; rows sum to 1."""
    following = F.lead(label).over(Window.partitionBy(sequence).orderBy(order))
    cells = df.select(F.col(label).alias("a"), following.alias("b")).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    row = Window.partitionBy("a")
    share = F.col("n") / F.sum("n").over(row)
    so_far = F.sum("n").over(row.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(row)
    return cells.withColumns({"probability": share, "cumulative": so_far})


def change_probability(cells: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Share of transitions (a, b, n) that leave their label: of the sample, or weighted by a population (a, share)."""
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("stay"))
    if population is not None:
        rows = rows.join(population.select(F.col("a").alias("_a"), "share"), F.col("a") == F.col("_a"))
        return rows.agg(F.sum(F.col("share") * (1.0 - F.col("stay") / F.col("n"))).alias("change_probability"))
    return rows.agg((1.0 - F.sum("stay") / F.sum("n")).alias("change_probability"))


def label_order(df: DataFrame, label: str, score: Column) -> DataFrame:
    """(label, score, position): labels from the lowest mean score to the highest."""
    means = df.groupBy(label).agg(F.avg(score).alias("score"))
    return means.withColumn("position", F.row_number().over(Window.orderBy("score", label)) - 1)


def angular_support(df: DataFrame, label: str, bins: str, n_bins: int) -> DataFrame:
    """Rows, occupied bins, their share of all bins, and the effective number (sum n)^2 / sum n^2 per label."""
    cells = df.filter(F.col(bins) < n_bins).groupBy(label, bins).agg(F.count("*").alias("n"))
    return cells.groupBy(label).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("occupied"),
        (F.count("*") / n_bins).alias("coverage"),
        (F.pow(F.sum("n").cast("double"), F.lit(2.0)) / F.sum(F.col("n") * F.col("n"))).alias("effective_bins"),
    )


def plateau(diagnostics: DataFrame, k: str, rmse: str, least: float = 0.01) -> DataFrame:
    """The relative improvement over the next smaller k, and whether it is below `least`."""
    before = F.lag(rmse).over(Window.orderBy(k))
    gain = F.try_divide(before - F.col(rmse), before)
    return diagnostics.withColumns({"improvement": gain, "plateau": gain < least})


def neighbours(diagnostics: DataFrame, k: str, columns: Sequence[str]) -> DataFrame:
    """Differences of each row to those of k - 1 and k + 1, null where there is no such row."""
    other = diagnostics.select(F.col(k).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = diagnostics
    for name, step in (("below", -1), ("above", 1)):
        met = out.join(other, F.col(k) + step == F.col("_k"), "left")
        out = met.withColumns({f"{c}_{name}": F.col(c) - F.col(f"_{c}") for c in columns}).drop("_k", *[f"_{c}" for c in columns])
    return out


def log_weights(z: Sequence[Column], components: Sequence[dict]) -> list[Column]:
    """log of weight times density of each of some Gaussians.

    Each component has weight, mean and precision_cholesky (upper triangular
    rows as in precision = U U^T); parameters are few and become literals.
    """
    import math

    logs = []
    for c in components:
        chol = c["precision_cholesky"]
        total = F.lit(math.log(c["weight"]) + sum(math.log(chol[i][i]) for i in range(len(z))) - len(z) / 2 * math.log(2 * math.pi))
        for j in range(len(z)):
            y = F.lit(0.0)
            for i in range(j + 1):
                if chol[i][j]:
                    y = y + (z[i] - c["mean"][i]) * chol[i][j]
            total = total - y * y / 2.0
        logs.append(total)
    return logs


def log_sum(logs: Sequence[Column]) -> Column:
    """log of the sum of exp of each."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    sum_exp = F.lit(0.0)
    for log in logs:
        sum_exp = sum_exp + F.exp(log - top)
    return top + F.log(sum_exp)


def responsibilities(z: Sequence[Column], components: Sequence[dict]) -> tuple[Column, Column]:
    """log density and posterior array of diagonal or full Gaussians, with the components of `log_weights`."""
    logs = log_weights(z, components)
    density = log_sum(logs)
    return density, F.array(*[F.exp(log - density) for log in logs])


def first_argmax(values: Column) -> Column:
    """Position of the largest entry, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def second_choice(values: Column) -> Column:
    """Position of the second largest entry, by value and then position."""
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.element_at(ranked, 2)["i"]


def divergence(df: DataFrame, label: str, group: str, first, second) -> DataFrame:
    """Squared Jensen-Shannon distance, in nats, between the label shares of two groups."""
    counts = df.groupBy(label).agg(
        F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2")
    )
    every = Window.partitionBy()
    p, q = F.col("n1") / F.sum("n1").over(every), F.col("n2") / F.sum("n2").over(every)
    shares = counts.select(label, p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2.0)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return shares.agg((F.sum(part("p") + part("q")) / 2.0).alias("js_divergence"))


def population_report(files: DataFrame, label: str, consistency: str) -> DataFrame:
    """Per label: files, mean and exact median consistency in percent, and the share of files that are fully consistent."""
    own = files.select(F.col(label), (100.0 * F.col(consistency)).alias("_c"))
    sums = own.groupBy(label).agg(F.count("*").alias("files"), F.avg("_c").alias("mean_consistency"), (100.0 * F.avg(F.when(F.col("_c") >= 100.0, 1.0).otherwise(0.0))).alias("fully_consistent"))
    middle = quantiles(own, [label], F.col("_c"), [0.5]).select(F.col(label).alias("_l"), F.col("q0").alias("median_consistency"))
    return sums.join(middle, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def complete_views(df: DataFrame, file: str, views: int) -> DataFrame:
    """The rows, raising for a file that has not exactly so many views."""
    counts = df.groupBy(F.col(file).alias("_f")).agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") != views, F.raise_error(F.lit(f"a file has not {views} views")).cast("boolean"))
    return df.join(counts, F.col(file) == F.col("_f")).withColumn("_bad", bad).filter("_bad IS NULL").drop("_f", "_n", "_bad")


def classification_summary(df: DataFrame, sets: Sequence[str], label: str, features: Sequence[str], posterior: Column, density: Column, threshold: float) -> DataFrame:
    """Per label, overall and by each of the columns in `sets`: rows, their share, mean and sample sd of features, mean largest posterior, share below the density threshold."""
    own = df.select(*sets, F.col(label), *features, F.array_max(posterior).alias("_p"), (density < threshold).cast("double").alias("_low"))
    groups = [[F.col(label)], *[[F.col(s), F.col(label)] for s in sets]]
    aggs = [F.grouping_id().alias("set_id"), F.count("*").alias("n"), F.avg("_p").alias("posterior"), F.avg("_low").alias("below")]
    aggs += [f(c).alias(f"{c}_{name}") for c in features for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    out = own.groupingSets(groups, *[F.col(s) for s in sets], F.col(label)).agg(*aggs)
    # one row per set and label stands behind this window
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("set_id", *sets)))


def shortlist(diagnostics: DataFrame, k: str, passed: str, worst: str, n: int) -> DataFrame:
    """The first `n` candidates in the order of k that passed; if none did, the `n` of the smallest worst value."""
    rank = F.when(F.col(passed), F.col(k).cast("double")).otherwise(F.col(worst))
    held = diagnostics.withColumns({"_any": F.max(F.col(passed).cast("int")).over(Window.partitionBy()), "_rank": rank})  # a row per candidate
    return held.filter((F.col("_any") == 0) | F.col(passed)).orderBy("_rank", k).limit(n).drop("_any", "_rank")


def centroid_shift(df: DataFrame, group: str, label: str, values: Sequence[str]) -> DataFrame:
    """(label, groups, shift): how far the groups' centroids of a label lie from their mean, on average."""
    centroids = df.groupBy(label, group).agg(*[F.avg(v).alias(v) for v in values])
    means = centroids.groupBy(F.col(label).alias("_l")).agg(*[F.avg(v).alias(f"_{v}") for v in values])
    square = sum((F.pow(F.col(v) - F.col(f"_{v}"), F.lit(2.0)) for v in values), F.lit(0.0))
    return centroids.join(means, F.col(label).eqNullSafe(F.col("_l"))).groupBy(label).agg(F.count("*").alias("groups"), F.avg(F.sqrt(square)).alias("shift"))


def paired_support(df: DataFrame, label: str, first: str, second: str, n_bins: int) -> DataFrame:
    """`angular_support` over pairs of bins of two views, of n_bins x n_bins."""
    inside = F.col(first).between(0, n_bins - 1) & F.col(second).between(0, n_bins - 1)
    return angular_support(df.filter(inside).withColumn("_pair", F.col(first) * n_bins + F.col(second)), label, "_pair", n_bins * n_bins)


def weighted_log_likelihood(df: DataFrame, day: str, level: Column) -> DataFrame:
    """(days, rows, loglik): the mean of the days' mean levels, each weighted by its rows."""
    daily = df.groupBy(day).agg(F.count(level).alias("n"), F.avg(level).alias("m"))
    return daily.agg(F.count("*").alias("days"), F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("loglik"))


def ratio_diagnostics(df: DataFrame, scene: str, ratios: dict[str, tuple[Column, Column]], first: Column, second: Column, raw_first: Column, raw_second: Column) -> DataFrame:
    """One row: rmse of predicted against observed ratios overall, in the worst channel and the worst scene, and spreads of flux differences raw and corrected.

    `ratios` has a predicted and an observed ratio per channel; gain is the share of the raw spread that the correction removes.
    """
    own = df.select(F.col(scene), *[F.pow(p - o, F.lit(2.0)).alias(f"_e{i}") for i, (p, o) in enumerate(ratios.values())], (first - second).alias("_d"), (raw_first - raw_second).alias("_r"))
    n = len(ratios)
    whole = own.agg(*[F.avg(f"_e{i}").alias(f"m{i}") for i in range(n)], F.stddev_pop("_d").alias("corrected"), F.stddev_pop("_r").alias("raw"))
    # a row per scene, and the worst of them
    each = own.groupBy(scene).agg((sum((F.avg(f"_e{i}") for i in range(n)), F.lit(0.0)) / n).alias("m")).agg(F.sqrt(F.max("m")).alias("worst_scene"), F.count("*").alias("scenes"))
    channel = [F.sqrt(F.col(f"m{i}")) for i in range(n)]
    out = whole.select(
        F.sqrt(sum((F.col(f"m{i}") for i in range(n)), F.lit(0.0)) / n).alias("ratio_rmse"), (F.greatest(*channel) if n > 1 else channel[0]).alias("worst_channel"),
        "raw", "corrected", (1.0 - F.col("corrected") / F.col("raw")).alias("gain"),
    )
    worst = each.first()
    return out.withColumns({"worst_scene": F.lit(worst["worst_scene"]).cast("double"), "scenes": F.lit(worst["scenes"])})


def shape_spread(library: DataFrame, day: str, keys: Sequence[str], parameter: str, norm: str, days: int, angles: Sequence[float]) -> DataFrame:
    """(keys, angle, days, parameter's mean, sd, min, max, norm's sd, shape's mean, sd, and once and twice its relative spread) over daily libraries.

    Raises for a key that has not every day exactly once.
    """
    sums = library.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_distinct(day).alias("days"), F.avg(parameter).alias("mean"), F.stddev_samp(parameter).alias("sd"), F.min(parameter).alias("low"), F.max(parameter).alias("high"), F.stddev_samp(norm).alias("norm_sd"),
    )
    bad = F.when((F.col("_n") != days) | (F.col("days") != days), F.raise_error(F.lit("a library lacks or repeats a day")).cast("double")).otherwise(F.col("mean"))
    # the shape 1 + b * basis is linear in b, so its mean and sd follow from those of b
    held = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(limb_value(a) - 1.0).alias("g")) for a in angles])).alias("at")
    out = sums.withColumn("mean", bad).select(*keys, "days", "mean", "sd", "low", "high", "norm_sd", held)
    shape, spread = 1.0 + F.col("mean") * F.col("at.g"), F.col("sd") * F.abs(F.col("at.g"))
    return out.select(*keys, F.col("at.angle").alias("angle"), "days", "mean", "sd", "low", "high", "norm_sd", shape.alias("shape"), spread.alias("shape_sd"), (spread / shape).alias("relative"), (2.0 * spread / shape).alias("relative2"))


def classification_rows(df: DataFrame, keys: Sequence[str], label: str, posterior: str, components: int) -> DataFrame:
    """A row per sample or view with its label and one column per component's posterior, as a table to be written."""
    return df.select(*keys, label, *[F.get(posterior, i).alias(f"posterior_{i}") for i in range(components)])


def criteria(diagnostics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with each criterion and `all_criteria`, true where all hold; an unknown one counts as not held."""
    out = diagnostics.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})
    whole = F.lit(True)
    for name in rules:
        whole = whole & F.col(name)
    return out.withColumn("all_criteria", whole)
