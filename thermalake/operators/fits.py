"""Iterative fits as repeated aggregations.

Every iteration is one pass in which tasks reduce their rows to sufficient
statistics; Spark adds these up without rounding (operators/exact.py), so that
a model is the same to the last bit however its rows are partitioned, and the
driver solves a small system whose size depends on the model alone.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.functions.physics import limb_value, polynomial, polynomial_terms
from thermalake.functions.rng import uniform
from thermalake.operators.exact import block_sums, blocked, exact_products, exact_sums, kept
from thermalake.operators.sampling import quantiles, running
from thermalake.sources import versions

_BUILT_IN = 9  # columns whose products built-in aggregates sum


def summed(df: DataFrame, columns: Sequence[Column], reduce: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `reduce` makes of blocks of them, for any partitioning; rows with nulls are left out.

    `reduce` gets rows x columns and how often each row comes.
    """
    return block_sums(blocked(df, columns), reduce)


def gram(df: DataFrame, columns: Sequence[Column], weight: Column, means: Sequence[float] | None = None) -> np.ndarray:
    """The matrix of weighted sums of products of (1, columns), each column less its mean; rows with nulls are left out.

    Few columns are summed by built-in aggregates, many as products in tasks;
    either way the sums don't depend on how rows are partitioned.
    """
    means = [0.0] * len(columns) if means is None else [float(m) for m in means]
    centred = [c.cast("double") - F.lit(m) for c, m in zip(columns, means, strict=True)]
    size = len(columns) + 1
    if size > _BUILT_IN:

        def products(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            x = np.concatenate([np.ones((len(rows), 1)), rows[:, :-1]], 1)
            return [(x * rows[:, -1:], x)]

        got = exact_products(df, [*centred, weight], products)
        return _symmetric(got[0]) if got else np.zeros((size, size))
    named = df.select(F.lit(1.0).alias("c0"), *[c.alias(f"c{i + 1}") for i, c in enumerate(centred)], weight.cast("double").alias("w")).na.drop()
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    found = exact_sums(named, {f"g{i}_{j}": F.col("w") * F.col(f"c{i}") * F.col(f"c{j}") for i, j in cells})
    out = np.zeros((size, size))
    for i, j in cells:
        out[i, j] = out[j, i] = found[f"g{i}_{j}"]
    return out


def _symmetric(m: np.ndarray) -> np.ndarray:
    """The products of weighted and plain columns; those below the diagonal are taken from above it."""
    return np.triu(m) + np.triu(m, 1).T


def solve(full: np.ndarray) -> np.ndarray:
    """Intercept and coefficients from the products of (1, terms, target); the smallest in norm if the terms depend on each other."""
    return np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=1e-14)[0]


def spread(df: DataFrame, columns: Sequence[Column], weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and population scales over rows without nulls; constant columns have scale 1."""
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)], weight.cast("double").alias("w")).na.drop()
    at = range(len(columns))
    row = named.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in at for n, f in (("low", F.min), ("high", F.max))]).first()
    first = exact_sums(named, {"w": F.col("w"), **{f"m{i}": F.col("w") * F.col(f"c{i}") for i in at}})
    if not first["w"]:
        raise ValueError("no complete rows to fit")
    mean = np.array([first[f"m{i}"] / first["w"] for i in at])
    gap = [F.col(f"c{i}") - float(mean[i]) for i in at]
    second = exact_sums(named, {f"v{i}": F.col("w") * gap[i] * gap[i] for i in at})
    scale = np.array([math.sqrt(second[f"v{i}"] / first["w"]) if row[f"low{i}"] < row[f"high{i}"] else 1.0 for i in at])
    return mean, np.where(scale > 0, scale, 1.0)


def least_squares(df: DataFrame, terms: Sequence[Column], target: Column, weight: Column | None = None) -> np.ndarray:
    """Intercept and coefficients of weighted least squares; the smallest in norm if the system is singular.

    The terms are centred and scaled first, and the result is mapped back.
    """
    weight = F.lit(1.0) if weight is None else weight
    mean, scale = spread(df, [*terms, target], weight)
    z = [(t - float(m)) / float(s) for t, m, s in zip(terms, mean, scale, strict=False)]
    found = solve(gram(df, [*z, target], weight, [*np.zeros(len(z)), mean[-1]]))
    slopes = found[1:] / scale[:-1]
    return np.r_[found[0] + mean[-1] - slopes @ mean[:-1], slopes]


@dataclass(frozen=True)
class Polynomial:
    """A polynomial in values that are centred and scaled first; terms in the order of `polynomial_terms`."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    degree: int
    intercept: float
    coefficients: tuple[float, ...]

    def scaled(self, values: Sequence[Column]) -> list[Column]:
        return [(v - F.lit(m)) / F.lit(s) for v, m, s in zip(values, self.mean, self.scale, strict=True)]

    def column(self, values: Sequence[Column]) -> Column:
        return polynomial(self.scaled(values), self.coefficients, self.intercept, self.degree)


def fit_polynomial(df: DataFrame, values: Sequence[Column], target: Column, weight: Column | None = None, degree: int = 1) -> Polynomial:
    """Weighted least squares of all monomials of the standardised values up to a degree.

    A second pass over the residuals takes up what rounding left in the first.
    """
    return fit_polynomials(df, values, {degree: target}, weight)[degree]


def _monomials(z: np.ndarray, degree: int) -> np.ndarray:
    """One and the monomials of rows x values, in the order of `polynomial_terms`."""
    out = [np.ones(len(z))]
    for size in range(1, degree + 1):
        for chosen in itertools.combinations_with_replacement(range(z.shape[1]), size):
            term = z[:, chosen[0]]
            for i in chosen[1:]:
                term = term * z[:, i]
            out.append(term)
    return np.column_stack(out)


def fit_polynomials(df: DataFrame, values: Sequence[Column], targets: Mapping[int, Column], weight: Column | None = None) -> dict[int, Polynomial]:
    """A polynomial of each degree to its own target, all from the same passes; only rows that have all values and targets count.

    Values and targets alone leave the scan: tasks make the monomials.
    """
    weight, degrees = F.lit(1.0) if weight is None else weight, list(targets)
    many = len(values)
    mean, scale = spread(df, [*values, *targets.values()], weight)
    centre, unit, level = mean[:many], scale[:many], mean[many:]
    columns, top = [*values, *targets.values(), weight], max(degrees)
    sizes = [math.comb(many + d, d) for d in degrees]
    found = [np.zeros(n) for n in sizes]
    for _ in range(2):
        now = [f.copy() for f in found]

        def products(rows: np.ndarray, now: list[np.ndarray] = now) -> list[tuple[np.ndarray, np.ndarray]]:
            x = _monomials((rows[:, :many] - centre) / unit, top)
            y = [rows[:, many + i] - level[i] - x[:, :n] @ c if c.any() else rows[:, many + i] - level[i] for i, (n, c) in enumerate(zip(sizes, now, strict=True))]
            return [(x * rows[:, -1:], np.column_stack([x, *y]))]

        got = exact_products(df, columns, products)
        for i, n in enumerate(sizes):
            own = np.zeros((n + 1, n + 1))
            own[:n, :n], own[:n, n] = got[0][:n, :n], got[0][:n, max(sizes) + i]
            found[i] = found[i] + solve(_symmetric(own))
    made = lambda d, c, at: Polynomial(tuple(map(float, centre)), tuple(map(float, unit)), d, float(c[0] + at), tuple(map(float, c[1:])))
    return {d: made(d, c, at) for d, c, at in zip(degrees, found, level, strict=True)}


def huber_polynomial(df: DataFrame, values: Sequence[Column], target: Column, weight: Column, degree: int = 1, cutoff: float = 1.345, rounds: int = 50, tol: float = 1e-6) -> Polynomial:
    """Robust regression by reweighting: the scale is 1.4826 times the median absolute residual of the first fit.

    Ends when no prediction moves by more than `tol` times the scale. The
    columns that it needs are kept by the executors while it runs.
    """
    kept = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values)], target.cast("double").alias("y"), weight.cast("double").alias("w")).na.drop().persist()
    try:
        x, y, w = [F.col(f"x{i}") for i in range(len(values))], F.col("y"), F.col("w")
        now = fit_polynomial(kept, x, y, w, degree)
        scale = 1.4826 * (quantiles(kept, [], F.abs(y - now.column(x)), [0.5]).first()[0] or 0.0)
        if scale <= 0:
            return now
        terms = polynomial_terms(now.scaled(x), degree)
        for _ in range(rounds):
            residual = F.abs(y - now.column(x))
            trust = F.least(F.lit(1.0), F.lit(cutoff * scale) / F.greatest(residual, F.lit(1e-300)))
            step = solve(gram(kept, [*terms, y - now.column(x)], w * trust))
            after = replace(now, intercept=now.intercept + float(step[0]), coefficients=tuple(float(a + b) for a, b in zip(now.coefficients, step[1:], strict=True)))
            moved = kept.agg(F.max(F.abs(after.column(x) - now.column(x)))).first()[0]
            now = after
            if moved <= tol * scale:
                break
        return now
    finally:
        kept.unpersist()


def huber(df: DataFrame, terms: Sequence[Column], target: Column, weight: Column, **settings) -> np.ndarray:
    """Intercept and coefficients of `huber_polynomial` in given terms."""
    fit = huber_polynomial(df, terms, target, weight, 1, **settings)
    slopes = np.array(fit.coefficients) / np.array(fit.scale)
    return np.r_[fit.intercept - slopes @ np.array(fit.mean), slopes]


def standardise(cells: list, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population scale and covariance of collected scatter cells; constant features get scale 1."""
    at = {n: i for i, n in enumerate(names)}
    cov, mean = np.zeros((len(at), len(at))), np.zeros(len(at))
    for c in cells:
        i, j = at[c["i"]], at[c["j"]]
        cov[i, j] = cov[j, i] = c["covariance"]
        mean[i], mean[j] = c["mean_i"], c["mean_j"]
    n = cells[0]["n"]
    var = np.diagonal(cov)
    eps = np.finfo(float).eps
    scale = np.where(var <= n * eps * var + (n * mean * eps) ** 2, 1.0, np.sqrt(var))
    return mean, scale, cov


def principal_axes(cov: np.ndarray, scale: np.ndarray, keep: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """Axes (rows) and variances of the standardised features: the fewest whose share of the variance exceeds `keep`."""
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")
    values, axes = np.maximum(values[order], 0), axes[:, order].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    count = int(np.argmax(np.cumsum(values) / values.sum() > keep)) + 1
    return (axes * sign[:, None])[:count], values[:count]


class Keeper:
    """States of unfinished fits under a path, by versions (`sources/versions.py`): saved every few rounds, loaded if they belong to the same fit."""

    def __init__(self, spark: SparkSession, path: str, every: int = 5):
        self.spark, self.path, self.every = spark, path, every

    def save(self, identity: dict, count: int, state: dict, before: dict, attempts: dict, done: dict) -> None:
        pack = lambda held: [[list(j), [v.tolist() for v in s]] for j, s in held.items()]
        record = {"identity": identity, "count": count, "state": pack(state), "done": pack(done), "before": [[list(j), None if np.isinf(v) else v] for j, v in before.items()], "attempts": [[list(j), a] for j, a in attempts.items()]}
        versions.publish_text(self.spark, self.path, json.dumps(record))

    def load(self, identity: dict) -> tuple | None:
        """(rounds so far, states, likelihoods, attempts, finished states) of the same fit; None if there is none."""
        text = versions.latest_text(self.spark, self.path)
        held = json.loads(text) if text is not None else None
        if held is None or held["identity"] != json.loads(json.dumps(identity)):
            return None
        unpack = lambda rows: {tuple(j): tuple(np.array(v) for v in s) for j, s in rows}
        before = {tuple(j): -np.inf if v is None else v for j, v in held["before"]}
        return held["count"], unpack(held["state"]), before, {tuple(j): a for j, a in held["attempts"]}, unpack(held["done"])


def starting_means(rows: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, columns): different rows drawn by a keyed hash of their values, without a sort of all rows.

    Every other start takes rows at random from those drawn, the others prefer
    rows far from those already taken.
    """
    wanted = max(4 * k * starts, 60 * k)
    drawn = rows.orderBy(uniform(seed, *rows.columns), *rows.columns).limit(wanted).collect()
    seen = list(dict.fromkeys(tuple(r) for r in drawn))
    if len(seen) < k and len(drawn) == wanted:  # rows repeat often
        seen = [tuple(r) for r in rows.distinct().orderBy(uniform(seed, *rows.columns), *rows.columns).limit(wanted).collect()]
    if len(seen) < k:
        raise ValueError("fewer distinct rows than components")
    held, order = np.array(seen), np.random.default_rng(seed)
    unit = held / np.where(held.std(0) > 0, held.std(0), 1.0)
    out = []
    for start in range(starts):
        if start % 2:
            out.append(held[order.permutation(len(held))[:k]])
            continue
        chosen = [int(order.integers(len(held)))]
        while len(chosen) < k:
            far = ((unit[:, None] - unit[chosen][None]) ** 2).sum(2).min(1)
            chosen.append(int(order.choice(len(held), p=far / far.sum())))
        out.append(held[chosen])
    return np.array(out)


def log_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """log of weight times density, rows by components."""
    out = np.empty((len(x), len(weight)))
    for j in range(len(weight)):
        chol = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(chol, (x - mean[j]).T)
        out[:, j] = np.log(weight[j]) - (z * z).sum(0) / 2 - np.log(np.diagonal(chol)).sum() - x.shape[1] / 2 * np.log(2 * np.pi)
    return out


def many_statistics(x: np.ndarray, counts: Sequence[np.ndarray], states: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """`mixture_statistics` of several states of equally many components, each with its own counts, state after state.

    Densities and moments of all components are two products with the rows'
    monomials. Where a component is so narrow for its distance from the origin
    that squares would lose its digits, each state is taken on its own, around
    its means.
    """
    (k, d), count = states[0][1].shape, len(states)
    weight, mean, cov = (np.concatenate([s[i] for s in states]) for i in range(3))
    inverse = np.linalg.inv(cov)
    pulled = np.einsum("cij,cj->ci", inverse, mean)
    if np.trace(inverse, axis1=1, axis2=2).max() * max((mean * mean).sum(1).max(), (x * x).sum(1).max(initial=0.0)) > 1e6:
        return np.concatenate([mixture_statistics(x, n, s) for n, s in zip(counts, states, strict=True)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    first = np.log(weight) - np.linalg.slogdet(cov)[1] / 2 - d / 2 * np.log(2 * np.pi) - (pulled * mean).sum(1) / 2
    factors = np.stack([first, *pulled.T, *[-inverse[:, i, j] * (0.5 if i == j else 1.0) for i, j in pairs]])
    # the components lie apart, so that each is a matrix of rows by states that runs through the cache in order
    apart = np.ascontiguousarray(factors.reshape(-1, count, k).transpose(2, 0, 1))
    level, moments, every = np.zeros(count), np.zeros((k, count, len(factors))), np.stack(counts, 1)
    step = max(256, min(2048, 12288 // count))
    for at in range(0, len(x), step):
        part, n = x[at : at + step], every[at : at + step]
        rows = np.stack([np.ones(len(part)), *part.T, *[part[:, i] * part[:, j] for i, j in pairs]], 1)
        shares = [rows @ own for own in apart]
        top, total = np.maximum.reduce(shares), 0.0
        for share in shares:
            share -= top
            total = total + np.exp(share, out=share)
        level += ((top + np.log(total)) * n).sum(0)
        n = n / total
        for j, share in enumerate(shares):
            share *= n
            moments[j] += share.T @ rows
    moments = moments.transpose(1, 0, 2).reshape(count * k, -1)
    mass, sums = moments[:, 0], moments[:, 1 : 1 + d]
    second = np.empty((count * k, d, d))
    for place, (i, j) in enumerate(pairs):
        second[:, i, j] = second[:, j, i] = moments[:, 1 + d + place]
    cross = np.einsum("ci,cj->cij", sums, mean)
    second = second - cross - cross.transpose(0, 2, 1) + mass[:, None, None] * np.einsum("ci,cj->cij", mean, mean)
    shift = sums - mass[:, None] * mean
    each = [np.r_[level[s], mass[s * k : s * k + k], shift[s * k : s * k + k].ravel(), second[s * k : s * k + k].ravel()] for s in range(count)]
    return np.concatenate(each)


def mixture_statistics(x: np.ndarray, n: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What one round of a mixture needs of rows x, each counted n times: the log likelihood, and mass, first and second moments around its mean for each component."""
    weight, mean, cov = state
    k = len(weight)
    logs = log_densities(x, weight, mean, cov)
    top = logs.max(1)
    density = top + np.log(np.exp(logs - top[:, None]).sum(1))
    share = np.exp(logs - density[:, None]) * n[:, None]
    gaps = [x - m for m in mean]
    parts = [[(density * n).sum()], share.sum(0), *[share[:, j] @ gaps[j] for j in range(k)]]
    parts += [((gaps[j] * share[:, j : j + 1]).T @ gaps[j]).ravel() for j in range(k)]
    return np.concatenate(parts)


def maximised(sums: np.ndarray, state: tuple, total: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The next state of a mixture; None if a component has lost its mass."""
    k, d = state[1].shape
    mass = sums[1 : 1 + k]
    if (mass <= 10 * np.finfo(float).eps * total).any():
        return None
    shift = sums[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
    second = sums[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None]
    return mass / total, state[1] + shift, second - np.einsum("ki,kj->kij", shift, shift) + floor * np.eye(d)


class Rows:
    """Rows of numbers for repeated passes: blocked, kept by the executors, and centred on their mean."""

    def __init__(self, df: DataFrame, columns: Sequence[Column]):
        self.d = len(columns)
        self.plain = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
        self.blocks = kept(blocked(df, columns))
        sums = block_sums(self.blocks, lambda x, n: np.r_[n.sum(), n @ x])
        self.n = int(sums[0]) if sums.size else 0
        self.centre = sums[1:] / max(self.n, 1) if sums.size else np.zeros(self.d)
        centre = self.centre
        second = block_sums(self.blocks, lambda x, n: n @ (x - centre) ** 2)
        self.variance = second / max(self.n, 1) if second.size else np.zeros(self.d)

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()

    def sums(self, reduce: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        centre = self.centre
        return block_sums(self.blocks, lambda x, n: reduce(x - centre, n))


def mixture(
    df: DataFrame, columns: Sequence[Column], k: int, seed: int = 42, starts: int = 5, rounds: int = 200, tol: float = 1e-4, floor: float = 1e-6, keep: Keeper | None = None
) -> dict:
    """A Gaussian mixture of full covariances by expectation maximisation over every row, the best of several starts.

    Each start begins with k drawn rows as means, equal weights and the
    variances of all rows. All starts go on in the same passes over the data,
    whose moments are taken around the present means. A start ends when its
    mean log likelihood changes by less than `tol`; one whose component loses
    its mass is set aside. The best start is the first whose likelihood is
    within `tol` of the largest. Raises if no start ends in time. The result has
    `attempts` with start, loglik, rounds and status of each, and is the same to
    the last bit however the rows are partitioned. With `keep` the states of all
    starts are stored every few rounds, and a fit that was cut off goes on from them.
    """
    return mixtures(df, columns, [k], seed, starts, rounds, tol, floor, keep)[k]


def mixtures(
    df: DataFrame, columns: Sequence[Column], ks: Sequence[int], seed: int = 42, starts: int = 5, rounds: int = 200, tol: float = 1e-4, floor: float = 1e-6, keep: Keeper | None = None
) -> dict[int, dict]:
    """A `mixture` for each number of components, all of them and all their starts in the same passes."""
    with Rows(df, columns) as rows:
        identity = {"columns": [str(c) for c in columns], "n": rows.n, "centre": rows.centre.tolist(), "variance": rows.variance.tolist(), "ks": list(ks), "seed": seed, "starts": starts, "tol": tol, "floor": floor}
        held = keep.load(identity) if keep else None
        if held:
            count, state, before, attempts, done = held
        else:
            count, attempts, done = 0, {}, {}
            variance = np.diag(rows.variance) + floor * np.eye(rows.d)
            state = {(k, s): (np.full(k, 1 / k), mean - rows.centre, np.stack([variance] * k)) for k in ks for s, mean in enumerate(starting_means(rows.plain, k, starts, seed))}
            before = dict.fromkeys(state, -np.inf)
        while state and count < rounds:
            count += 1
            now = sorted(state)
            states = [state[j] for j in now]
            alike = [[s for s in states if len(s[0]) == k] for k in sorted({j[0] for j in now})]  # in the order of `now`
            got = rows.sums(lambda x, n, alike=alike: np.concatenate([many_statistics(x, [n] * len(same), same) for same in alike]))
            at = 0
            for j in now:
                width = 1 + j[0] * (1 + rows.d + rows.d**2)
                sums, at = got[at : at + width], at + width
                after, level = maximised(sums, state[j], rows.n, floor), float(sums[0] / rows.n)
                if after is None:
                    attempts[j] = {"start": j[1], "loglik": None, "rounds": count, "status": "a component lost its mass"}
                    del state[j]
                    continue
                state[j] = after
                if abs(level - before[j]) < tol:
                    attempts[j] = {"start": j[1], "loglik": level, "rounds": count, "status": "converged"}
                    done[j] = state.pop(j)
                before[j] = level
            if keep and (not state or count % keep.every == 0):
                keep.save(identity, count, state, before, attempts, done)
        for j in state:
            attempts[j] = {"start": j[1], "loglik": before[j], "rounds": rounds, "status": "not converged"}
        n, centre = rows.n, rows.centre
    out = {}
    for k in ks:
        own = {j: attempts[j] for j in sorted(attempts) if j[0] == k}
        ended = [j for j in own if j in done]
        if not ended:
            raise ValueError(f"no start converged at {k} components: " + ", ".join(a["status"] for a in own.values()))
        top = max(own[j]["loglik"] for j in ended)
        best = next(j for j in ended if own[j]["loglik"] >= top - tol)
        weight, mean, cov = done[best]
        out[k] = {
            "weight": weight, "mean": mean + centre, "covariance": cov, "loglik": own[best]["loglik"], "rounds": own[best]["rounds"],
            "converged": True, "n": n, "attempts": list(own.values()),
        }
    return out


def resampling_counts(x: np.ndarray, n: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """How often a resampling with replacement draws each row that comes n times: the Poisson(n) count of a hash of its values.

    The draw depends on the values alone, so it is the same wherever the row
    lies. Above a mean of 50 the count is the nearest whole number to the normal
    quantile, which is within 3 % of a deviation there.
    """
    start = (seed * 1_000_003 + replicate * 7919 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    h = np.full(len(x), start, np.uint64)
    for column in np.ascontiguousarray(x.T + 0.0).view(np.uint64):
        h ^= column
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    few = n <= 50
    term = np.exp(-np.where(few, n, 1.0))
    total, count = term.copy(), np.zeros(len(x))
    open_ = few & (u > total)
    for step in range(1, 200):
        if not open_.any():
            break
        count += open_
        term = term * np.where(few, n, 1.0) / step
        total = total + term
        open_ &= u > total
    if not few.all():
        quantile = np.vectorize(NormalDist().inv_cdf)
        count[~few] = np.maximum(np.rint(n[~few] + np.sqrt(n[~few]) * quantile(u[~few])), 0.0)
    return count


def refits(
    df: DataFrame, columns: Sequence[Column], k: int, replicates: int, seed: int = 42, starts: int = 5, rounds: int = 200, tol: float = 1e-4, floor: float = 1e-6
) -> list[dict]:
    """A `mixture` of each resampling with replacement of the rows; all resamplings and their starts share the same passes.

    No row is copied: a resampling is a count for each row. A resampling none
    of whose starts ends in time keeps its likeliest state, with `converged` false.
    """
    with Rows(df, columns) as rows:
        means = starting_means(rows.plain, k, starts * replicates, seed)
        centre = rows.centre

        def draw(block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
            x, n = block
            drawn = np.array([resampling_counts(x, n, seed, r) for r in range(replicates)])
            return x - centre, n, drawn.astype(np.min_scalar_type(int(drawn.max(initial=0))))

        blocks = rows.blocks.map(draw).persist(StorageLevel.MEMORY_AND_DISK)
        totals = block_sums(blocks, lambda x, n, drawn: drawn.sum(1, dtype=float))
        variance = np.diag(rows.variance) + floor * np.eye(rows.d)
        state = {(r, s): (np.full(k, 1 / k), means[r * starts + s] - rows.centre, np.stack([variance] * k)) for r in range(replicates) for s in range(starts)}
        levels, done = dict.fromkeys(state, -np.inf), {}
        for _ in range(rounds):
            if not state:
                break
            now = sorted(state)

            def step(x: np.ndarray, n: np.ndarray, drawn: np.ndarray, now=now, state=dict(state)) -> np.ndarray:
                return many_statistics(x, [drawn[j[0]].astype(float) for j in now], [state[j] for j in now])

            for j, sums in zip(now, block_sums(blocks, step).reshape(len(now), -1), strict=True):
                after, level = maximised(sums, state[j], totals[j[0]], floor), float(sums[0] / totals[j[0]])
                if after is None:
                    del state[j]
                    continue
                state[j] = after
                if abs(level - levels[j]) < tol:
                    done[j] = state.pop(j)
                levels[j] = level
        blocks.unpersist()
        out = []
        for r in range(replicates):
            held = {j: s for j, s in done.items() if j[0] == r} or {j: s for j, s in state.items() if j[0] == r}
            if not held:
                raise ValueError(f"every start of resampling {r} lost a component")
            top = max(levels[j] for j in held)
            best = next(j for j in sorted(held) if levels[j] >= top - tol)
            weight, mean, cov = held[best]
            out.append({"weight": weight, "mean": mean + rows.centre, "covariance": cov, "loglik": levels[best], "converged": best in done})
    return out


def rand_index(n: np.ndarray) -> float:
    """The adjusted Rand index of a contingency table."""
    pairs = lambda a: float((a * (a - 1) / 2).sum())
    both, first, second, every = pairs(n), pairs(n.sum(1)), pairs(n.sum(0)), pairs(np.array([n.sum()]))
    expected, most = first * second / every if every else 0.0, (first + second) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def matched_jaccard(n: np.ndarray) -> list[float | None]:
    """The Jaccard index of each row's label with its match, the matching that makes their sum largest; null for a label without rows."""
    union = n.sum(1)[:, None] + n.sum(0)[None, :] - n
    jaccard = np.divide(n, union, out=np.zeros(n.shape), where=union > 0)
    match = best_matching(jaccard)
    return [float(jaccard[i, j]) if n[i].sum() else None for i, j in enumerate(match)]


def refit_stability(df: DataFrame, columns: Sequence[Column], label: Column, k: int, replicates: int, held_out: DataFrame | None = None, **settings) -> list[dict]:
    """replicate, ari, jaccard (of each label 0 to k - 1), least and converged, of the labels that each refit gives to the held-out rows against `label`.

    Without held-out rows those of the fit are compared. All refits label a row
    in the same pass; only tables of k x k counts are gathered.
    """
    models = refits(df, columns, k, replicates, **settings)
    test = df if held_out is None else held_out
    origin = np.mean([m["weight"] @ m["mean"] for m in models], axis=0)

    def tables(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        own, x = x[:, -1].astype(int), x[:, :-1] - origin
        found = []
        for m in models:
            other = log_densities(x, m["weight"], m["mean"] - origin, m["covariance"]).argmax(1)
            found.append(np.bincount(own * k + other, n, k * k))
        return np.concatenate(found)

    known = F.when(label.between(0, k - 1), label)
    got = summed(test, [*columns, known], tables)
    if not got.size:
        raise ValueError("no labelled rows to compare")
    out = []
    for r, (table, model) in enumerate(zip(got.reshape(replicates, k, k), models, strict=True)):
        jaccard = matched_jaccard(table)
        out.append({"replicate": r, "ari": rand_index(table), "jaccard": jaccard, "least": min(j for j in jaccard if j is not None), "converged": model["converged"]})
    return out


def mixture_criteria(df: DataFrame, columns: Sequence[Column], model: dict) -> dict:
    """loglik (sum), entropy of the memberships, BIC and ICL = BIC + 2 entropy of a mixture over all rows, and how many are ambiguous.

    A row is ambiguous if no component has 0.8 of it. `rows` has the number of
    rows that each component is the likeliest of.
    """
    k, d = model["mean"].shape
    centre = model["weight"] @ model["mean"]
    near = model["mean"] - centre

    def step(x: np.ndarray, count: np.ndarray) -> np.ndarray:
        logs = log_densities(x - centre, model["weight"], near, model["covariance"])
        top = logs.max(1)
        density = top + np.log(np.exp(logs - top[:, None]).sum(1))
        share = np.exp(logs - density[:, None])
        own = np.bincount(logs.argmax(1), count, k)
        return np.r_[count.sum(), count @ density, -(count @ (share * np.log(np.maximum(share, 1e-300))).sum(1)), count @ (share.max(1) < 0.8), own]

    n, loglik, entropy, ambiguous, *own = summed(df, columns, step)
    free = k - 1 + k * d + k * d * (d + 1) // 2
    bic = -2 * loglik + free * math.log(n)
    return {"n": int(n), "loglik": float(loglik), "entropy": float(entropy), "bic": float(bic), "icl": float(bic + 2 * entropy), "ambiguous": int(ambiguous), "rows": [int(c) for c in own]}


def candidates(df: DataFrame, columns: Sequence[Column], ks: Sequence[int], least_rows: int = 100, held_out: DataFrame | None = None, **settings) -> list[dict]:
    """The best start of each number of components with its criteria over the held-out rows, or over all.

    Raises before any fit if there are fewer than `least_rows` rows a component
    on average, and after it if a component is the likeliest of fewer than that
    of the rows that the criteria are taken over. All fits share their passes.
    """
    test = df if held_out is None else held_out
    present = test.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).na.drop().count()
    if present < least_rows * max(ks):
        raise ValueError(f"fewer than {least_rows} rows per component at {max(ks)} components")
    out = []
    for k, model in mixtures(df, columns, ks, **settings).items():
        found = mixture_criteria(test, columns, model)
        if min(found["rows"]) < least_rows:
            raise ValueError(f"a component of {k} has {min(found['rows'])} rows, fewer than {least_rows}")
        out.append({"k": k, "model": model, **found})
    return out


def positive_bounds(basis: Sequence[float], margin: float = 1e-6) -> tuple[float, float]:
    """Between which values of b the shape 1 + b * basis stays above the margin, over basis values of the hemisphere."""
    room = margin - 1.0
    low = max((room / g for g in basis if g > 0), default=-np.inf)
    high = min((room / g for g in basis if g < 0), default=np.inf)
    return low, high


def shape_parameters(
    df: DataFrame, keys: Sequence[str], first: Column, second: Column, ratio: Column, angles: tuple[Column, Column] | None = None,
    bounds: tuple[float, float] | None = None, least_pairs: int = 100, least_variance: float = 0.01, rounds: int = 60,
) -> DataFrame:
    """(keys, n, b, rmse, support): the shape under which (1 + b first) / (1 + b second) is nearest to the observed ratios.

    Gauss-Newton for all groups at once, one aggregation each, held between the
    last parameters on either side of the minimum. b stays where the shape is
    positive over the hemisphere. Groups of fewer than `least_pairs` pairs, or
    whose `angles` differ by about the same everywhere (a variance below
    `least_variance`), have no b, and support says why. Groups are those of a
    model, a few; a null key is a group.
    """
    low, high = bounds or positive_bounds([limb_value(90 * i / 900) - 1 for i in range(901)])
    gap = F.lit(None).cast("double") if angles is None else (angles[0] - angles[1]).cast("double")
    kinds = dict(df.dtypes)
    rows = df.select(*keys, first.cast("double").alias("_p"), second.cast("double").alias("_q"), ratio.cast("double").alias("_r"), gap.alias("_gap"))
    rows = rows.na.drop(subset=["_p", "_q", "_r"]).persist()
    try:
        counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("_gap").alias("v"), F.max(F.abs(F.col("_p") - F.col("_q"))).alias("far")).collect()
        support = {}
        for g in counted:
            few, alike = g["n"] < least_pairs, (angles is not None and g["v"] < least_variance) or not g["far"]
            support[tuple(g[k] for k in keys)] = "too few pairs" if few else "too little angular diversity" if alike else "ok"
        open_ = {k: [low, high, min(max(0.0, low), high)] for k, why in support.items() if why == "ok"}
        b, rmse = {}, {}
        schema = ", ".join([*(f"_k{i} {kinds[k]}" for i, k in enumerate(keys)), "_b double"])
        for _ in range(rounds):
            if not open_:
                break
            table = df.sparkSession.createDataFrame([(*k, at) for k, (_, _, at) in open_.items()], schema)
            on = F.lit(True)
            for i, k in enumerate(keys):
                on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            own = rows.join(F.broadcast(table), on)  # groups of a model, a few
            bottom = 1.0 + F.col("_b") * F.col("_q")
            residual, slope = (1.0 + F.col("_b") * F.col("_p")) / bottom - F.col("_r"), (F.col("_p") - F.col("_q")) / (bottom * bottom)
            own = own.select(*keys, residual.alias("_e"), slope.alias("_s"))
            sums = own.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("jj"), F.sum(F.col("_s") * F.col("_e")).alias("jr"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
            for g in sums.collect():
                key = tuple(g[k] for k in keys)
                left, right, at = open_[key]
                left, right = (left, at) if g["jr"] > 0 else (at, right)
                new = at - g["jr"] / g["jj"]
                if not left < new < right:
                    new = (left + right) / 2
                b[key], rmse[key] = at, g["rmse"]
                if g["jr"] == 0 or abs(new - at) < 1e-10 * max(1.0, abs(at)):
                    b[key] = new if g["jr"] else at
                    del open_[key]
                else:
                    open_[key] = [left, right, new]
    finally:
        rows.unpersist()
    out = [(*(g[k] for k in keys), g["n"], b.get(tuple(g[k] for k in keys)), rmse.get(tuple(g[k] for k in keys)), support[tuple(g[k] for k in keys)]) for g in counted]
    return df.sparkSession.createDataFrame(out, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, b double, rmse double, support string"]))


def view_retrieval(df: DataFrame, keys: Sequence[str], basis: Column, radiance: Column, basis_integral: float, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(keys, views, amplitude, b, flux) of each case from views at several angles, by least squares with free amplitude.

    radiance = a + a b * basis is a line in the basis, so the sums of a simple
    regression are enough; fewer than two distinct angles give null. With
    `bounds`, between which the shape is positive, a case whose b lies outside
    or whose amplitude is not positive takes the better of the bounds, with the
    amplitude refitted, and `constrained` says so.
    """
    slope, level = F.regr_slope(radiance, basis), F.regr_intercept(radiance, basis)
    pi = F.lit(np.pi)
    free = [level.alias("amplitude"), F.try_divide(slope, level).alias("b"), (pi * (level + F.lit(basis_integral) * slope)).alias("flux")]
    if bounds is None:
        return df.groupBy(*keys).agg(F.count(radiance).alias("views"), *free)
    own = df.select(*keys, basis.cast("double").alias("_x"), radiance.cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    x, y = F.col("_x"), F.col("_y")
    slope, level = F.regr_slope(y, x), F.regr_intercept(y, x)
    sums = own.groupBy(*keys).agg(F.count("*").alias("views"), level.alias("_a"), slope.alias("_s"), *[F.sum(c).alias(n) for n, c in (("_x", x), ("_xx", x * x), ("_y", y), ("_xy", x * y))])
    at = lambda b: (F.col("_y") + b * F.col("_xy"), F.col("views") + 2.0 * b * F.col("_x") + b * b * F.col("_xx"))
    (y0, n0), (y1, n1) = (at(F.lit(float(b))) for b in bounds)
    low = y0 * y0 / n0 >= y1 * y1 / n1  # what a fit with this b explains
    b = F.col("_s") / F.col("_a")
    out = F.col("_s").isNotNull() & ((F.col("_a") <= 0) | ~b.between(*map(float, bounds)))
    fixed = F.when(low, F.lit(float(bounds[0]))).otherwise(F.lit(float(bounds[1])))
    own = sums.select(*keys, "views", out.alias("constrained"), F.when(out, F.when(low, y0 / n0).otherwise(y1 / n1)).otherwise(F.col("_a")).alias("amplitude"), F.when(out, fixed).otherwise(b).alias("b"))
    return own.withColumn("flux", pi * F.col("amplitude") * (1.0 + F.lit(basis_integral) * F.col("b")))


def normalised_retrieval(df: DataFrame, keys: Sequence[str], angle: Column, basis: Column, radiance: Column, basis_integral: float, reference: float = 55.0) -> DataFrame:
    """(keys, views, b, flux, rms_percent) of each case from radiances over that of its one view at the reference angle.

    radiance / reference radiance - 1 = b * basis through the origin, since the
    basis is zero at the reference. Raises for a case without exactly one view
    there; a case without other angles has no b.
    """
    near = F.abs(angle - reference) <= 1e-8 + 1e-5 * reference
    own = df.select(*keys, near.alias("_near"), basis.cast("double").alias("_x"), radiance.cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    x, y = F.col("_x"), F.col("_y")
    sums = own.groupBy(*keys).agg(
        F.count("*").alias("views"), F.count_if("_near").alias("_n"), F.max(F.when(F.col("_near"), y)).alias("_r"), *[F.sum(c).alias(n) for n, c in (("_sx", x), ("_sxx", x * x), ("_sy", y), ("_sxy", x * y), ("_syy", y * y))]
    )
    level = F.when(F.col("_n") != 1, F.raise_error(F.lit("a case has not exactly one view at the reference angle")).cast("double")).otherwise(F.col("_r"))
    cross = F.col("_sxy") / level - F.col("_sx")
    sums = sums.withColumns({"_level": level, "_cross": cross, "b": F.try_divide(cross, F.col("_sxx"))})
    left = F.col("_syy") / F.col("_level") / F.col("_level") - 2.0 * F.col("_sy") / F.col("_level") + F.col("views") - F.col("b") * F.col("_cross")
    flux = F.lit(np.pi) * F.col("_level") * (1.0 + F.lit(basis_integral) * F.col("b"))
    return sums.select(*keys, "views", "b", flux.alias("flux"), (100.0 * F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("views"))).alias("rms_percent"))


def deal_sizes(counts: dict[int, int], folds: int) -> list[tuple[int, int, list[int]]]:
    """(size, from_rank, pattern): which folds groups of a size go to in turn, if each goes to the lightest fold, largest groups first.

    `counts` has the number of groups per size. Groups of one size go around
    the folds that are lightest by less than that size, and more folds join in
    as these fill up, so a size has as many patterns as folds at most.
    """
    loads, out = [0] * folds, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            low = min(loads)
            turn = [f for _, f in sorted((load, f) for f, load in enumerate(loads) if load < low + size)]
            others = [load for f, load in enumerate(loads) if f not in turn]
            dealt = min(left, (min(others) - low) // size * len(turn)) if others else left
            out.append((size, rank, turn))
            for place, f in enumerate(turn):
                loads[f] += size * (dealt // len(turn) + (place < dealt % len(turn)))
            left, rank = left - dealt, rank + dealt
    return out


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, size, fold): from the largest group to the smallest, and by name, each goes to the lightest fold.

    The rule needs only how many groups each size has, one row per different
    size; ranks among groups of a size come from range partitions.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    ranked = running(sizes.withColumn("_one", F.lit(1)), ["size"], group, "_one").withColumn("_rank", F.col("so_far") - 1)
    counts = {r["size"]: r["count"] for r in ranked.groupBy("size").count().collect()}
    dealt: dict[int, list] = {}
    for size, rank, turn in deal_sizes(counts, folds):
        dealt.setdefault(size, []).append({"from": rank, "turn": turn})
    table = df.sparkSession.createDataFrame(list(dealt.items()), "_size long, _turns array<struct<from: long, turn: array<int>>>")
    met = ranked.join(table, F.col("size") == F.col("_size"))
    own = F.element_at(F.filter("_turns", lambda t: t["from"] <= F.col("_rank")), -1)
    fold = own["turn"][((F.col("_rank") - own["from"]) % F.size(own["turn"])).cast("int")]
    return met.select(group, "size", fold.alias("fold"))


def best_matching(gain: np.ndarray) -> list[int]:
    """The assignment of rows to columns of a small square matrix with the largest total, by dynamic programming over sets."""
    k = len(gain)
    if k > 15:
        raise ValueError("too many labels to match exactly")
    best = np.full(1 << k, -np.inf)
    best[0], back = 0.0, np.zeros(1 << k, int)
    for held in range(1 << k):
        row = held.bit_count()
        for column in range(k if row < k else 0):
            new = held | 1 << column
            if not held >> column & 1 and best[held] + gain[row, column] > best[new]:
                best[new], back[new] = best[held] + gain[row, column], column
    out, held = [], (1 << k) - 1
    while held:
        out.append(int(back[held]))
        held ^= 1 << back[held]
    return out[::-1]


def stability(cells: DataFrame) -> dict:
    """Jaccard index of each label a with its best-matched label b, from a contingency table (a, b, n)."""
    rows = cells.collect()  # one row per pair of labels
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    k = max(len(a), len(b))
    n = np.zeros((k, k))
    for r in rows:
        n[a.index(r["a"]), b.index(r["b"])] = r["n"]
    union = n.sum(1)[:, None] + n.sum(0)[None, :] - n
    jaccard = np.divide(n, union, out=np.zeros_like(n), where=union > 0)
    match = best_matching(jaccard)
    return {label: float(jaccard[i, match[i]]) for i, label in enumerate(a)}


def cross_validated(df: DataFrame, values: Sequence[Column], target: Column, weight: Column, fold: Column, folds: int, degree: int = 1) -> DataFrame:
    """The rows with `prediction`, each by the polynomial regression of all other folds.

    One pass gathers the products of every fold; those of a training set are
    the sum of all but one. Raises if a fold leaves too few rows.
    """
    predictions = fold_models(df, values, target, weight, fold, folds, degree)
    prediction = F.lit(None).cast("double")
    for k, model in predictions.items():
        prediction = F.when(fold == k, model.column(values)).otherwise(prediction)
    return df.withColumn("prediction", prediction)


def fold_models(df: DataFrame, values: Sequence[Column], target: Column, weight: Column, fold: Column, folds: int, degree: int = 1) -> dict[int, Polynomial]:
    """The polynomial regression of all other folds, by fold."""
    mean, scale = spread(df, [*values, target], weight)
    frame = Polynomial(tuple(map(float, mean[:-1])), tuple(map(float, scale[:-1])), degree, 0.0, ())
    terms = polynomial_terms(frame.scaled(values), degree)

    def grams(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        x = np.concatenate([np.ones((len(rows), 1)), rows[:, :-2]], 1)
        own = [rows[:, -1] == k for k in range(folds)]
        return [(x[k] * rows[k, -2:-1], x[k]) for k in own]

    got = exact_products(df, [*terms, target - F.lit(float(mean[-1])), weight, fold], grams)
    if not got:
        raise ValueError("no complete rows to fit")
    each = np.array([_symmetric(m) for m in got])
    models = {}
    for k in range(folds):
        train = each.sum(0) - each[k]
        if train[0, 0] <= 0:
            raise ValueError("a fold leaves nothing to train on")
        c = solve(train)
        models[k] = replace(frame, intercept=float(c[0] + mean[-1]), coefficients=tuple(map(float, c[1:])))
    return models


def best_positive(m: np.ndarray, s: np.ndarray, grid: np.ndarray, margin: float = 1e-6) -> np.ndarray:
    """The parameters (1, b) = v with the largest v m v / v s v among shapes that are at least `margin` on the grid, where the free best isn't.

    The best lies on the edge of the allowed region: where one angle's value is
    at the margin, or two neighbouring ones' (the first and the last are
    neighbours too). Along an edge the best is an eigenvector of 2 x 2.
    """
    normals = np.column_stack([np.full(len(grid), 1.0 - margin), grid])
    found = []
    for n in normals:
        plane = np.linalg.svd(n[None, :])[2][1:].T
        small_m, small_s = plane.T @ m @ plane, plane.T @ s @ plane
        root = np.linalg.inv(np.linalg.cholesky(small_s))
        found.append(plane @ (root.T @ np.linalg.eigh(root @ small_m @ root.T)[1][:, -1]))
    v = np.concatenate([np.array(found), np.cross(normals, np.roll(normals, -1, axis=0))])
    v = v[np.abs(v[:, 0]) > 1e-12]
    v = v / v[:, :1]
    v = v[(v @ normals.T >= -1e-9).all(1)]
    if not len(v):
        raise ValueError("no shape is positive everywhere")
    value = np.einsum("ki,ij,kj->k", v, m, v) / np.einsum("ki,ij,kj->k", v, s, v)
    return v[value.argmax(), 1:]


def pooled_shape(df: DataFrame, keys: Sequence[str], file: str, basis: Sequence[Column], radiance: Column, grid: np.ndarray) -> list[dict]:
    """One radiance shape per key for all its files, each file with an amplitude of its own and equal influence.

    With v = (1, parameters), what a file's views leave unexplained is a ratio
    of two quadratic forms in v, and files seen at the same angles share the
    denominator. So sums over files are all that is needed, and the best v is
    the leading generalised eigenvector. `grid` holds the basis over the
    hemisphere: one parameter is held where the shape stays positive on it, two
    that aren't raise. Files with other angles raise as well.
    """
    parts = [F.lit(1.0), *basis]
    p = len(parts)
    own = df.withColumns({f"_f{i}": b.cast("double") for i, b in enumerate(parts)}).withColumn("_l", radiance)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    files = own.groupBy(*keys, file).agg(
        *[(F.sum(F.col("_l") * F.col(f"_f{i}")) / F.avg("_l")).alias(f"_t{i}") for i in range(p)],
        *[F.sum(F.col(f"_f{i}") * F.col(f"_f{j}")).alias(f"_s{i}{j}") for i, j in cells],
    )
    rows = files.groupBy(*keys).agg(
        F.count("*").alias("files"),
        *[F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"m{i}{j}") for i, j in cells],
        *[F.avg(f"_s{i}{j}").alias(f"s{i}{j}") for i, j in cells],
        F.greatest(*[F.max(f"_s{i}{j}") - F.min(f"_s{i}{j}") for i, j in cells], F.lit(0.0)).alias("spread"),
    ).collect()
    out = []
    for row in rows:
        if row["spread"] > 1e-9 * row["s00"]:
            raise ValueError("files of one key differ in their angles")
        m, s = np.empty((p, p)), np.empty((p, p))
        for i, j in cells:
            m[i, j] = m[j, i] = row[f"m{i}{j}"]
            s[i, j] = s[j, i] = row[f"s{i}{j}"]
        values, vectors = np.linalg.eigh(s)
        if values[0] <= 1e-12 * values[-1]:
            raise ValueError("the angles do not identify the shape")
        half = vectors / np.sqrt(values)
        lead = half @ np.linalg.eigh(half.T @ m @ half)[1][:, -1]
        b = lead[1:] / lead[0]
        if p == 2:
            b = np.clip(b, *positive_bounds(grid[:, 0]))
        elif (1 + grid @ b < 1e-6).any():
            b = best_positive(m, s, grid)
        out.append({**{k: row[k] for k in keys}, "files": row["files"], "parameters": b.tolist()})
    return out
