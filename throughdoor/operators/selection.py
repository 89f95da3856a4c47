"""Probit outcome model with selection, by full maximum likelihood.

Approval and default are a bivariate probit; default is seen for approved rows
only. Rows collapse to cells (keys, design vectors, approved, bad). Every pass
over the cells of all keys takes a table of parameter points, one or several
per key: tasks return partial sums of log-likelihood, gradient and Hessian per
(key, point), and the driver solves one small system per key. A key asks for one
point while its Newton steps rise, and for eight shorter steps at once where one
does not. The restricted model settles in a few passes from logistic starts,
and the full one sets out from it while other keys are still on their way.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normal as N
from ..runtime import materialize, small_table

ATANH_BOUND = 4.0
MAX_PASSES = 40
SHORTER = [0.5**i for i in range(1, 9)]
PACK_ROWS = 256  # cells a packed row holds
SETTLED = 1e-13  # rise of the last step, as a share of the log-likelihood


# --- numpy pieces evaluated inside tasks, on Arrow batches of cells -----------
def _cdf(x):
    a = np.minimum(np.abs(x), 37.5)
    bulk = np.polyval(N.CDF_NUMERATOR, a) / np.polyval(N.CDF_DENOMINATOR, a)
    frac = a + 0.65
    for k in (6, 5, 4, 3, 2, 1):
        frac = a + k / frac
    tail = np.where(a < N.CDF_SWITCH, bulk, 1.0 / frac / N.ROOT_2PI) * np.exp(-a * a / 2.0)
    return np.where(x > 0, 1.0 - tail, tail)


def _pdf(x):
    return np.exp(-x * x / 2.0) / N.ROOT_2PI


def _cdf2(h, k, r, rho):
    if rho == 0.0:
        return np.clip(_cdf(h) * _cdf(k), N.FLOOR, 1.0)
    area = np.zeros_like(h)
    for x, w in zip(N.NODES, N.NODE_WEIGHTS):
        t = 0.5 * r * (x + 1.0)
        om = 1.0 - t * t
        area += 0.5 * w * r * np.exp(-(h * h - 2 * t * h * k + k * k) / (2 * om)) / np.sqrt(om)
    return np.clip(_cdf(h) * _cdf(k) + area / (2 * math.pi), N.FLOOR, 1.0)


def _approved_terms(h, v, bad, rho):
    """log L, its gradient and second derivatives in (h, v, atanh rho)."""
    q = 2.0 * bad - 1.0
    k, r = q * v, q * rho
    gone = max(1.0 - rho * rho, 1e-14)
    L = _cdf2(h, k, r, rho)
    lh = _pdf(h) * _cdf((k - r * h) / math.sqrt(gone)) / L
    lk = _pdf(k) * _cdf((h - r * k) / math.sqrt(gone)) / L
    lr = np.exp(-(h * h - 2 * r * h * k + k * k) / (2 * gone)) / (2 * math.pi * math.sqrt(gone)) / L
    lrr = lr * (r / gone + (h * k * (1 + r * r) - r * (h * h + k * k)) / gone**2)
    grad = (lh, q * lk, q * gone * lr)
    second = {
        "hh": -h * lh - r * lr - lh * lh,
        "hv": q * (lr - lh * lk),
        "vv": -k * lk - r * lr - lk * lk,
        "ha": q * gone * (-(h - r * k) / gone * lr - lh * lr),
        "va": gone * (-(k - r * h) / gone * lr - lk * lr),
        "aa": gone * gone * (lrr - lr * lr) - 2 * rho * gone * q * lr,
    }
    return np.log(L), grad, second


def _declined_terms(h):
    p = np.clip(_cdf(-h), N.FLOOR, 1.0)
    lam = _pdf(h) / p
    return np.log(p), -lam, h * lam - lam * lam


def batch_sums(Z, X, s, y, w, theta):
    """[ll, gradient, row-wise upper Hessian] summed over the rows given."""
    kz, kx = Z.shape[1], X.shape[1]
    p = kz + kx + 1
    rho = math.tanh(float(np.clip(theta[-1], -ATANH_BOUND, ATANH_BOUND)))
    grad, hess, ll = np.zeros(p), np.zeros((p, p)), 0.0
    out = s < 0.5
    if out.any():
        Zo, wo = Z[out], w[out]
        f, g, d = _declined_terms(Zo @ theta[:kz])
        ll += wo @ f
        grad[:kz] += Zo.T @ (wo * g)
        hess[:kz, :kz] += Zo.T @ (Zo * (wo * d)[:, None])
    if (~out).any():
        Zi, Xi, wi = Z[~out], X[~out], w[~out]
        f, g, d = _approved_terms(Zi @ theta[:kz], Xi @ theta[kz:-1], y[~out], rho)
        ll += wi @ f
        grad += np.concatenate([Zi.T @ (wi * g[0]), Xi.T @ (wi * g[1]), [wi @ g[2]]])
        hess[:kz, :kz] += Zi.T @ (Zi * (wi * d["hh"])[:, None])
        hess[:kz, kz:-1] += Zi.T @ (Xi * (wi * d["hv"])[:, None])
        hess[kz:-1, kz:-1] += Xi.T @ (Xi * (wi * d["vv"])[:, None])
        hess[:kz, -1] += Zi.T @ (wi * d["ha"])
        hess[kz:-1, -1] += Xi.T @ (wi * d["va"])
        hess[-1, -1] += wi @ d["aa"]
    return np.concatenate([[ll], grad, hess[np.triu_indices(p)]])


def packed(cell: DataFrame, zs, xs) -> DataFrame:
    """Cells (kid, zs, xs, s, y, w) as rows (kid, cells): up to ``PACK_ROWS`` of a key's cells as the bytes of a matrix.

    Rows go to Python one value at a time, so every pass over plain cells took longer to send than to add up.
    """
    names, most = [*zs, *xs, "s", "y", "w"], PACK_ROWS

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kid = b.column("kid").to_numpy()
            rows = np.column_stack([b.column(c).to_numpy() for c in names]).astype(np.float64)
            starts = np.flatnonzero(np.append(True, np.diff(kid) != 0))
            cuts = [j for i, end in zip(starts, [*starts[1:], len(kid)]) for j in range(i, end, most)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kid[cuts].astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, cuts[1:])], pa.binary())],
                names=["kid", "cells"])

    return cell.mapInArrow(pack, "kid int, cells binary")


def _matrix(batch, names):
    """(kid, matrix of the columns) of a batch of plain or packed cells."""
    if "cells" not in batch.schema.names:
        return batch.column("kid").to_numpy(), np.column_stack([batch.column(c).to_numpy() for c in names])
    parts = [np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, len(names)) for x in batch.column("cells")]
    return np.repeat(batch.column("kid").to_numpy(), [len(x) for x in parts]), np.concatenate(parts)


def likelihood_totals(cell: DataFrame, zs, xs, points: dict, scale: dict) -> dict:
    """Totals of ``batch_sums`` for each of a key number's points, over its cells, plain or ``packed``."""
    live = {k: [np.asarray(t, dtype=float) for t in v] for k, v in points.items()}
    size = {k: float(scale[k]) for k in live}
    zs, xs = list(zs), list(xs)

    def partials(batches):
        found = {}
        for b in batches:
            if not b.num_rows:
                continue
            kid, rows = _matrix(b, [*zs, *xs, "s", "y", "w"])
            one, (s, y, w) = np.ones(len(kid)), rows[:, -3:].T.copy()
            Z, X = (np.column_stack([one, x]) for x in (rows[:, :len(zs)], rows[:, len(zs):-3]))
            ends = [0, *(np.flatnonzero(np.diff(kid)) + 1), len(kid)]
            for at in map(slice, ends, ends[1:]):
                k = int(kid[at.start])
                for i, theta in enumerate(live[k]):
                    found[k, i] = found.get((k, i), 0.0) + batch_sums(Z[at], X[at], s[at], y[at], w[at] * size[k], theta)
        for (k, i), sums in found.items():
            yield pa.RecordBatch.from_pydict({
                "kid": pa.array(np.full(len(sums), k, dtype=np.int32)), "point": pa.array(np.full(len(sums), i, dtype=np.int32)),
                "at": pa.array(np.arange(len(sums), dtype=np.int32)), "x": pa.array(sums)})

    wanted = cell.where(F.col("kid").isin(list(live)))
    rows = (wanted.mapInArrow(partials, "kid int, point int, at int, x double")
            .groupBy("kid", "point", "at").agg(F.sum("x").alias("x")).toPandas().sort_values(["kid", "point", "at"]))
    out: dict = {}
    for (k, _), g in rows.groupby(["kid", "point"]):
        out.setdefault(k, []).append(g["x"].to_numpy())
    return out


class _Climb:
    """Safeguarded Newton ascent of one key; ``asked`` are the points it wants evaluated."""

    def __init__(self, theta, free):
        self.free, self.asked = free, [np.asarray(theta, dtype=float)]
        self.best, self.ll, self.step, self.short = self.asked[0], -np.inf, None, 1.0
        self.done, self.hess, self.converged = False, None, False

    def _bounded(self, theta):
        theta = theta.copy()
        theta[-1] = np.clip(theta[-1], -ATANH_BOUND, ATANH_BOUND)
        return theta

    def see(self, totals):
        """Go on from the best of the points asked for."""
        i = int(np.argmax([t[0] if np.isfinite(t[0]) else -np.inf for t in totals]))
        theta, sums = self.asked[i], totals[i]
        p = len(theta)
        ll, grad = sums[0], sums[1:p + 1]
        if not ll >= self.ll - 1e-9 * (1 + abs(self.ll)):
            if self.short < 1e-9:  # no step rises: this is the top, to rounding
                self.done = True
                return
            self.asked = [self._bounded(self.best + self.step * self.short * f) for f in SHORTER]
            self.short *= SHORTER[-1]
            return
        self.best, self.ll, self.short = theta, ll, 1.0
        hess = np.zeros((p, p))
        hess[np.triu_indices(p)] = sums[p + 1:]
        self.hess = hess + np.triu(hess, 1).T
        move = list(self.free)
        edge = abs(theta[-1]) >= ATANH_BOUND
        if p - 1 in move and edge and grad[-1] * theta[-1] > 0:
            move.remove(p - 1)
        g = grad[move]
        values, vectors = np.linalg.eigh(-self.hess[np.ix_(move, move)])
        floor = 1e-9 * max(values.max(), 1.0)
        step = np.zeros(p)
        step[move] = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), floor))
        rise = float(g @ step[move])
        if rise < SETTLED * (1 + abs(ll)):
            # too small to matter in the likelihood, but not in the scores: take it
            self.best = self._bounded(theta + step)
            self.ll = ll + 0.5 * rise
            self.done, self.converged = True, True
            return
        size = max(np.max(np.abs(step[:-1])) / 2.0, abs(step[-1]) / 0.5, 1.0)
        self.step = self._bounded(theta + step / size) - theta
        self.asked = [theta + self.step]


def _ascend(cell, zs, xs, scale, starts):
    """The restricted and the full climb of every key, and the passes taken.

    A key's full climb begins when its restricted one is done.
    """
    p = len(next(iter(starts.values())))
    flat = {k: _Climb(t, range(p - 1)) for k, t in starts.items()}
    full: dict = {}
    for n in range(1, MAX_PASSES + 1):
        live = {k: full.get(k, c) for k, c in flat.items()}
        live = {k: c for k, c in live.items() if not c.done}
        if not live:
            return flat, full, n - 1
        for k, totals in likelihood_totals(cell, zs, xs, {k: c.asked for k, c in live.items()}, scale).items():
            live[k].see(totals)
            if k not in full and live[k].done:
                full[k] = _Climb(live[k].best, range(p))
    for k, c in flat.items():
        full.setdefault(k, c)
    return flat, full, MAX_PASSES


@dataclass
class SelectionFit:
    """Parameters per key, and the cells they were fitted on."""

    keys: list
    params: DataFrame
    cells: DataFrame
    zs: list
    xs: list
    passes: int  # over the cells


PARAMS = [
    ("gamma", T.ArrayType(T.DoubleType())), ("beta", T.ArrayType(T.DoubleType())),
    ("rho", T.DoubleType()), ("atanh_rho", T.DoubleType()), ("se_rho", T.DoubleType()),
    ("rho_lo", T.DoubleType()), ("rho_hi", T.DoubleType()), ("wald_z", T.DoubleType()),
    ("lr_stat", T.DoubleType()), ("loglik", T.DoubleType()),
    ("loglik_restricted", T.DoubleType()), ("converged", T.BooleanType()),
    ("n", T.LongType()), ("n_selected", T.LongType()),
]


def selection_cells(rows: DataFrame, keys, zs, xs) -> DataFrame:
    """Rows (keys, zs, xs, s, y, w) -> cells; y counts as 0 where s = 0."""
    return materialize(rows.groupBy(*keys, *zs, *xs, "s", "y").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("w2")), "selection-cells")


def fit_selection(cells: DataFrame, keys, zs, xs, starts: dict | None = None) -> SelectionFit:
    """Fit every key; weights are scaled to mean 1 within a key.

    The restricted model (rho = 0) is two independent probits and the starting
    point of the full one. ``starts`` has parameters to set out from by key
    values, zeros otherwise. A key that does not settle in ``MAX_PASSES`` keeps
    its best point, with ``converged`` false.
    """
    spark = cells.sparkSession
    keys, zs, xs = list(keys), list(zs), list(xs)
    facts = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("cells"),
        F.sum(F.when(F.col("s") > 0.5, F.col("n"))).alias("sel")).collect()
    who = {i: tuple(r[c] for c in keys) for i, r in enumerate(facts)}
    number = T.StructType([cells.schema[c] for c in keys] + [T.StructField("kid", T.IntegerType())])
    ids = small_table(spark, [(*v, i) for i, v in who.items()], number)
    tagged = cells.join(ids, keys).select("kid", *zs, *xs, "s", "y", "w")
    scale = {i: r["n"] / r["w"] for i, r in enumerate(facts)}
    p = len(zs) + len(xs) + 3
    # one key may hold most cells: spread by row, a task's keys together
    tagged = tagged.repartition("s", "y", *zs, *xs).sortWithinPartitions("kid")
    tagged = materialize(packed(tagged, zs, xs), "selection-rows")
    begin = {i: (starts or {}).get(key) or [0.0] * p for i, key in who.items()}
    flat, full, passes = _ascend(tagged, zs, xs, scale, begin) if who else ({}, {}, 0)
    out = []
    for i, key in who.items():
        c, ll0 = full[i], flat[i].ll
        a = float(c.best[-1])
        rho = math.tanh(a)
        try:
            var = np.linalg.inv(-c.hess)[-1, -1]
        except np.linalg.LinAlgError:
            var = float("nan")
        se = math.sqrt(max(var, 0.0)) if np.isfinite(var) else None
        known = se is not None
        kz = len(zs) + 1
        out.append((
            *key, [float(x) for x in c.best[:kz]], [float(x) for x in c.best[kz:-1]], rho, a,
            se * (1 - rho * rho) if known else None,
            math.tanh(a - 1.96 * se) if known else None,
            math.tanh(a + 1.96 * se) if known else None,
            a / se if known and se > 0 else None,
            float(max(2 * (c.ll - ll0), 0.0)), float(c.ll), float(ll0), c.converged,
            int(facts[i]["n"]), int(facts[i]["sel"] or 0)))
    schema = T.StructType([cells.schema[c] for c in keys]
                          + [T.StructField(n, t) for n, t in PARAMS])
    return SelectionFit(keys, small_table(spark, out, schema), cells, zs, xs, passes)


# --- column forms -------------------------------------------------------------
def linear(coefs: str, names):
    eta = F.get(coefs, F.lit(0))
    for i, c in enumerate(names, 1):
        eta = eta + F.get(coefs, F.lit(i)) * F.col(c)
    return eta


def declined_bad_rate(h, v, rho):
    """E[bad | declined, x] from the selection index h and outcome index v."""
    joint = N.bivariate_cdf(-h, v, -rho)
    alone = F.greatest(N.normal_cdf(-h), F.lit(1e-9))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), joint / alone))


def loglik_column(h, v, s, y, rho):
    """Log-likelihood of a row as a column, at given indices and rho."""
    q = 2.0 * y - 1.0
    approved = F.ln(N.bivariate_cdf(h, q * v, q * rho))
    declined = F.ln(F.greatest(F.lit(N.FLOOR), N.normal_cdf(-h)))
    return F.when(s > 0.5, approved).otherwise(declined)


def diagnostics(fit: SelectionFit) -> DataFrame:
    """rho, its standard error, interval, Wald and likelihood-ratio p-values."""
    p = fit.params.drop("gamma", "beta")
    lr_p = N.chi_square_tail(F.col("lr_stat"), F.lit(1))
    return (p.withColumn("wald_p", 2.0 * N.normal_cdf(-F.abs("wald_z")))
            .withColumn("lr_p", lr_p)
            .withColumn("rho_significant_5pct", F.coalesce(lr_p < 0.05, F.lit(False))))
