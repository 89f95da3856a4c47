"""Penalised logistic regression for many keys at once.

Rows collapse to cells (keys, design vector) first. Every round is one
aggregation over the cells of all keys, however many cells there are, and the
driver only sees one small system per key (one portfolio, or a configured
scenario grid).
"""
from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, small_table

TOLERANCE = 1e-10
MAX_ROUNDS = 40
MOST_KEYS = 10_000


def cells(rows: DataFrame, keys, xs, w: str, wy: str) -> DataFrame:
    """Weight and bad weight per design vector."""
    return materialize(rows.groupBy(*keys, *xs).agg(F.sum(w).alias("sw"), F.sum(wy).alias("swy")), "cells")


def _totals(cell: DataFrame, coefs: DataFrame, keys, xs):
    eta = F.get("beta", F.lit(0))
    for i, x in enumerate(xs, 1):
        eta = eta + F.get("beta", F.lit(i)) * F.col(x)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta")))
    # log(1 + exp(eta)) without overflow
    soft = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("eta"))))
    at = (cell.join(coefs, list(keys)).withColumn("eta", eta).withColumn("p", p).withColumn("soft", soft)
          .withColumn("r", F.col("swy") - F.col("sw") * F.col("p"))
          .withColumn("v", F.col("sw") * F.col("p") * (1.0 - F.col("p"))))
    full = ["1D"] + [f"`{x}`" for x in xs]
    sums = ["sum(swy * eta - sw * soft) AS ll"]
    for i, a in enumerate(full):
        sums.append(f"sum(r * {a}) AS g{i}")
        sums += [f"sum(v * {a} * {full[j]}) AS h{i}_{j}" for j in range(i + 1)]
    sums = [F.expr(x) for x in sums]
    return at.groupBy(*keys).agg(*sums)


class Newton:
    """Damped Newton descent on |b|^2 / 2 + C * weighted log loss."""

    def __init__(self, k: int, C: float):
        self.C, self.ridge = C, np.diag([0.0] + [1.0] * (k - 1))
        self.at, self.best, self.loss, self.done, self.rounds = np.zeros(k), None, np.inf, False, 0

    def reached(self):
        """The settled point, or the best one seen."""
        return self.at if self.done or self.best is None else self.best

    def see(self, ll, grad, hess):
        """Move on the totals (log-likelihood, gradient, information) at ``at``."""
        b = self.at
        self.rounds += 1
        loss = 0.5 * b @ self.ridge @ b - self.C * ll
        if loss > self.loss + 1e-9 * (1.0 + abs(loss)):
            self.at = 0.5 * (b + self.best)
            return
        self.best, self.loss = b, loss
        step = np.linalg.lstsq(self.ridge + self.C * hess, self.ridge @ b - self.C * grad,
                               rcond=None)[0]
        self.at = b - step
        self.done = bool(np.max(np.abs(step)) < TOLERANCE * (1.0 + np.max(np.abs(b))))


def fit_logits(cell: DataFrame, keys, xs, C: float = 1.0) -> DataFrame:
    """(keys, beta, converged, rounds) by damped Newton, intercept first.

    Each round is one aggregation over the cells of the keys still moving; the
    driver sees a few sums per key, of which there is one or a configured grid.
    A key that does not settle in ``MAX_ROUNDS`` keeps the best point it
    reached and is named in a warning.
    """
    spark = cell.sparkSession
    k = len(xs) + 1
    number = [cell.schema[c] for c in keys]
    schema = T.StructType(number + [T.StructField("beta", T.ArrayType(T.DoubleType()))])
    who = [tuple(r) for r in cell.select(*keys).distinct().limit(MOST_KEYS + 1).collect()]
    if len(who) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys to fit at once")
    fits = {key: Newton(k, C) for key in who}
    for _ in range(MAX_ROUNDS):
        live = [key for key in who if not fits[key].done]
        if not live:
            break
        coefs = small_table(
            spark, [(*key, [float(b) for b in fits[key].at]) for key in live], schema)
        for row in _totals(cell, coefs, keys, xs).collect():
            hess = np.zeros((k, k))
            for i in range(k):
                for j in range(i + 1):
                    hess[i, j] = hess[j, i] = row[f"h{i}_{j}"]
            fits[tuple(row[c] for c in keys)].see(
                row["ll"], np.array([row[f"g{i}"] for i in range(k)]), hess)
    late = [key for key in who if not fits[key].done]
    if late:
        warnings.warn(f"{len(late)} of {len(who)} logistic fits did not settle in {MAX_ROUNDS} rounds: {late[:5]}",
                      stacklevel=2)
    out = T.StructType(schema.fields + [T.StructField("converged", T.BooleanType()),
                                        T.StructField("rounds", T.IntegerType())])
    return small_table(
        spark, [(*key, [float(b) for b in fits[key].reached()], fits[key].done, fits[key].rounds) for key in who], out)
