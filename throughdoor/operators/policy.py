"""Artificial approval policies for the masked-outcome backtest."""
from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Masking, ScaleCheck
from ..functions.draws import uniform
from ..runtime import localize, materialize, small_table
from . import sampling
from .ordered import quantiles

GRID = T.StructType([
    T.StructField("scenario", T.StringType()), T.StructField("cutoff_type", T.StringType()),
    T.StructField("rejection_rate", T.DoubleType()), T.StructField("replicate", T.IntegerType()),
])


def scenario_text(cutoff: str, rate: float, replicate: int) -> str:
    return f"{cutoff}|{rate:.6f}|{replicate}"


def scenario_grid(spec: Masking, cutoffs=None, rates=None, replicates=None) -> list:
    """Configured scenarios as (scenario, cutoff_type, rejection_rate, replicate)."""
    return [(scenario_text(c, r, k), c, float(r), k) for c, r, k in itertools.product(
        cutoffs or spec.policies, rates or spec.rates,
        range(replicates or spec.replicates))]


def sensitivity_grid(spec: Masking, check: ScaleCheck) -> list:
    """Scenarios of the scale check: middling rates, or all if none is middling."""
    lo, hi = check.between
    rates = [r for r in spec.rates if lo <= r <= hi] or list(spec.rates)
    return scenario_grid(spec, check.policies, rates, check.replicates)


def draw_pools(terminal: DataFrame, spec: Masking, seed: int, replicates: int,
               row_id: str = "app_id") -> DataFrame:
    """Each replicate's pool with its evaluation flag; same pool for all policies."""
    rows = terminal.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pool = rows
    if spec.pool_rows is not None:
        salt = F.concat(F.lit(f"pool:{seed}:"), F.col("replicate").cast("string"))
        pool = sampling.fixed_size(rows, ["replicate"], row_id, spec.pool_rows, salt)
    part = F.concat(F.lit(f"eval:{seed}:"), F.col("replicate").cast("string"))
    return pool.withColumn("is_eval", uniform(row_id, part) < F.lit(spec.held_share))


def _ranked_score(pool: DataFrame) -> DataFrame:
    """Scores with a missing one placed below the lowest of its replicate."""
    low = localize(pool.groupBy("replicate").agg((F.min("risk_score") - 1.0).alias("low")), "low")
    return pool.join(low, "replicate").withColumn(
        "rank_score", F.coalesce("risk_score", "low")).drop("low")


def policies(ranked: DataFrame, grid: list, spec: Masking) -> DataFrame:
    """Threshold parameters of every scenario, from one score histogram.

    Hard cutoffs get a threshold and the share of tied rows to decline, so the
    realised rate is the asked one on a lumpy score. Soft cutoffs get the
    intercept that makes the mean approval probability one minus the rate.
    """
    spark = ranked.sparkSession
    hist = materialize(ranked.groupBy("replicate", F.col("rank_score").alias("score")).agg(
        F.count(F.lit(1)).alias("n")), "score-values")
    scen = small_table(spark, grid, GRID)
    rates = sorted({g[2] for g in grid})
    cuts = quantiles(hist, ["replicate"], "score", rates, rows="n")
    place = F.create_map(*[x for i, r in enumerate(rates) for x in (F.lit(r), F.lit(i))])
    shape = hist.groupBy("replicate").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"))
    spread = (hist.join(shape, "replicate").groupBy("replicate").agg(
        F.first("rows").alias("rows"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(F.col("n") * (F.col("score") - F.col("mean")) * (F.col("score") - F.col("mean")))
               / F.first("rows")).alias("sd")))
    base = localize(scen.join(cuts, "replicate").join(spread, "replicate").select(
        *scen.columns, F.get("q", place[F.col("rejection_rate")]).alias("threshold"),
        "rows", "mean", F.greatest("sd", F.lit(1e-9)).alias("sd")), "policy-base")
    s, t = F.col("score"), F.col("threshold")
    ties = hist.join(base.select("scenario", "replicate", "threshold", "rejection_rate", "rows"),
                     "replicate").groupBy("scenario").agg(
        F.max("rows").alias("m"), F.max("rejection_rate").alias("rate"),
        F.sum(F.when(s < t, F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(s == t, F.col("n")).otherwise(0)).alias("at"))
    short = F.col("rate") * F.col("m") - F.col("below")
    ties = ties.select("scenario", F.when((F.col("at") > 0) & (short > 0),
                                          F.least(short / F.col("at"), F.lit(1.0)))
                       .otherwise(0.0).alias("tie_share"))
    soft = soft_intercepts(hist, base.where("cutoff_type = 'risk_soft'"), spec.slope)
    return localize(base.join(ties, "scenario").join(soft, "scenario", "left"), "policies")


def soft_intercepts(hist: DataFrame, base: DataFrame, slope: float) -> DataFrame:
    """Solve mean(expit(a + slope * z)) = 1 - rate for all scenarios at once.

    Bracketed Newton; each round is one aggregation over the score histogram.
    """
    spark = hist.sparkSession
    rows = base.select("scenario", "replicate", "rejection_rate", "mean", "sd").collect()
    state = {r["scenario"]: [-50.0, 50.0, math.log((1 - r["rejection_rate"]) / r["rejection_rate"])]
             for r in rows}
    schema = T.StructType(
        [base.schema[c] for c in ("scenario", "replicate", "mean", "sd")]
        + [T.StructField("a", T.DoubleType())])
    goal = {r["scenario"]: 1.0 - r["rejection_rate"] for r in rows}
    for _ in range(60 if rows else 0):
        asked = small_table(spark, [(r["scenario"], r["replicate"], r["mean"], r["sd"],
                                     state[r["scenario"]][2]) for r in rows], schema)
        z = (F.col("score") - F.col("mean")) / F.col("sd")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") + F.lit(slope) * z)))
        got = (hist.join(asked, "replicate").withColumn("p", p).groupBy("scenario").agg(
            (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean_p"),
            (F.sum(F.col("n") * F.col("p") * (1.0 - F.col("p"))) / F.sum("n")).alias("slope"))).collect()
        moved = 0.0
        for r in got:
            lo, hi, a = state[r["scenario"]]
            gap = r["mean_p"] - goal[r["scenario"]]
            lo, hi = (a, hi) if gap < 0 else (lo, a)
            nxt = a - gap / r["slope"] if r["slope"] > 0 else 0.5 * (lo + hi)
            if not lo <= nxt <= hi:
                nxt = 0.5 * (lo + hi)
            moved = max(moved, abs(nxt - a))
            state[r["scenario"]] = [lo, hi, nxt]
        if moved < 1e-12:
            break
    out = T.StructType([T.StructField("scenario", T.StringType()), T.StructField("intercept", T.DoubleType())])
    return small_table(spark, [(k, v[2]) for k, v in state.items()], out)


def slots_of(grid: list) -> list:
    """The policies of a grid, the same for every replicate: (cutoff, rate) in order."""
    return sorted({(c, r) for _, c, r, _ in grid})


def decide(pool: DataFrame, grid: list, spec: Masking, seed: int, row_id: str = "app_id") -> tuple[DataFrame, DataFrame]:
    """Pool rows with ``seen``, one flag per slot, and (scenario, ..., replicate, slot).

    A row stays one row whatever the number of policies. The flag is null for a
    slot that the grid does not have in the row's replicate.
    """
    ranked = _ranked_score(pool)
    slots = {s: i for i, s in enumerate(slots_of(grid))}
    schema = T.StructType(GRID.fields + [T.StructField("slot", T.IntegerType())])
    places = small_table(pool.sparkSession, [(*g, slots[g[1], g[2]]) for g in grid], schema)
    table = policies(ranked, grid, spec).join(places.select("scenario", "slot"), "scenario")
    rule = F.struct("scenario", "rejection_rate", "threshold", "tie_share", "mean", "sd", "intercept")
    rules = localize(table.groupBy("replicate").agg(F.array(*[
        F.max(F.when(F.col("slot") == i, rule)) for i in range(len(slots))]).alias("_rules")), "rules")
    s = F.col("rank_score")

    def approved(kind, p):
        u = uniform(row_id, F.concat(F.lit(f"mask:{seed}:"), p["scenario"]))
        z = (s - p["mean"]) / p["sd"]
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-(p["intercept"] + F.lit(spec.slope) * z)))
        t = p["threshold"]
        rules = {"random": u >= p["rejection_rate"], "risk_soft": u < chance,
                 "risk_hard": ~((s < t) | ((s == t) & (u < p["tie_share"])))}
        return rules.get(kind, F.lit(None).cast("boolean"))

    # an expression a slot is compiled; a lambda over the array is not
    flags = F.array(*[approved(kind, F.get("_rules", F.lit(i))) for (kind, _), i in slots.items()])
    decided = ranked.join(rules, "replicate").select(*pool.columns, flags.alias("seen"))
    return decided, places


def apply_policies(pool: DataFrame, grid: list, spec: Masking, seed: int,
                   row_id: str = "app_id") -> DataFrame:
    """Pool rows times scenarios with ``accepted_here`` as the policy decides."""
    decided, places = decide(pool, grid, spec, seed, row_id)
    each = decided.select(*pool.columns, F.posexplode("seen").alias("slot", "accepted_here"))
    return each.join(places, ["replicate", "slot"]).select(
        "scenario", "cutoff_type", "rejection_rate", *pool.columns, "accepted_here")
