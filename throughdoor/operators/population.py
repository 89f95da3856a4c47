"""The two-sided applicant panel, its weights and its coverage."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONTEXT, FEATURES, Audit
from ..runtime import localize
from . import sampling
from .ordered import quantiles

KEY = "portfolio"


@dataclass
class Panel:
    """Accepted and declined applicants of one portfolio, with their weights.

    Both tables carry a constant ``portfolio`` column, so the same keyed
    operators serve one portfolio and a grid of backtest scenarios.
    """

    accepted: DataFrame
    declined: DataFrame
    declined_all: DataFrame
    audit: DataFrame
    rates: dict


def terminal(accepted: DataFrame) -> DataFrame:
    return accepted.where(F.col("bad").isNotNull())


def scored(declined: DataFrame) -> DataFrame:
    return declined.where(F.col("risk_score").isNotNull())


def build_panel(accepted_all: DataFrame, declined_all: DataFrame, spec: Audit,
                row_id: str = "app_id") -> Panel:
    """Both sides, sampled if asked for, weighted back to their populations."""
    sides = accepted_all.select(F.lit(1).alias("side"), F.col("bad").isNotNull().cast("int").alias("ok"),
                                F.lit(0).alias("drawn"), F.lit(0).alias("unscored"))
    drawn = sampling.split_flag(row_id, spec.sample.declined_rate, f"declined_sample:{spec.seed}")
    sides = sides.unionByName(declined_all.select(
        F.lit(0).alias("side"), F.lit(0).alias("ok"), drawn.cast("int").alias("drawn"),
        (drawn & F.col("risk_score").isNull()).cast("int").alias("unscored")))
    n = sides.agg(
        F.sum("side").alias("accepted_total"), F.sum("ok").alias("accepted_terminal"),
        F.sum(1 - F.col("side")).alias("declined_total"), F.sum("drawn").alias("declined_sampled"),
        F.sum("unscored").alias("declined_unscored")).first().asDict()

    acc = terminal(accepted_all).withColumn(KEY, F.lit("all"))
    used, most = n["accepted_terminal"], spec.sample.accepted_rows
    if most is not None and used > most:
        used = most
        acc = sampling.fixed_size(acc, [KEY], row_id, most, f"accepted_sample:{spec.seed}")
    raw = sampling.bernoulli(declined_all, row_id, spec.sample.declined_rate,
                             f"declined_sample:{spec.seed}").withColumn(KEY, F.lit("all"))
    dec = scored(raw) if spec.sample.scored_only else raw
    n_dec = n["declined_sampled"] - (n["declined_unscored"] if spec.sample.scored_only else 0)

    w_acc = n["accepted_total"] / max(used, 1)
    w_dec = n["declined_total"] / max(n["declined_sampled"], 1)
    rates = {
        "n_accepted_total": n["accepted_total"],
        "n_accepted_terminal": n["accepted_terminal"],
        "n_accepted_used": used,
        "n_declined_total": n["declined_total"],
        "n_declined_sampled": n["declined_sampled"],
        "n_declined_used": n_dec,
        "reject_sample_rate": spec.sample.declined_rate,
        "seed": spec.seed,
        "w_accepted": w_acc,
        "w_declined": w_dec,
        "indeterminate_frac": 1.0 - n["accepted_terminal"] / max(n["accepted_total"], 1),
        "unscored_frac": n["declined_unscored"] / max(n["declined_sampled"], 1),
        "population_accept_rate": n["accepted_total"] / (n["accepted_total"] + n["declined_total"]),
        "modelled_accept_rate": w_acc * used / (w_acc * used + w_dec * n_dec),
    }
    audit = acc.sparkSession.createDataFrame([rates])
    return Panel(
        accepted=acc.withColumn("design_w", F.lit(float(w_acc))),
        declined=dec.withColumn("design_w", F.lit(float(w_dec))),
        declined_all=raw, audit=audit, rates=rates)


def stack(panel: Panel, row_id: str = "app_id") -> DataFrame:
    """Both sides on the shared columns with design weights."""
    cols = [KEY, row_id, *FEATURES, *CONTEXT, "accepted", "bad", "design_w"]
    return panel.accepted.select(*cols).unionByName(panel.declined.select(*cols))


def field_coverage(accepted: DataFrame, declined: DataFrame) -> DataFrame:
    """Share of missing values per shared field on both sides, in percent.

    Taken before the scored-decline filter and before sentinel fills: pass
    frames that still hold nulls in ``state`` and ``zip3``.
    """
    fields = FEATURES + CONTEXT

    def side(df, name):
        one = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in fields])
        return one.unpivot([], fields, "field", name)

    both = side(accepted, "a").join(side(declined, "d"), "field")
    return both.select("field", F.round(F.col("a") * 100.0, 3).alias("accepted_missing_pct"),
                       F.round(F.col("d") * 100.0, 3).alias("rejected_missing_pct"))


def unscored_by_year(declined: DataFrame) -> DataFrame:
    return (declined.where(F.col("app_year").isNotNull()).groupBy("app_year")
            .agg(F.count(F.lit(1)).alias("n"),
                 (100.0 * F.avg(F.col("risk_score").isNull().cast("double"))).alias("unscored_pct")))


def overlap_share(accepted: DataFrame, declined: DataFrame, span) -> DataFrame:
    """Share of declines scoring at or above the accepted 1st percentile."""
    floor = localize(quantiles(accepted, [KEY], "risk_score", [0.01]), "floor")
    low = F.get("q", F.lit(0))
    return (declined.join(floor, KEY).groupBy(KEY)
            .agg(F.max(low).alias("accepted_score_p01"),
                 (100.0 * F.avg(F.coalesce((F.col("risk_score") >= low), F.lit(False))
                                .cast("double"))).alias("above_pct"),
                 (100.0 * F.avg(F.col("risk_score").isNull().cast("double"))).alias("missing_pct")))
