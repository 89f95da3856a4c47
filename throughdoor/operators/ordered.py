"""Ordered operators that never hold one key's rows in one task.

A running total needs an order within a key, and one key may be the whole
portfolio. Running totals are taken on two levels: rows are dealt by ranges of
the ordering value, totalled per range, and the few range totals carry the
offsets. Quantiles do not order anything but the neighbourhood of the wanted
rank: a key is cut where its own values lie, pieces that hold no wanted rank
are left out, and a piece too full for a task is cut again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import localize, materialize

TASK_ROWS = 500_000  # a piece with more distinct values than this is cut again
CUTS = 31
SHARE_NOISE = 1e-9


def cumulate(df: DataFrame, keys, order: str, sums, descending: bool = False) -> DataFrame:
    """Add ``<c>_through`` (running total) and ``<c>_all`` (key total) for each ``c``.

    ``df`` has one row per (keys, order). It is evaluated once: the ranges it is
    dealt into are written with their number.
    """
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cut = materialize(df.repartitionByRange(*[F.col(k) for k in keys], turn(order)).withColumn(
        "_range", F.spark_partition_id()), "ranges")
    by_range = cut.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in sums],
    )
    inside = (Window.partitionBy(*keys, "_range").orderBy(turn(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_{c}_in") for c in sums])
    joined = local.join(offsets, [*keys, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_{c}_before") + F.col(f"_{c}_in")).alias(f"{c}_through") for c in sums],
        *[F.col(f"{c}_all") for c in sums],
    )


def _narrowed(seen: DataFrame, keys, wanted: str, facts: DataFrame, task_rows: int) -> DataFrame:
    """The pieces of each key that hold what is wanted, each small enough for a task.

    ``seen`` has (keys, v, amount); ``facts`` a row per key with the total
    ``amount_all``, its rows ``size`` and whatever else ``wanted`` reads. ``wanted`` is a condition
    on ``before`` and ``upto``, the amounts below a piece and up to its end.
    A piece is the open interval (lo, hi), null for no end, or the single value
    lo = hi. ``under`` is the largest value below it.
    """
    keys = list(keys)
    extra = [c for c in facts.columns if c not in [*keys, "size"]]
    none = F.lit(None).cast("double")
    pieces = localize(facts.select(
        *keys, *extra, none.alias("lo"), none.alias("hi"), none.alias("under"), F.lit(0.0).alias("before"),
        F.col("amount_all").cast("double").alias("upto"), "size"), "pieces")
    done = None
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    while True:
        ready = pieces.where(F.col("size") <= task_rows)
        done = ready if done is None else done.unionByName(ready)
        full = pieces.where(F.col("size") > task_rows)
        if full.isEmpty():
            return localize(done, "wanted-pieces")
        inside = seen.join(full, keys).where(_within())
        # cuts follow the values, so a piece shrinks whatever their distribution
        cuts = localize(inside.groupBy(*keys, "lo").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("v", probs, 2000))).alias("cuts")), "cuts")
        near = inside.join(cuts, [inside[k].eqNullSafe(cuts[k]) for k in [*keys, "lo"]]).select(
            inside["*"], "cuts")
        # 2 i + 1: the i-th cut itself; 2 i: the values below it and above the cut before
        at = F.expr("size(filter(cuts, c -> c < v)) + size(filter(cuts, c -> c <= v))")
        kept = ["lo", "hi", "under", "before"]
        parts = near.groupBy(*keys, *extra, *kept, "cuts", at.alias("at")).agg(
            F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("size"), F.max("v").alias("top"))
        run = Window.partitionBy(*keys, "lo").orderBy("at")
        upto = F.col("before") + F.sum("amount").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        parts = parts.select(
            *keys, *extra, upto.alias("upto"), "at", "cuts", "lo", "hi", "size", "amount",
            F.coalesce(F.lag("top").over(run), F.col("under")).alias("under"))
        i = F.floor(F.col("at") / 2).cast("int")
        own = F.col("at") % 2 == 1
        pieces = localize(parts.withColumn("before", F.col("upto") - F.col("amount")).select(
            *keys, *extra,
            F.when(own, F.get("cuts", i)).otherwise(F.coalesce(F.get("cuts", i - 1), F.col("lo"))).alias("lo"),
            F.when(own, F.get("cuts", i)).otherwise(F.coalesce(F.get("cuts", i), F.col("hi"))).alias("hi"),
            "under", "before", "upto", F.when(own, F.lit(1)).otherwise(F.col("size")).cast("bigint").alias("size"),
        ).where(wanted), "pieces")


def _within() -> Column:
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    return F.when(lo == hi, v == lo).otherwise(F.coalesce(v > lo, F.lit(True)) & F.coalesce(v < hi, F.lit(True)))


def quantiles(df: DataFrame, keys, value: str, probs, rows: str | None = None, name: str = "q",
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles: one array per key.

    ``rows`` names the row counts of a histogram. Nulls do not count; a key
    without values has no row.
    """
    keys = list(keys)
    n = F.lit(1) if rows is None else F.col(rows)
    seen = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("v"), n.cast("bigint").alias("amount"))
    facts = seen.groupBy(*keys).agg(F.sum("amount").alias("amount_all"), F.count(F.lit(1)).alias("size"))
    # a rank that misses an integer by float noise is that integer
    ranks = [f"floor({float(p)!r}D * (amount_all - 1) + 1e-9D)" for p in probs]
    facts = facts.withColumn("ranks", F.expr(f"array({', '.join(ranks)})"))

    def ranks_below(x):
        return " + ".join(f"int(get(ranks, {i}) < {x})" for i in range(len(probs)))

    # pieces that hold a wanted rank or the one above it, found by counting ranks
    kept = _narrowed(seen, keys, f"{ranks_below('upto')} > {ranks_below('before - 1')}", facts, task_rows)
    near = seen.join(kept, keys).where(_within())
    piece = [*keys, "lo", "hi"]
    inside = Window.partitionBy(*piece).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = near.groupBy(*piece, "v").agg(F.sum("amount").alias("n")).withColumn("_n", F.sum("n").over(inside))
    # ranks come back by a join, so they are not shuffled with every value
    run = run.join(kept, [run[k].eqNullSafe(kept[k]) for k in piece]).select(
        *[run[k] for k in piece], "v", "n", "amount_all", "ranks", (F.col("before") + F.col("_n")).alias("n_through"))
    run = run.where(f"{ranks_below('n_through')} > {ranks_below('n_through - n - 1')}")
    asked = ", ".join(
        f"struct({i} AS i, get(ranks, {i}) AS r, greatest(0D, {float(p)!r}D * (amount_all - 1) - get(ranks, {i})) AS part)"
        for i, p in enumerate(probs))
    hit = run.select(*keys, "v", F.expr("n_through - n").alias("a"),
                     F.col("n_through").alias("b"), F.explode(F.expr(
                         f"filter(array({asked}), s -> n_through - n <= s.r + 1 AND s.r < n_through)"
                     )).alias("s"))
    each = hit.groupBy(*keys, F.col("s.i").alias("i")).agg(
        F.expr("max(CASE WHEN a <= s.r AND s.r < b THEN v END)").alias("low"),
        F.expr("max(CASE WHEN s.r + 1 < b THEN v END)").alias("high"),
        F.max("s.part").alias("part"))
    spot = F.expr("struct(i, low + coalesce(high - low, 0D) * part AS x)")
    return each.withColumn("spot", spot).groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(spot)), s -> s.x)").alias(name))


def weighted_quantile(df: DataFrame, keys, value: str, weight: str, row_id: str,
                      share: Column, name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Value where the cumulative weight share reaches ``share``, per key.

    Linear between neighbouring values over the weight of the first row (by
    ``row_id``) of the upper one, as if rows were sorted by (value, id);
    below the first value it stays there. ``share`` is an aggregate over rows
    of ``df`` (for example accepted weight over all weight). The rows are read
    once; only the piece where the share is crossed is ordered.
    """
    keys = list(keys)
    sums = materialize(df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.sum(weight).alias("amount"),
        F.min_by(weight, row_id).alias("lead"),
        F.sum(share).alias("hit"),
    ).where("v IS NOT NULL"), "weights")
    facts = localize(sums.groupBy(*keys).agg(
        F.sum("amount").alias("amount_all"), F.count(F.lit(1)).alias("size"), (F.sum("hit") / F.sum("amount")).alias("goal")), "goals")
    # up to float noise on both sides: the crossing itself is found among the rows
    kept = _narrowed(sums, keys, f"upto / amount_all >= goal - {SHARE_NOISE!r}D AND before / amount_all < goal + {SHARE_NOISE!r}D",
                     facts, task_rows)
    piece = [*keys, "lo", "hi"]
    inside = Window.partitionBy(*piece).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.join(kept, keys).where(_within()).withColumn(
        "reach", (F.col("before") + F.sum("amount").over(inside)) / F.col("amount_all"))
    up, down = F.col("reach") >= F.col("goal"), F.col("reach") < F.col("goal")
    got = run.groupBy(*keys).agg(
        F.min(F.when(up, F.col("v"))).alias("v1"),
        F.min_by(F.col("lead") / F.col("amount_all"), F.when(up, F.col("v"))).alias("w1"),
        F.max(F.when(down, F.col("v"))).alias("v0"),
        F.max(F.when(down, F.col("reach"))).alias("c0"),
        F.max("goal").alias("goal"),
        F.min_by("under", "before").alias("under"), F.min(F.col("before") / F.col("amount_all")).alias("below"),
    )
    low = F.coalesce("v0", "under")
    reached = F.coalesce("c0", F.when(F.col("under").isNotNull(), F.col("below")))
    part = F.least(F.lit(1.0), (F.col("goal") - reached) / F.col("w1"))
    between = low + (F.col("v1") - low) * part
    return got.select(*keys, F.coalesce(between, F.col("v1"), low).alias(name))
