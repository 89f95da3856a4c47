"""Design vectors counted in tasks agree with rows joined to their bins, and small tables are dealt to all cores."""
import random

from pyspark.sql import functions as F

from throughdoor.operators import backtest, binning, policy
from throughdoor.config import Audit, Masking
from throughdoor.runtime import localize, spread

NUM, CAT = ["a", "b"], ["c"]


def _rows(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), None if r.random() < 0.1 else r.choice([r.random(), 0.5, float("nan")]),
             None if r.random() < 0.1 else float(r.randrange(9)), r.choice(["p", "q", "rare", None]),
             float(r.random() < 0.3), r.choice([0.0, 0.5, 2.0])) for _ in range(4000)]
    return spark.createDataFrame(rows, "k string, a double, b double, c string, bad double, w double").repartition(3)


def _plain(rows, keys, look, variants):
    used = binning.counted(rows, keys, NUM + CAT, variants)
    coded = used.join(look, keys).select(*[used[k] for k in keys], "w", "wy", *binning.woe_columns(NUM, CAT, 8))
    xs = [f"{f}__woe" for f in NUM + CAT]
    return coded.groupBy(*keys, *xs).agg(F.sum("w").alias("sw"), F.sum("wy").alias("swy"))


def _same(got, want):
    key = lambda r: tuple(str(x) if isinstance(x, str) else f"{x:.9f}" for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*got.columns).collect()))


def _fitted(spark, variants, keys):
    rows = _rows(spark)
    bins = binning.variant_bins(rows, ["k"], keys, NUM, CAT, variants)
    return rows, localize(binning.lookup_row(bins, keys, NUM, CAT), "look")


def _two():
    half = (F.col("b") > 3).cast("int")
    return [binning.Variant(F.lit(1), F.col("w"), F.col("w") * F.col("bad"), {"m": F.lit("all")}),
            binning.Variant(half, F.coalesce(half * F.col("w"), F.lit(0.0)), F.coalesce(half * F.col("w") * F.col("bad"), F.lit(0.0)), {"m": F.lit("some")})]


def test_designs_of_variants_are_those_of_joined_rows(spark, monkeypatch):
    rows, look = _fitted(spark, _two(), ["k", "m"])
    want = _plain(rows, ["k", "m"], look, _two())
    _same(binning.designs(rows, ["k", "m"], look, NUM, CAT, _two()), want)
    monkeypatch.setattr(binning, "HELD_ROWS", 500)
    monkeypatch.setattr(binning, "CODES", 1)
    _same(binning.designs(rows, ["k", "m"], look, NUM, CAT, _two()), want)


def test_rows_without_a_key_fan_out(spark):
    rows, look = _fitted(spark, _two(), ["k", "m"])
    one = [binning.Variant(F.lit(1), F.lit(1.0), F.col("bad"), {})]
    each = rows.crossJoin(spark.createDataFrame([("all",), ("some",)], "m string"))
    _same(binning.designs(rows, ["k", "m"], look, NUM, CAT, one), _plain(each, ["k", "m"], look, one))


def test_small_tables_reach_all_cores(spark):
    few = spark.range(1000).coalesce(1)
    assert spread(few).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_pool_is_dealt_to_all_cores(spark):
    rows = spark.range(3000).coalesce(1).select(
        F.col("id").cast("string").alias("app_id"), (F.col("id") % 300 + 400).cast("double").alias("risk_score"),
        F.lit(1.0).alias("dti"), F.lit(2.0).alias("emp_length_yrs"), F.col("id").cast("double").alias("amount_requested"),
        F.lit("s").alias("state"), (F.col("id") % 5 == 0).cast("double").alias("bad"))
    spec = Audit(masking=Masking(fit_approved=20, fit_declined=5))
    m = backtest.mask(rows, spec, policy.scenario_grid(spec.masking, ["random"], [0.3], 2))
    assert len(m.pool.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_further_sums_of_designs(spark):
    rows, look = _fitted(spark, _two(), ["k", "m"])
    one = binning.Variant(F.lit(1), F.lit(1.0), F.col("w"), {"m": F.lit("all")})
    got = binning.designs(rows, ["k", "m"], look, NUM, CAT, [one], more={"w2": F.col("w") * F.col("w")})
    total = rows.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    assert tuple(got.agg(F.sum("sw"), F.sum("swy"), F.sum("w2")).first()) == tuple(total)


def test_equal_amounts_of_a_replicate_lie_together(spark):
    rows = spark.range(4000).repartition(8).select(
        F.col("id").alias("app_id"), (F.col("id") % 300 + 400).cast("double").alias("risk_score"),
        F.lit(1.0).alias("dti"), F.lit(2.0).alias("emp_length_yrs"), (F.col("id") % 500).cast("double").alias("amount_requested"),
        F.lit("s").alias("state"), (F.col("id") % 5 == 0).cast("double").alias("bad"))
    spec = Audit(masking=Masking(fit_approved=20, fit_declined=5))
    pool = backtest.mask(rows, spec, policy.scenario_grid(spec.masking, ["random"], [0.3], 2)).pool
    where = [F.input_file_name(), "replicate", "amount_requested"]
    files, pairs = len(pool.inputFiles()), pool.select("replicate", "amount_requested").distinct().count()
    assert files >= spark.sparkContext.defaultParallelism
    assert pool.select(*where).distinct().count() <= pairs + 2 * files
