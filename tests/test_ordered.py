import numpy as np
import pytest
from pyspark.sql import functions as F

from throughdoor.operators import economics, measures, ordered, sampling
from throughdoor.config import Resampling
from throughdoor.functions.draws import uniform


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(50, 20, 4000), 1)
    key = rng.integers(0, 3, 4000)
    return x, key, spark.createDataFrame(
        [(int(i), str(k), float(v)) for i, (k, v) in enumerate(zip(key, x))], "id long, k string, x double")


PROBS = [0.0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.77, 0.99, 1.0]


@pytest.mark.parametrize("task_rows", [1, 7, 100, ordered.TASK_ROWS])
def test_quantiles_equal_numpy(numbers, task_rows):
    x, key, df = numbers
    for r in ordered.quantiles(df, ["k"], "x", PROBS, task_rows=task_rows).collect():
        assert np.allclose(r["q"], np.quantile(x[key == int(r["k"])], PROBS), atol=1e-12)


def test_one_hot_key_and_partition_counts_do_not_change_quantiles(spark, numbers):
    _, _, df = numbers
    hot = df.withColumn("k", F.lit("all"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(ordered.quantiles(hot, ["k"], "x", PROBS, task_rows=50).first()["q"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_values_crowded_in_one_place(spark):
    """Ten million times the same span: most values a thousandth of it apart, one value a third of all rows."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random(20_000) * 1e-6, np.full(15_000, 5e-7), 1e7 * rng.random(50), -(10.0 ** rng.integers(-300, 300, 50))])
    df = spark.createDataFrame(spark.sparkContext.parallelize([("a", float(v)) for v in x], 8), "k string, x double")
    got = ordered.quantiles(df, ["k"], "x", PROBS, task_rows=500).first()["q"]
    assert np.allclose(got, np.quantile(x, PROBS), rtol=1e-12, atol=0)


def test_histograms_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", None, 5), ("a", 2.0, 1), ("b", None, 4), ("c", 7.0, 10**12)],
                               "k string, x double, n long")
    got = {r["k"]: r["q"] for r in ordered.quantiles(df, ["k"], "x", [0.0, 0.5, 1.0], rows="n", task_rows=1).collect()}
    assert got == {"a": [1.0, 1.0, 2.0], "c": [7.0, 7.0, 7.0]}


def test_a_million_scores_in_a_thousandth_of_the_range(spark):
    """Running totals are dealt by where the scores lie: no range holds more than a few times its share."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("k"), (0.5 + F.col("id") * 1e-9).alias("s"), F.lit(1.0).alias("w"),
                                 (F.col("id") % 4 == 0).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = ordered.cumulate(rows.select("k", "s", "w"), ["k"], "s", ["w"], descending=True)
        tasks = run.groupBy("k", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(tasks) >= 4 and max(r["n"] for r in tasks) < n / 2
        far = run.agg(F.max(F.abs(F.col("w_through") - (F.lit(n) - F.rint((F.col("s") - 0.5) * 1e9)))).alias("e")).first()["e"]
        assert far == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = measures.discrimination(rows, ["k"], "s", "y", "w").first()
    # every fourth score is bad, the lowest first: it beats one and a half good ones in four less on average
    y = (np.arange(n) % 4 == 0).astype(float)
    below = np.cumsum(1 - y)
    assert got["auc"] == pytest.approx((below * y).sum() / (y.sum() * (1 - y).sum()), abs=1e-9)


def test_running_totals_descending(numbers):
    x, key, df = numbers
    hist = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    got = ordered.cumulate(hist, ["k"], "x", ["n"], descending=True).collect()
    for r in got:
        mine = x[key == int(r["k"])]
        assert r["n_through"] == (mine >= r["x"]).sum() and r["n_all"] == len(mine)


@pytest.mark.parametrize("task_rows", [1, 20, ordered.TASK_ROWS])
def test_weighted_quantile_equals_interpolation(spark, task_rows):
    rng = np.random.default_rng(8)
    v, w = rng.random(500), rng.integers(1, 5, 500).astype(float)
    yes = rng.random(500) < 0.4
    df = spark.createDataFrame([(i, "a", float(a), float(b), float(b) if c else 0.0) for i, (a, b, c)
                                in enumerate(zip(v, w, yes))], "id long, k string, v double, w double, h double")
    got = ordered.weighted_quantile(df, ["k"], "v", "w", "id", F.col("h"), "q", task_rows).first()["q"]
    o = np.argsort(v)
    want = np.interp(w[yes].sum() / w.sum(), np.cumsum(w[o]) / w.sum(), v[o])
    assert abs(got - want) < 1e-12


def test_fixed_size_sample_is_exact_per_key(numbers):
    _, key, df = numbers
    got = sampling.fixed_size(df, ["k"], "id", 300, "s")
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"0": 300, "1": 300, "2": 300}
    assert sampling.fixed_size(df, ["k"], "id", 10**6, "s").count() == len(key)


def test_capped_sample_keeps_weight_totals(numbers):
    _, _, df = numbers
    rows = df.withColumn("side", (F.col("x") > 70).cast("int")).withColumn("w", F.lit(2.0))
    got = sampling.capped_two_sided(rows, ["k"], "side", "id", "w", 500, 100, "c")
    old = {tuple(r)[:2]: r[2] for r in rows.groupBy("k", "side").agg(F.sum("w")).collect()}
    new = {tuple(r)[:2]: (r[2], r[3]) for r in got.groupBy("k", "side").agg(F.sum("w"), F.count("w")).collect()}
    for k, (total, n) in new.items():
        assert abs(total - old[k]) < 1e-6 and n >= 100


# --- discrimination ---------------------------------------------------------------
@pytest.fixture(scope="module")
def judged(spark):
    """Outcomes and scores from hash draws: one score that knows nothing, one that leans on the outcome."""
    rows = spark.range(6000).select(
        F.lit("a").alias("k"), F.col("id"), (uniform("id", "outcome") < 0.3).cast("double").alias("y"),
        F.round(uniform("id", "blind"), 3).alias("blind"), (1 + F.col("id") % 4).cast("double").alias("w"))
    return rows.withColumn("lean", F.round(F.col("y") * 0.4 + uniform("id", "noise"), 2)).cache()


def measured(df, score, weight="one"):
    return measures.discrimination(df.withColumn("one", F.lit(1.0)), ["k"], score, "y", weight).first()


def test_auc_is_the_share_of_ordered_pairs(judged):
    pdf = judged.toPandas()
    bad, good = pdf[pdf.y == 1], pdf[pdf.y == 0]
    for score in ("blind", "lean"):
        a, b = bad[score].to_numpy()[:, None], good[score].to_numpy()[None, :]
        w = bad.w.to_numpy()[:, None] * good.w.to_numpy()[None, :]
        beats = (a > b) + 0.5 * (a == b)
        assert measured(judged, score)["auc"] == pytest.approx(beats.mean(), abs=1e-9)
        assert measured(judged, score, "w")["auc"] == pytest.approx((beats * w).sum() / w.sum(), abs=1e-9)


def test_scores_that_know_nothing_or_everything(judged):
    assert abs(measured(judged, "blind")["gini"]) < 0.05 < 0.3 < measured(judged, "lean")["gini"]
    told, wrong = judged.withColumn("told", 2 * F.col("y")), judged.withColumn("wrong", 1 - F.col("y"))
    assert measured(told, "told")["gini"] == pytest.approx(1.0) and measured(told, "told")["ks"] == pytest.approx(1.0)
    assert measured(wrong, "wrong")["gini"] == pytest.approx(-1.0)


def gini_of(spark, y, s):
    df = spark.createDataFrame([("a", float(a), float(b), 1.0) for a, b in zip(y, s)],
                               "k string, y double, s double, w double")
    return measures.discrimination(df, ["k"], "s", "y", "w").first()


def test_one_class_gives_the_diagonal(spark):
    got = gini_of(spark, np.zeros(10), np.arange(10))
    assert (got["auc"], got["gini"], got["ks"]) == (0.5, 0.0, 0.0)
    df = spark.createDataFrame([("a", 0.0, 0.3, 1.0)], "k string, y double, s double, w double")
    pts = measures.roc_points(df, ["k"], "s", "y", "w").select("fpr", "tpr").collect()
    assert sorted(map(tuple, pts)) == [(0.0, 0.0), (1.0, 1.0)]


def test_effective_sample_size_counts_equal_weights_in_full(judged):
    """(sum w)^2 / sum w^2: rows for equal weights, whatever their scale; fewer for unequal ones."""
    got = judged.groupBy((F.col("id") % 2).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), measures.effective_sample_size(F.lit(0.25)).alias("same"),
        measures.effective_sample_size(F.col("w")).alias("mixed"), F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("w")).alias("ww"))
    for r in got.collect():
        assert r["same"] == pytest.approx(r["n"]) and r["mixed"] == pytest.approx(r["w"] ** 2 / r["ww"])
        assert r["mixed"] < r["n"]


def test_bootstrap_interval_is_that_of_the_multinomial(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(-500, 200, 3000)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "app_id long, k string, x double")
    got = economics.bootstrap(df, ["k"], "x", Resampling(), 1, 1000).first()
    totals = x[rng.integers(0, 3000, (1000, 3000))].sum(axis=1)
    lo, hi = np.quantile(totals, [0.05, 0.95])
    assert abs(got["total"] - x.sum()) < 1e-6
    assert abs((got["ci_hi"] - got["ci_lo"]) / (hi - lo) - 1) < 0.15
    assert got["ci_lo"] < got["total"] < got["ci_hi"]
