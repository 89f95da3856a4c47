import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from throughdoor.config import NO_CORRECTION, Audit, CashRules, Masking, RegionRules, Resampling, Sampling, ScaleCheck
from throughdoor.operators import backtest, binning, economics, inference, policy, population
from throughdoor.plans.audit import run_audit
from throughdoor.plans.frames import frames
from throughdoor.sources import applications
from throughdoor.streaming import intake

SF = "/root/testdata/sf0.001"
SPEC = Audit(masking=Masking(fit_approved=100, fit_declined=30, replicates=2, rates=(0.3, 0.5)),
             resampling=Resampling(replicates=100), regions=RegionRules(least_applications=10))


def test_audit_writes_every_table(spark):
    f = frames(spark, SF)
    out = tempfile.mkdtemp(prefix="audit-")
    got = run_audit(spark, f.accepted_raw, f.declined_raw, SPEC, out)
    assert len(got) == 19
    for name, table in got.items():
        assert table.count() > 0, name
    ranked = got["07_method_ranking"]
    assert {r["method"] for r in ranked.collect()} == {NO_CORRECTION, "parcelling", "fuzzy", "ipw", "heckman"}
    head = {(r["section"], r["metric"], r["key"]): r["value"] for r in got["headline_numbers"].collect()}
    assert head[("data", "n_accepted_total", "")] == 783 and head[("data", "n_declined_total", "")] == 690


def test_stream_samples_the_same_rows_as_the_batch(spark):
    f = frames(spark, SF)
    folder, out, mark = (tempfile.mkdtemp(prefix="stream-") for _ in range(3))
    f.declined_raw.repartition(3).write.mode("overwrite").parquet(folder)
    spec = Audit(sample=Sampling(declined_rate=0.4))
    rows = intake.intake(intake.stream_declined(spark, folder, f.declined_raw.schema), spec)
    intake.write(rows, out, mark).awaitTermination(120)
    batch = intake.intake(f.declined_raw, spec)
    streamed = spark.read.parquet(out)
    assert {r[0] for r in streamed.select("app_id").collect()} == {r[0] for r in batch.select("app_id").collect()}


def test_cache_path_follows_the_settings(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    root = tempfile.mkdtemp(prefix="cache-")
    for seed in (1, 1, 2):
        applications.cached(spark, "t", build, Audit(seed=seed), "in.csv", root=root).count()
    assert len(made) == 2


def test_file_without_a_key_gets_one_from_its_fields(spark):
    path = f"{tempfile.mkdtemp(prefix='csv-')}/declined"
    spark.createDataFrame([("1000", "2016-01-02", "640", "12.5%", "945xx", "CA", "1 year", "9"),
                           ("", "", "", "", "", "", "", "")],
                          list(applications.DECLINED_FIELDS) + ["Policy Code"]).write.option("header", True).csv(path)
    got = applications.read_declined(spark, path).collect()
    assert len({r["app_id"] for r in got}) == len(got) and got[0]["risk_score"] in (640.0, None)


def test_equal_rows_of_a_keyless_file_are_rows_of_their_own(spark):
    path = f"{tempfile.mkdtemp(prefix='csv-')}/declined"
    one = ("1000", "2016-01-02", "640", "12.5%", "945xx", "CA", "1 year")
    blank = ("1000", "2016-01-02", "640", "12.5%", "945xx", None, "1 year")
    spark.createDataFrame([one] * 3 + [blank], list(applications.DECLINED_FIELDS)).write.option("header", True).csv(path)
    got = applications.read_declined(spark, path).collect()
    assert len(got) == 4 and len({r["app_id"] for r in got}) == 4
    assert {r["app_id"] for r in got} == {r["app_id"] for r in applications.read_declined(spark, path).repartition(5).collect()}


def test_a_replaced_input_is_noticed(spark):
    root, path = tempfile.mkdtemp(prefix="cache-"), f"{tempfile.mkdtemp(prefix='in-')}/t.csv"
    seen = []
    for text in ("a\n1\n", "a\n1\n2\n"):
        with open(path, "w") as out:
            out.write(text)
        table = applications.cached(spark, "t", lambda: spark.read.option("header", True).csv(path), Audit(), path, root=root)
        seen.append(table.count())
    assert seen == [1, 2]


def test_swap_keeps_todays_volume(spark):
    f = frames(spark, SF)
    rows = economics.swap_set(f.proxy_applicants, ["method"])
    for r in rows.groupBy("method").agg(
            F.sum(F.when(F.col("swap").isin("keep", "in"), F.col("design_w"))).alias("later"),
            F.sum(F.when(F.col("accepted") == 1, F.col("design_w"))).alias("today")).collect():
        assert abs(r["later"] / r["today"] - 1) < 0.02


def test_applicant_bands_differ_from_calibration_bands(spark):
    f = frames(spark, SF)
    rows = f.proxy_applicants
    own = economics.with_bands(rows, ["portfolio", "method"], f.proxy_calibration, "pd_baseline",
                               CashRules(bands_from="calibration"))
    again = economics.with_bands(rows, ["portfolio", "method"], f.proxy_calibration, "pd_baseline", CashRules())
    a = own.where("accepted = 1 AND method = 'steep'").groupBy("band").count().agg(F.max("count")).first()[0]
    b = again.where("method = 'steep'").groupBy("band").count().agg(F.max("count")).first()[0]
    total = rows.where("method = 'steep'").count()
    assert b < 0.25 * total and a < 0.25 * 519


# --- summaries against hand-made rows ----------------------------------------------
@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for cutoff in ("risk_hard", "random"):
        for rate in (0.1, 0.3, 0.5):
            for rep in range(4):
                noise = 0.001 * (rep - 1.5)
                for method, bias in ((NO_CORRECTION, 0.005 if cutoff == "random" else 0.19 * rate),
                                     ("ipw", 0.03 * rate), ("fuzzy", 0.05 + 0.01 * rate)):
                    out.append((cutoff, rate, rep, method, bias + noise, 0.01, 0.0))
    df = spark.createDataFrame(out, "cutoff_type string, rejection_rate double, replicate int, method string, "
                                    "bad_rate_bias double, gini_bias double, gini_uplift double")
    for c in ("actual_ttd_gini", "truth_ttd_bad_rate", "oracle_ttd_gini", "realised_rejection_rate"):
        df = df.withColumn(c, F.lit(0.1))
    return df.withColumn("skipped", F.lit(None).cast("string"))


def test_breaking_point_facts(rows):
    got = backtest.breaking_point(backtest.summarise(rows)).first()
    assert got["best_rate"] == 0.5 and got["best_methods"] == "ipw" and got["whole_range"]
    assert got["baseline_holds_up_to"] == 0.1 and not got["baseline_held_as_far"]
    none = backtest.breaking_point(backtest.summarise(rows.where("method = 'fuzzy'"))).first()
    assert none["best_rate"] is None and none["best_methods"] == "" and none["lowest_rate"] == 0.1


def test_a_skipped_scenario_is_reported(spark):
    f = frames(spark, SF)
    spec = Audit(masking=Masking(fit_approved=250, fit_declined=30, replicates=1, rates=(0.3, 0.7), policies=("random",)))
    table = backtest.run(f.terminal, spec, methods=("fuzzy",))
    assert {r["rejection_rate"]: r["n_reps"] for r in backtest.summarise(table).collect()} == {0.3: 1, 0.7: 0}
    got = table.collect()
    assert {(r["rejection_rate"], r["method"], r["skipped"], r["est_ttd_bad_rate"] is None) for r in got} == {
        (0.3, NO_CORRECTION, None, False), (0.3, "fuzzy", None, False),
        (0.7, NO_CORRECTION, "too few approved rows", True), (0.7, "fuzzy", "too few approved rows", True)}


def test_nothing_is_sampled_by_default(spark):
    f = frames(spark, SF)
    panel = population.build_panel(f.accepted, f.declined, Audit())
    assert panel.rates["n_declined_sampled"] == 690 and panel.rates["n_accepted_used"] == 519
    pool = policy.draw_pools(f.terminal.select("app_id"), Masking(), 1, 2)
    assert pool.groupBy("replicate").count().where("count <> 519").count() == 0


def test_null_case_flags_the_inventing_method(rows):
    got = {r["method"]: r for r in backtest.null_case(rows).collect()}
    assert got["fuzzy"]["hallucinates"] and not got["ipw"]["hallucinates"]
    assert got[NO_CORRECTION]["p_one_sided"] == 1.0 and got["fuzzy"]["n_pairs"] == 12


def test_ranking_and_summary(rows):
    s = backtest.summarise(rows)
    one = s.where("cutoff_type = 'risk_hard' AND rejection_rate = 0.3 AND method = 'ipw'").first()
    assert one["bad_rate_bias"] == pytest.approx(0.009) and one["n_reps"] == 4
    assert one["bad_rate_bias_sd"] == pytest.approx(0.00129099, abs=1e-6)
    best = backtest.rank_methods(s, ("risk_hard",)).orderBy("mean_abs_bad_rate_bias").first()
    assert best["method"] == "ipw"


def test_methods_are_found_by_name(spark):
    f = frames(spark, SF)
    with pytest.raises(ValueError, match="unknown methods"):
        inference.infer(f.context, ("fuzzy", "guess"))

    def optimist(ctx):
        """Every decline is good."""
        seen, w = F.col("s") == 1, F.col("design_w")
        count = binning.Variant(F.lit(1), w, F.when(seen, w * F.col("bad")).otherwise(0.0), {})
        rejected = ctx.cells.where("s = 0").groupBy(*ctx.keys).agg(F.lit(0.0).alias("est_reject_bad_rate"))
        return inference.View("optimist", ctx, lambda rows: rows, [count], ctx.through_door(rejected), rejected.limit(0))

    inference.register("optimist", optimist)
    try:
        got = {r["method"]: r for r in inference.infer(f.context, ("fuzzy", "optimist")).estimates().collect()}
    finally:
        del inference.LABELLING["optimist"]
    assert got["optimist"]["est_ttd_bad_rate"] < got["fuzzy"]["est_ttd_bad_rate"] and got["optimist"]["est_reject_bad_rate"] == 0
    with pytest.raises(ValueError):
        inference.register("heckman", optimist)


def test_nothing_written_grows_with_rows_times_scenarios(spark):
    """The masked pool has a row per row and replicate, whatever the number of policies; decisions are those of the fan-out."""
    f = frames(spark, SF)
    spec = Audit(masking=Masking(fit_approved=100, fit_declined=30, replicates=2, rates=(0.3, 0.5)))
    grid = policy.scenario_grid(spec.masking)
    m = backtest.mask(f.terminal, spec, grid)
    assert m.pool.count() == 2 * f.terminal.count() and len(m.slots) == 6
    assert m.rows.count() == f.terminal.count() * m.facts.count()
    pool = policy.draw_pools(f.terminal.select("app_id", "risk_score", "bad"), spec.masking, spec.seed, 2)
    fanned = policy.apply_policies(pool, grid, spec.masking, spec.seed).where("NOT is_eval").groupBy("scenario").agg(
        F.count_if("accepted_here").alias("n")).collect()
    facts = {r["scenario"]: r["n_accepted"] for r in m.all_facts().collect()}
    assert {r["scenario"]: r["n"] for r in fanned} == facts


def test_a_skipped_group_of_the_scale_check_has_its_counts(spark):
    f = frames(spark, SF)
    spec = Audit(masking=Masking(fit_approved=250, fit_declined=30, rates=(0.3,), replicates=2),
                 scale_check=ScaleCheck(multiples=(1.0, 2.0), policies=("random",), replicates=2))
    got = backtest.scale_sensitivity(f.terminal, replace(spec, masking=replace(spec.masking, fit_approved=10**6)))
    assert {(r["method"], r["reject_bad_scale"], r["n_fitted"], r["n_skipped"], r["abs_bad_rate_bias"]) for r in got.collect()} == {
        (m, x, 0, 2, None) for m in ("parcelling", "fuzzy") for x in (1.0, 2.0)}
    assert {r["n_fitted"] for r in backtest.scale_sensitivity(f.terminal, spec).collect()} == {2}
