"""The registered queries as DuckDB SQL over the same tables.

Each text starts from the base tables. Larger pieces (quantile pre-bins, the
greedy bin merge, the penalised logistic fit) are assembled from named CTEs;
the merge and the Newton rounds are recursive CTEs.
"""
from __future__ import annotations

from ..config import CONTEXT, FEATURES, NO_CORRECTION, NUMERIC
from ..functions import normal
from ..functions.fields import BAD_STATUSES, EMPLOYMENT_YEARS, GOOD_STATUSES
from ..sources.warehouse import ACCEPTED_RAW, APPLICATIONS, DECLINED_RAW
from .frames import WHOLE

SEED = WHOLE.seed
ORACLES: dict = {}


def u(key: str, salt: str) -> str:
    """Draw for a row key and a salt expression."""
    return (f"(CAST(CAST('0x' || substr(md5(concat({key}, '|', {salt})), 1, 13) AS BIGINT) AS DOUBLE)"
            " / CAST(4503599627370496 AS DOUBLE))")


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


def _window(c, lo, hi):
    return f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN {c} END"


_EMP = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in EMPLOYMENT_YEARS.items())


def emp(c):
    return f"CASE trim({c}) {_EMP} END"


def pct(c):
    return f"TRY_CAST(trim(replace(CAST({c} AS VARCHAR), '%', '')) AS DOUBLE)"


def month_year(c):
    return f"CAST(try_strptime({c}, '%b-%Y') AS DATE)"


def outcome(c):
    return (f"CASE WHEN {c} IN ({_quoted(BAD_STATUSES)}) THEN CAST(1 AS DOUBLE) "
            f"WHEN {c} IN ({_quoted(GOOD_STATUSES)}) THEN CAST(0 AS DOUBLE) END")


MID = "(CAST(fico_range_low AS DOUBLE) + CAST(fico_range_high AS DOUBLE)) / 2"

BASE = [
    APPLICATIONS.strip().format(lineitem="lineitem", orders="orders", customer="customer", nation="nation"),
    f"acc_raw AS MATERIALIZED ({ACCEPTED_RAW})",
    f"dec_raw AS MATERIALIZED ({DECLINED_RAW})",
    f"""acc AS MATERIALIZED (SELECT app_id, {_window(MID, 300, 900)} AS risk_score,
      {_window('CAST(dti AS DOUBLE)', 0, 100)} AS dti, {emp('emp_length')} AS emp_length_yrs,
      {_window('CAST(loan_amnt AS DOUBLE)', 500, 40000)} AS amount_requested,
      coalesce(addr_state, 'XX') AS state, lpad(substr(zip_code, 1, 3), 3, '0') AS zip3,
      {month_year('issue_d')} AS app_date, year({month_year('issue_d')}) AS app_year,
      {outcome('loan_status')} AS bad, coalesce(loan_status, '') AS loan_status,
      {pct('int_rate')} AS int_rate, TRY_CAST(regexp_extract(term, '[0-9]+') AS DOUBLE) AS term_months,
      CAST(funded_amnt AS DOUBLE) AS funded_amnt, CAST(total_rec_prncp AS DOUBLE) AS total_rec_prncp,
      CAST(total_rec_int AS DOUBLE) AS total_rec_int, CAST(recoveries AS DOUBLE) AS recoveries,
      CAST(1 AS BIGINT) AS accepted FROM acc_raw WHERE loan_amnt IS NOT NULL)""",
    f"""dec AS MATERIALIZED (SELECT app_id, {_window('CAST(risk_score AS DOUBLE)', 300, 900)} AS risk_score,
      {_window(pct('dti_ratio'), 0, 100)} AS dti, {emp('emp_length')} AS emp_length_yrs,
      {_window('CAST(amount_requested AS DOUBLE)', 500, 40000)} AS amount_requested,
      coalesce(state, 'XX') AS state, lpad(substr(zip_code, 1, 3), 3, '0') AS zip3,
      application_date AS app_date, year(application_date) AS app_year,
      CAST(NULL AS DOUBLE) AS bad, CAST(0 AS BIGINT) AS accepted FROM dec_raw)""",
    "term AS MATERIALIZED (SELECT * FROM acc WHERE bad IS NOT NULL)",
    "sdec AS MATERIALIZED (SELECT * FROM dec WHERE risk_score IS NOT NULL)",
    """wts AS (SELECT CAST((SELECT count(*) FROM acc) AS DOUBLE) / (SELECT count(*) FROM term) AS w_acc,
      CAST(1 AS DOUBLE) AS w_dec)""",
    f"""stacked AS MATERIALIZED (
      SELECT app_id, {', '.join(FEATURES)}, zip3, app_year, accepted, bad, w_acc AS design_w FROM term, wts
      UNION ALL SELECT app_id, {', '.join(FEATURES)}, zip3, app_year, accepted, bad, w_dec FROM sdec, wts)""",
]

PROXY = "(1 / (1 + exp((risk_score - 600) / 40.0)))"
CORRECTED = ("(1 / (1 + exp((risk_score - 2 * coalesce(dti, 40) + coalesce(amount_requested, 20000) / 500.0"
             " - 500) / 40.0)))")
PROXIES = [
    f"pacc AS MATERIALIZED (SELECT *, {PROXY} AS pd, amount_requested AS w FROM term)",
    f"""papp AS MATERIALIZED (
      SELECT *, {PROXY} AS pd_baseline, 'steep' AS method, {CORRECTED} AS pd FROM stacked
      UNION ALL SELECT *, {PROXY}, 'mixed', 0.5 * {CORRECTED} + 0.5 * {PROXY} FROM stacked)""",
    f"""pcal AS MATERIALIZED (SELECT *, {PROXY} AS pd_baseline, (SELECT w_acc FROM wts) AS design_w,
      (total_rec_prncp + total_rec_int + recoveries - nullif(greatest(funded_amnt, 0), 0))
        / nullif(greatest(funded_amnt, 0), 0) AS net,
      1 - (total_rec_prncp + recoveries) / nullif(greatest(funded_amnt, 0), 0) AS lgd FROM term)""",
]


def oracle(name: str, body: str, *ctes, base=None):
    parts = list(BASE if base is None else base)
    for c in ctes:
        parts += c if isinstance(c, list) else [c]
    ORACLES[name] = "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def r(c, n=6, name=None):
    return f"round({c}, {n}) AS {name or c}"


# --- sources, scalar rules -----------------------------------------------------
oracle("read_accepted", """SELECT CAST(app_id AS VARCHAR) AS app_id, CAST(loan_amnt AS DOUBLE) AS loan_amnt,
  CAST(funded_amnt AS DOUBLE) AS funded_amnt, term, int_rate, issue_d, loan_status, emp_length,
  CAST(dti AS DOUBLE) AS dti, zip_code, addr_state, CAST(fico_range_low AS DOUBLE) AS fico_range_low,
  CAST(fico_range_high AS DOUBLE) AS fico_range_high, CAST(total_rec_prncp AS DOUBLE) AS total_rec_prncp,
  CAST(total_rec_int AS DOUBLE) AS total_rec_int, CAST(recoveries AS DOUBLE) AS recoveries FROM acc_raw""")
oracle("read_declined", """SELECT CAST(app_id AS VARCHAR) AS app_id, CAST(amount_requested AS DOUBLE) AS amount_requested,
  CAST(application_date AS VARCHAR) AS application_date, CAST(risk_score AS DOUBLE) AS risk_score, dti_ratio,
  zip_code, state, emp_length FROM dec_raw""")
oracle("cache_applicants", f"""SELECT app_id, {', '.join(r(c) for c in NUMERIC)}, state, zip3, app_date,
  CAST(app_year AS BIGINT) AS app_year, bad, loan_status, {r('int_rate')}, {r('term_months')},
  {r('funded_amnt')}, {r('total_rec_prncp')}, {r('total_rec_int')}, {r('recoveries')}, accepted FROM acc""")
BY_YEAR = """SELECT CAST(app_year AS BIGINT) AS app_year, count(*) AS n,
  round(100 * avg(CASE WHEN risk_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unscored_pct
  FROM dec WHERE app_year IS NOT NULL GROUP BY app_year"""
oracle("write_table", BY_YEAR)
oracle("unscored_by_year", BY_YEAR)
oracle("drop_footer", "SELECT CAST(app_id AS VARCHAR) AS row_text, CAST(loan_amnt AS DOUBLE) AS loan_amnt FROM acc_raw")
oracle("score_midpoint", f"SELECT app_id, {MID} AS score FROM acc_raw")
oracle("plausibility_window", "SELECT app_id, risk_score, dti, amount_requested FROM dec")
oracle("emp_length_years", f"""SELECT app_id, emp_length, {emp("concat(' ', emp_length, ' ')")} AS years,
  {emp('loan_status')} AS unmapped FROM acc_raw""")
oracle("percent_to_double", f"SELECT app_id, {pct('dti_ratio')} AS dti, {pct('zip_code')} AS not_a_number FROM dec_raw")
oracle("zip_prefix", """SELECT app_id, lpad(substr(zip_code, 1, 3), 3, '0') AS zip3,
  lpad(substr(zip_code, 1, 2), 3, '0') AS padded FROM acc_raw""")
oracle("parse_dates", f"""SELECT app_id, {month_year('issue_d')} AS app_date,
  year({month_year('issue_d')}) AS app_year, {month_year('loan_status')} AS bad_text FROM acc_raw
  UNION ALL SELECT app_id, application_date, year(application_date), TRY_CAST(zip_code AS DATE) FROM dec_raw""")
oracle("term_months", """SELECT app_id, TRY_CAST(regexp_extract(term, '[0-9]+') AS DOUBLE) AS term_months,
  TRY_CAST(regexp_extract(loan_status, '[0-9]+') AS DOUBLE) AS no_digits FROM acc_raw""")
oracle("outcome_label", f"SELECT app_id, loan_status, {outcome('loan_status')} AS bad FROM acc_raw")
oracle("sentinel_fill", """SELECT app_id, coalesce(emp_length, 'NA') AS emp_length,
  coalesce(addr_state, 'XX') AS state FROM acc_raw""")
oracle("terminal_only", "SELECT app_id, bad FROM term")
oracle("scored_declines", "SELECT app_id, risk_score FROM sdec")

# --- samples -------------------------------------------------------------------
DRAWN = f"drawn AS MATERIALIZED (SELECT * FROM dec WHERE {u('app_id', repr(f'declined_sample:{SEED}'))} < 0.5)"
USED = f"""used AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (
  ORDER BY {u('app_id', repr(f'accepted_sample:{SEED}'))}, app_id) AS rk FROM term) WHERE rk <= 4000)"""
oracle("bernoulli_sample", """SELECT app_id, round(CAST((SELECT count(*) FROM dec) AS DOUBLE)
  / (SELECT count(*) FROM drawn), 6) AS design_w FROM drawn""", DRAWN)
oracle("fixed_size_sample", "SELECT app_id FROM used", USED)
TEST = u("app_id", repr(f"split:{SEED}")) + " < CAST(0.3 AS DOUBLE)"
oracle("train_test_split", f"SELECT app_id, {TEST} AS is_test FROM term")
REPS = "reps AS (SELECT unnest(range(0, 5)) AS replicate)"
oracle("backtest_pool", f"""SELECT replicate, app_id FROM (SELECT replicate, app_id, row_number() OVER (
  PARTITION BY replicate ORDER BY {u('app_id', f"concat('pool:{SEED}:', replicate)")}, app_id) AS rk
  FROM term, reps) WHERE rk <= 3000""", REPS)
EVAL = u("app_id", f"concat('eval:{SEED}:', replicate)") + " < CAST(0.3 AS DOUBLE)"
oracle("eval_split", f"SELECT replicate, app_id, {EVAL} AS is_eval FROM term, reps", REPS)
oracle("capped_subsample", f"""SELECT app_id, accepted, round(design_w * n / keep, 6) AS design_w FROM (
  SELECT *, row_number() OVER (PARTITION BY accepted ORDER BY {u('app_id', "'cap:1'")}, app_id) AS rk FROM (
    SELECT s.*, n, least(n, greatest(CAST(floor(n * (CAST(5000 AS DOUBLE) / tot)) AS BIGINT), 100)) AS keep
    FROM stacked s JOIN (SELECT accepted, count(*) AS n FROM stacked GROUP BY accepted) USING (accepted),
    (SELECT count(*) AS tot FROM stacked))) WHERE rk <= keep""")
oracle("data_audit", f"""SELECT (SELECT count(*) FROM acc) AS n_accepted_total, (SELECT count(*) FROM dec) AS n_declined_total,
  (SELECT count(*) FROM dec) AS n_declined_sampled, CAST(1 AS DOUBLE) AS reject_sample_rate,
  CAST({SEED} AS BIGINT) AS seed""")
oracle("panel_rates", f"""SELECT na AS n_accepted_total, nt AS n_accepted_terminal, nu AS n_accepted_used,
  nd AS n_declined_total, ns AS n_declined_sampled, nsu AS n_declined_used, CAST(1 AS DOUBLE) AS reject_sample_rate,
  CAST({SEED} AS BIGINT) AS seed, round(wa, 6) AS w_accepted, round(wd, 6) AS w_declined,
  round(1 - CAST(nt AS DOUBLE) / na, 6) AS indeterminate_frac, round(CAST(ns - nsu AS DOUBLE) / ns, 6) AS unscored_frac,
  round(CAST(na AS DOUBLE) / (na + nd), 6) AS population_accept_rate,
  round(wa * nu / (wa * nu + wd * nsu), 6) AS modelled_accept_rate
  FROM (SELECT *, CAST(na AS DOUBLE) / nu AS wa, CAST(nd AS DOUBLE) / ns AS wd FROM (
    SELECT (SELECT count(*) FROM acc) AS na, (SELECT count(*) FROM term) AS nt, (SELECT count(*) FROM term) AS nu,
    (SELECT count(*) FROM dec) AS nd, (SELECT count(*) FROM dec) AS ns,
    (SELECT count(risk_score) FROM dec) AS nsu))""")

# --- unions ---------------------------------------------------------------
oracle("stack_population", f"""SELECT app_id, {', '.join(r(c) for c in NUMERIC)}, state, zip3,
  CAST(app_year AS BIGINT) AS app_year, accepted, bad, round(design_w, 6) AS design_w FROM stacked""")


def doubles(values):
    # as text, so that no decimal type rounds the literal on its way to a double
    return "[" + ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" for v in values) + "]"


def quants(v, probs):
    """Linear quantiles from the sorted list ``v``, as a list."""
    x = f"p * (len({v}) - 1)"
    at = f"CAST(floor({x} + CAST('1e-9' AS DOUBLE)) AS BIGINT)"
    return (f"list_transform({probs}, lambda p: {v}[{at} + 1] + coalesce({v}[{at} + 2] - {v}[{at} + 1], 0)"
            f" * greatest(0, {x} - {at}))")


def above(value, edges):
    """Number of edges below the value."""
    return f"CAST(len(list_filter({edges}, lambda e: {value} > e)) AS BIGINT)"


# --- lookups, aggregates -----------------------------------------------------------
oracle("interval_lookup", f"""SELECT app_id, round(dti, 6) AS dti, {above('dti', 'q')} AS band FROM term,
  (SELECT {quants('v', doubles([0.1, 0.25, 0.5, 0.75, 0.9]))} AS q FROM (
    SELECT list(dti ORDER BY dti) AS v FROM term WHERE dti IS NOT NULL)) WHERE dti IS NOT NULL""")
_COV = [*FEATURES, *CONTEXT]
def _missing(table, c):
    gone = f"{c} IS NULL" + (" OR state = 'XX'" if c == "state" else "")
    return f"(SELECT round(100 * avg(CASE WHEN {gone} THEN 1.0 ELSE 0.0 END), 3) FROM {table})"


COVERAGE = " UNION ALL ".join(
    f"SELECT '{c}' AS field, {_missing('term', c)} AS accepted_missing_pct, {_missing('dec', c)} AS rejected_missing_pct"
    for c in _COV)
oracle("field_coverage", COVERAGE)
oracle("weighted_mean", """SELECT state,
  round(sum(dti * w) FILTER (w IS NOT NULL AND dti IS NOT NULL) / sum(w) FILTER (dti IS NOT NULL), 6) AS dti,
  round(sum(bad * w) / sum(w), 6) AS bad_rate FROM pacc GROUP BY state""", PROXIES)
oracle("effective_sample_size", """SELECT state, round(coalesce(sum(w) * sum(w) / sum(w * w), 0), 6) AS ess,
  count(*) AS n FROM pacc GROUP BY state""", PROXIES)
_P = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
oracle("linear_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS field, unnest({doubles(_P)}) AS p, round(unnest(quantile_cont({c}, {doubles(_P)})), 6) AS v FROM term"
    for c in ("dti", "risk_score", "amount_requested")))
oracle("overlap_share", """SELECT round(any_value(q), 6) AS accepted_score_p01,
  round(100 * avg(CASE WHEN risk_score >= q THEN 1.0 ELSE 0.0 END), 6) AS above_pct,
  round(100 * avg(CASE WHEN risk_score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct
  FROM dec, (SELECT quantile_cont(risk_score, CAST(0.01 AS DOUBLE)) AS q FROM term)""")


def _hist(field, lo, hi, bins, table="stacked", by="accepted"):
    width = (hi - lo) / bins
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {keys}bin_no, round({lo} + bin_no * CAST({width!r} AS DOUBLE), 6) AS left_edge, n,
      round(n / (sum(n) OVER ({over}) * CAST({width!r} AS DOUBLE)), 6) AS density, '{field}' AS field FROM (
      SELECT {keys}CAST(least(floor(({field} - {lo}) / CAST({width!r} AS DOUBLE)), {bins - 1}) AS BIGINT) AS bin_no,
      count(*) AS n FROM {table} WHERE {field} BETWEEN {lo} AND {hi} GROUP BY ALL)"""


oracle("density_histogram", f"{_hist('risk_score', 300.0, 900.0, 60)} UNION ALL {_hist('dti', 0.0, 100.0, 50)}")
oracle("decision_correlation", "SELECT method, round(corr(pd, 1.0 - accepted), 6) AS corr FROM papp GROUP BY method", PROXIES)


# --- ordered measures ----------------------------------------------------------------
def areas(p, src, keys, score, tp, fp):
    """CTEs for AUC, Gini and KS per key, from bad and good weight per row."""
    k = ", ".join(keys)
    lead = f"{k}, " if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    return [
        f"""{p}_at AS (SELECT {lead}{score} AS sc, sum({tp}) AS tp, sum({fp}) AS fp FROM {src} GROUP BY ALL)""",
        f"""{p}_run AS MATERIALIZED (SELECT *, sum(tp) OVER ({part} ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS ctp,
          sum(fp) OVER ({part} ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS cfp,
          sum(tp) OVER ({part}) AS pp, sum(fp) OVER ({part}) AS nn FROM {p}_at)""",
        f"""{p} AS MATERIALIZED (SELECT *, 2 * auc - 1 AS gini FROM (SELECT {lead}
          CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN sum(fp * (2 * ctp - tp)) / (2 * max(pp) * max(nn)) ELSE 0.5 END AS auc,
          CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN max(abs(ctp / nullif(pp, 0) - cfp / nullif(nn, 0))) ELSE 0 END AS ks
          FROM {p}_run {f'GROUP BY {k}' if keys else ''}))""",
    ]


PVALID = "pvalid AS (SELECT * FROM pacc WHERE w > 0)"
oracle("roc_curve", """SELECT round(sc, 6) AS threshold, round(cfp / nn, 6) AS fpr, round(ctp / pp, 6) AS tpr
  FROM z_run UNION ALL SELECT NULL, 0.0, 0.0""", PROXIES, areas("z", "pacc", [], "pd", "bad", "1 - bad"))
oracle("auc_gini_ks", "SELECT state, round(auc, 6) AS auc, round(gini, 6) AS gini, round(ks, 6) AS ks FROM z",
       PROXIES, PVALID, areas("z", "pvalid", ["state"], "pd", "w * bad", "w * (1 - bad)"))
oracle("metric_bundle", """SELECT CAST(app_year AS BIGINT) AS app_year, round(bad_rate, 6) AS bad_rate, n, n_used, round(auc, 6) AS auc,
  round(gini, 6) AS gini, round(ks, 6) AS ks FROM (SELECT app_year, sum(bad * w) / sum(w) AS bad_rate, count(*) AS n,
  CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_used FROM pacc GROUP BY app_year) LEFT JOIN z USING (app_year)""",
       PROXIES, PVALID, areas("z", "pvalid", ["app_year"], "pd", "w * bad", "w * (1 - bad)"))


def swap_cut(src="papp", keys="method"):
    """CTE ``cut``: weighted quantile of pd at the weighted share of accepted rows."""
    return [
        f"""sw_at AS (SELECT {keys}, pd, sum(design_w) AS ww, arg_min(design_w, app_id) AS lead,
          sum(CASE WHEN accepted = 1 THEN design_w ELSE 0 END) AS hit FROM {src} GROUP BY {keys}, pd)""",
        f"""sw_run AS MATERIALIZED (SELECT *, sum(ww) OVER (PARTITION BY {keys} ORDER BY pd ROWS UNBOUNDED PRECEDING) / tot AS c,
          hits / tot AS goal FROM (SELECT *, sum(ww) OVER (PARTITION BY {keys}) AS tot,
          sum(hit) OVER (PARTITION BY {keys}) AS hits FROM sw_at))""",
        f"""cut AS MATERIALIZED (SELECT {keys}, coalesce(v0 + (v1 - v0) * least(1.0, (goal - c0) / w1), v1, v0) AS cutoff FROM (
          SELECT {keys}, min(CASE WHEN c >= goal THEN pd END) AS v1,
          arg_min(lead / tot, CASE WHEN c >= goal THEN pd END) AS w1, max(CASE WHEN c < goal THEN pd END) AS v0,
          max(CASE WHEN c < goal THEN c END) AS c0, max(goal) AS goal FROM sw_run GROUP BY {keys}))""",
    ]


oracle("weighted_quantile", "SELECT method, round(cutoff, 6) AS cutoff FROM cut", PROXIES, swap_cut())
SWAPPED = """swapped AS MATERIALIZED (SELECT p.*, cutoff, CASE WHEN accepted = 1 AND pd <= cutoff THEN 'keep'
  WHEN accepted = 1 THEN 'out' WHEN pd <= cutoff THEN 'in' ELSE 'decline' END AS swap FROM papp p JOIN cut USING (method))"""
oracle("swap_set", "SELECT method, app_id, swap, round(cutoff, 6) AS cutoff FROM swapped", PROXIES, swap_cut(), SWAPPED)


# --- weight of evidence -------------------------------------------------------------------
def long_rows(src, features, y, w, keys=()):
    lead = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(
        f"SELECT {lead}'{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST({w} AS DOUBLE) AS w, CAST({w} * {y} AS DOUBLE) AS wy FROM {src}"
        for f in features)


def numeric_ctes(p, src, features, y, w, keys=(), max_bins=8, frac=0.05):
    """CTEs ending in ``{p}_num`` (keys, feature, bin_no, lo, hi, is_missing, n, bad)."""
    ks = "".join(f"{k}, " for k in keys)
    by = f"{ks}feature"
    using = f"USING ({by})"
    probs = [k * (1.0 / (3 * max_bins)) for k in range(1, 3 * max_bins)]

    def fuse(lst, add):
        first = f"{lst}[1:k - 1]"
        if add:
            return f"list_concat({first}, list_concat([{lst}[k] + {lst}[k + 1]], {lst}[k + 2:]))"
        return f"list_concat({first}, {lst}[k + 1:])"

    return [
        f"{p}_long AS MATERIALIZED ({long_rows(src, features, y, w, keys)})",
        f"""{p}_cuts AS MATERIALIZED (SELECT {by}, list_sort(list_distinct({quants('v', doubles(probs))})) AS cuts FROM (
          SELECT {by}, list(value ORDER BY value) AS v FROM {p}_long WHERE value IS NOT NULL GROUP BY {by}))""",
        f"""{p}_tot AS (SELECT {by}, sum(w) AS all_w FROM {p}_long GROUP BY {by})""",
        f"""{p}_pre AS MATERIALIZED (SELECT {by}, bin_no, sum(w) AS sw, sum(wy) AS swy FROM (
          SELECT {by}, w, wy, CASE WHEN value IS NULL THEN -1 ELSE {above('value', 'cuts')} END AS bin_no
          FROM {p}_long LEFT JOIN {p}_cuts {using}) GROUP BY {by}, bin_no)""",
        f"""{p}_slot AS (SELECT {by}, cuts, unnest(range(0, len(cuts) + 1)) AS bin_no FROM {p}_cuts)""",
        f"""{p}_init AS MATERIALIZED (SELECT {by}, list_append(any_value(cuts), CAST('inf' AS DOUBLE)) AS tops,
          list(coalesce(sw, 0.0) ORDER BY bin_no) AS n, list(coalesce(swy, 0.0) ORDER BY bin_no) AS b
          FROM {p}_slot LEFT JOIN {p}_pre USING ({by}, bin_no) GROUP BY {by})""",
        f"""{p}_lad AS (
          SELECT {by}, tops, n, b, 1 AS phase, CAST(0 AS DOUBLE) AS dir, all_w, 0 AS it
          FROM {p}_init JOIN {p}_tot {using}
          UNION ALL
          SELECT {by}, CASE WHEN k IS NULL THEN tops ELSE {fuse('tops', False)} END,
            CASE WHEN k IS NULL THEN n ELSE {fuse('n', True)} END,
            CASE WHEN k IS NULL THEN b ELSE {fuse('b', True)} END,
            CASE WHEN k IS NULL THEN phase + 1 ELSE phase END,
            CASE WHEN k IS NULL AND phase = 1 THEN trend ELSE dir END, all_w, it + 1
          FROM (SELECT *, CASE
              WHEN phase = 1 AND len(n) > 2 AND list_min(sh) < {frac} THEN
                CASE WHEN i = len(n) OR (i > 1 AND sh[i - 1] <= sh[i + 1]) THEN i - 1 ELSE i END
              WHEN phase = 2 AND len(n) > 2 AND dir <> 0 AND list_min(moves) < 0 THEN list_position(moves, list_min(moves))
              WHEN phase = 3 AND len(n) > {max_bins} THEN list_position(pairs, list_min(pairs)) END AS k
            FROM (SELECT *, list_position(sh, list_min(sh)) AS i,
                [round((rates[j + 1] - rates[j]) * dir, 9) for j in range(1, len(n))] AS moves,
                [round(sh[j] + sh[j + 1], 9) for j in range(1, len(n))] AS pairs,
                CASE WHEN len(n) < 3 THEN 0 ELSE sign(round(list_sum([(j - (len(n) + 1) / 2.0) * rates[j] for j in range(1, len(n) + 1)]), 9)) END AS trend
              FROM (SELECT *, [b[j] / greatest(n[j], 1e-12) for j in range(1, len(n) + 1)] AS rates,
                [round(n[j] / all_w, 9) for j in range(1, len(n) + 1)] AS sh FROM {p}_lad WHERE phase < 4))))""",
        f"""{p}_done AS MATERIALIZED (SELECT * FROM {p}_lad WHERE phase = 4)""",
        f"""{p}_num AS MATERIALIZED (
          SELECT {by}, j - 1 AS bin_no, CASE WHEN j > 1 THEN tops[j - 1] END AS lo,
            CASE WHEN isinf(tops[j]) THEN NULL ELSE tops[j] END AS hi, false AS is_missing, n[j] AS n, b[j] AS bad
          FROM (SELECT *, unnest(range(1, len(tops) + 1)) AS j FROM {p}_done)
          UNION ALL
          SELECT {by}, coalesce(len(tops), 0), NULL, NULL, true, sw, swy
          FROM {p}_pre LEFT JOIN {p}_done {using} WHERE bin_no = -1)""",
    ]


def category_ctes(p, src, feature, y, w, keys=(), rare=0.01):
    ks = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return [
        f"""{p}_lv AS (SELECT {ks}coalesce({feature}, '__MISSING__') AS lv, CAST(sum({w}) AS DOUBLE) AS sw,
          CAST(sum({w} * {y}) AS DOUBLE) AS swy FROM {src} GROUP BY {ks}lv)""",
        f"""{p}_pool AS (SELECT {ks}level, sum(sw) AS n, sum(swy) AS bad FROM (SELECT {ks}sw, swy,
          CASE WHEN sw / sum(sw) OVER ({part}) < {rare} THEN '__OTHER__' ELSE lv END AS level FROM {p}_lv)
          GROUP BY {ks}level)""",
        f"""{p}_cat AS MATERIALIZED (SELECT {ks}'{feature}' AS feature,
          row_number() OVER ({part} ORDER BY level) - 1 AS bin_no, level AS category, n, bad FROM {p}_pool)""",
    ]


def bin_ctes(p, src, numeric, categorical, y="bad", w="1.0", keys=()):
    """CTEs ending in ``{p}_bins`` with WOE and IV."""
    ks = "".join(f"{k}, " for k in keys)
    out, parts = [], []
    if numeric:
        out += numeric_ctes(p, src, numeric, y, w, keys)
        parts.append(f"""SELECT {ks}feature, 'numeric' AS kind, bin_no, lo, hi, CAST(NULL AS VARCHAR) AS category,
          is_missing, n, bad FROM {p}_num""")
    for c in categorical:
        out += category_ctes(p, src, c, y, w, keys)
        parts.append(f"""SELECT {ks}feature, 'categorical', bin_no, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), category,
          false, n, bad FROM {p}_cat""" if parts else f"""SELECT {ks}feature, 'categorical' AS kind, bin_no,
          CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, category, false AS is_missing, n, bad FROM {p}_cat""")
    part = f"PARTITION BY {ks}feature"
    out.append(f"""{p}_bins AS MATERIALIZED (SELECT *, (pg - pb) * woe AS iv FROM (SELECT *, ln(pg / pb) AS woe FROM (
      SELECT *, n - bad AS good, bad / greatest(n, 1e-12) AS bad_rate, (bad + 0.5) / sum(bad + 0.5) OVER ({part}) AS pb,
      (n - bad + 0.5) / sum(n - bad + 0.5) OVER ({part}) AS pg FROM ({' UNION ALL '.join(parts)}))))""")
    return out


def code_cte(name, src, p, numeric, categorical, keys=()):
    """CTE ``name``: rows of ``src`` with x1..xk, the WOE of each feature."""
    joins, cols = [], []
    match = "".join(f" AND {{a}}.{k} = s.{k}" for k in keys)
    for i, f in enumerate(numeric, 1):
        a = f"b{i}"
        joins.append(f"""LEFT JOIN {p}_bins {a} ON {a}.feature = '{f}'{match.format(a=a)} AND
          CASE WHEN s.{f} IS NULL THEN {a}.is_missing ELSE NOT {a}.is_missing
          AND ({a}.lo IS NULL OR s.{f} > {a}.lo) AND ({a}.hi IS NULL OR s.{f} <= {a}.hi) END""")
        cols.append(f"coalesce({a}.woe, 0) AS x{i}")
    for i, f in enumerate(categorical, len(numeric) + 1):
        a, o = f"b{i}", f"o{i}"
        joins.append(f"""LEFT JOIN {p}_bins {a} ON {a}.feature = '{f}'{match.format(a=a)}
          AND {a}.category = coalesce(s.{f}, '__MISSING__')""")
        joins.append(f"LEFT JOIN {p}_bins {o} ON {o}.feature = '{f}'{match.format(a=o)} AND {o}.category = '__OTHER__'")
        cols.append(f"coalesce({a}.woe, {o}.woe, 0) AS x{i}")
    return f"{name} AS MATERIALIZED (SELECT s.*, {', '.join(cols)} FROM {src} s {' '.join(joins)})"


def logit_ctes(p, code, k, y="bad", w="1.0", keys=(), rounds=14):
    """CTEs ending in ``{p}_beta`` (keys, b0..bk): penalised Newton by recursion.

    Each round sums the normal equations over the cells and eliminates them.
    """
    ks = "".join(f"{c}, " for c in keys)
    xs = [f"x{i}" for i in range(1, k + 1)]
    bs = [f"b{i}" for i in range(k + 1)]
    full = ["1"] + xs
    eta = " + ".join(["b0"] + [f"b{i} * x{i}" for i in range(1, k + 1)])
    sums = [f"sum((swy - sw * p) * {full[i]}){'' if i == 0 else f' - any_value(b{i})'} AS r{i}" for i in range(k + 1)]
    sums += [f"sum(sw * p * (1 - p) * {full[i]} * {full[j]}){' + 1' if i == j and i else ''} AS a{i}_{j}"
             for i in range(k + 1) for j in range(i, k + 1)]
    group = "".join(f"{c}, " for c in keys) + "it, " + ", ".join(bs)
    join = f"JOIN {p}_cells USING ({', '.join(keys)})" if keys else f", {p}_cells"
    sql = f"""SELECT {group}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {p}_nb {join}
      WHERE it < {rounds}) GROUP BY {group}"""
    keep = [*keys, "it", *bs]
    for q in range(k):
        cols = list(keep)
        for i in range(q + 1):
            cols += [f"r{i}"] + [f"a{i}_{j}" for j in range(i, k + 1)]
        for i in range(q + 1, k + 1):
            cols.append(f"r{i} - a{q}_{i} * r{q} / a{q}_{q} AS r{i}")
            cols += [f"a{i}_{j} - a{q}_{i} * a{q}_{j} / a{q}_{q} AS a{i}_{j}" for j in range(i, k + 1)]
        sql = f"SELECT {', '.join(cols)} FROM ({sql})"
    for i in range(k, -1, -1):
        known = "".join(f" - a{i}_{j} * d{j}" for j in range(i + 1, k + 1))
        sql = f"SELECT *, (r{i}{known}) / a{i}_{i} AS d{i} FROM ({sql})"
    start = (f"SELECT DISTINCT {ks}0 AS it, " if keys else "SELECT 0 AS it, ") + ", ".join(
        f"CAST(0 AS DOUBLE) AS {b}" for b in bs) + (f" FROM {p}_cells" if keys else "")
    step = f"SELECT {ks}it + 1, {', '.join(f'b{i} + d{i}' for i in range(k + 1))} FROM ({sql})"
    return [
        f"""{p}_cells AS MATERIALIZED (SELECT {ks}{', '.join(xs)}, CAST(sum({w}) AS DOUBLE) AS sw,
          CAST(sum({w} * {y}) AS DOUBLE) AS swy FROM {code} GROUP BY {ks}{', '.join(xs)})""",
        f"{p}_nb AS ({start} UNION ALL {step})",
        f"{p}_beta AS MATERIALIZED (SELECT * FROM {p}_nb WHERE it = {rounds})",
    ]


def eta(k):
    return "(" + " + ".join(["b0"] + [f"b{i} * x{i}" for i in range(1, k + 1)]) + ")"


def logistic(k):
    """P(bad) of a coded row, to twelve places."""
    return f"round(1 / (1 + exp(-{eta(k)})) * CAST('1e12' AS DOUBLE)) / CAST('1e12' AS DOUBLE)"


def card_ctes(p, src, numeric, categorical, y="bad", w="1.0", keys=()):
    """Everything of one scorecard: bins, coded training rows, coefficients."""
    k = len(numeric) + len(categorical)
    return (bin_ctes(p, src, numeric, categorical, y, w, keys)
            + [code_cte(f"{p}_train", src, p, numeric, categorical, keys)]
            + logit_ctes(p, f"{p}_train", k, y, w, keys))


def score_cte(name, src, p, numeric, categorical, keys=(), out="pd"):
    k = len(numeric) + len(categorical)
    coded = code_cte(f"{name}_x", src, p, numeric, categorical, keys)
    join = f"JOIN {p}_beta USING ({', '.join(keys)})" if keys else f", {p}_beta"
    drop = ", ".join([f"x{i}" for i in range(1, k + 1)] + [f"b{i}" for i in range(k + 1)] + ["it"])
    return [coded, f"""{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {eta(k)} AS {out}_eta,
      {logistic(k)} AS {out} FROM {name}_x {join})"""]


CATS = ["state"]
PRE = numeric_ctes("a", "term", NUMERIC, "bad", "1.0")
oracle("woe_prebins", "SELECT feature, CAST(bin_no AS BIGINT) AS bin_no, round(sw, 6) AS sw, round(swy, 6) AS swy FROM a_pre", PRE)
oracle("woe_numeric", f"SELECT feature, CAST(bin_no AS BIGINT) AS bin_no, {r('lo')}, {r('hi')}, is_missing, {r('n')}, {r('bad')} FROM a_num", PRE)
oracle("woe_iv", f"SELECT feature, CAST(bin_no AS BIGINT) AS bin_no, {r('bad_rate')}, {r('woe')}, {r('iv')} FROM a_bins",
       bin_ctes("a", "term", NUMERIC, []))
oracle("woe_categorical", f"""SELECT feature, category AS label, {', '.join(r(c) for c in ('n', 'bad', 'good', 'bad_rate', 'woe', 'iv'))}
  FROM a_bins""", [c.replace("< 0.01 THEN", "< 0.035 THEN") for c in bin_ctes("a", "term", [], CATS)])

TRAIN = f"train AS MATERIALIZED (SELECT * FROM term WHERE NOT ({TEST}))"
CARD = [TRAIN] + card_ctes("a", "train", NUMERIC, CATS)
oracle("bin_table", f"""SELECT feature, kind, CAST(bin_no AS BIGINT) AS bin_no, {r('lo')}, {r('hi')}, category, is_missing,
  {', '.join(r(c) for c in ('n', 'bad', 'good', 'bad_rate', 'woe', 'iv'))} FROM a_bins""", [TRAIN] + bin_ctes("a", "train", NUMERIC, CATS))
oracle("iv_table", "SELECT feature, round(sum(iv), 6) AS iv, count(*) AS n_bins FROM a_bins GROUP BY feature",
       [TRAIN] + bin_ctes("a", "train", NUMERIC, CATS))
oracle("woe_transform", f"SELECT app_id, {', '.join(f'round(x{i}, 6) AS {f}__woe' for i, f in enumerate(FEATURES, 1))} FROM coded",
       [TRAIN] + bin_ctes("a", "train", NUMERIC, CATS), code_cte("coded", "stacked", "a", NUMERIC, CATS))


def terms(p, features):
    return " UNION ALL ".join(f"SELECT '{t}' AS term, round(b{i}, 6) AS coef FROM {p}_beta"
                              for i, t in enumerate(["intercept", *features]))


oracle("scorecard_fit", terms("a", FEATURES), CARD)
oracle("logit_1var", terms("a", CATS), card_ctes("a", "term", [], CATS))
oracle("score_pd", "SELECT app_id, round(pd, 6) AS pd, round(pd_eta, 6) AS log_odds FROM scored",
       CARD, score_cte("scored", "stacked", "a", NUMERIC, CATS))
oracle("points_scale", """SELECT app_id, round(600 - 20 / ln(2) * ln(50) - 20 / ln(2) * ln(pd / (1 - pd)), 6) AS points FROM pacc""", PROXIES)
_COEF = " ".join(f"WHEN '{f}' THEN b{i}" for i, f in enumerate(FEATURES, 1))
oracle("points_table", f"""SELECT feature, CAST(bin_no AS BIGINT) AS bin_no, {r('n')}, {r('bad_rate')}, {r('woe')}, round(coef, 6) AS coef,
  round((600 - 20 / ln(2) * ln(50)) / 5 + 20 / ln(2) * (-b0 / 5 - coef * woe), 6) AS points
  FROM (SELECT *, CASE feature {_COEF} END AS coef FROM a_bins, a_beta)""", CARD)
oracle("coef_table", f"""SELECT feature, round(any_value(CASE feature {_COEF} END), 6) AS coef, round(sum(iv), 6) AS iv
  FROM a_bins, a_beta GROUP BY feature""", CARD)
SPLIT = f"splitted AS MATERIALIZED (SELECT *, {TEST} AS is_test FROM term)"
oracle("evaluate_split", """SELECT is_test, round(bad_rate, 6) AS bad_rate, n, n AS n_used, round(auc, 6) AS auc, round(gini, 6) AS gini,
  round(ks, 6) AS ks FROM z JOIN (SELECT is_test, avg(bad) AS bad_rate, count(*) AS n FROM scored GROUP BY is_test) USING (is_test)""",
       CARD, SPLIT, score_cte("scored", "splitted", "a", NUMERIC, CATS), areas("z", "scored", ["is_test"], "pd", "bad", "1 - bad"))

# --- reject inference -------------------------------------------------------------------------
SCORED = CARD + score_cte("scored", "stacked", "a", NUMERIC, CATS) + [
    """sides AS MATERIALIZED (SELECT sum(design_w) FILTER (accepted = 1) AS wa, sum(design_w) FILTER (accepted = 0) AS wr,
      avg(bad) FILTER (accepted = 1) AS obs FROM scored)"""]
TENTHS = doubles([k * (1.0 / 10) for k in range(1, 10)])
BANDS = [
    f"edges AS MATERIALIZED (SELECT list_sort(list_distinct({quants('v', TENTHS)})) AS e FROM (SELECT list(pd ORDER BY pd) AS v FROM scored WHERE accepted = 1))",
    f"""bands AS MATERIALIZED (SELECT band, n, CASE WHEN n >= 50 THEN own ELSE obs END AS band_rate FROM (
      SELECT {above('pd', 'e')} AS band, count(*) AS n, avg(bad) AS own FROM scored, edges WHERE accepted = 1 GROUP BY band), sides)""",
]
PARCELLED = [f"""drawn_bad AS MATERIALIZED (SELECT *, CASE WHEN {u('app_id', repr(f'parcel:{SEED}'))} < least(1.0, 2.0 * coalesce(band_rate, obs))
  THEN 1.0 ELSE 0.0 END AS y FROM (SELECT s.*, {above('pd', 'e')} AS band, obs FROM scored s, edges, sides WHERE accepted = 0)
  LEFT JOIN (SELECT band, band_rate FROM bands) USING (band))"""]
oracle("parcel_bands", "SELECT band, n, round(band_rate, 6) AS band_rate FROM bands", SCORED, BANDS)
ROWCOLS = ", ".join(FEATURES)
PROPENSITY = [
    *card_ctes("q", "scored", NUMERIC, CATS, "accepted", "design_w"),
    *score_cte("approved", "(SELECT * EXCLUDE (pd, pd_eta) FROM scored)", "q", NUMERIC, CATS),
    "capped AS MATERIALIZED (SELECT *, greatest(1e-4, least(1.0, pd)) AS p FROM approved WHERE accepted = 1)",
    "cap AS MATERIALIZED (SELECT quantile_cont(1 / p, CAST(0.99 AS DOUBLE)) AS cap FROM capped)",
    f"view_ipw AS MATERIALIZED (SELECT {ROWCOLS}, bad, least(1 / p, cap) * design_w AS w, p, 1 / p > cap AS hit FROM capped, cap)",
    f"qs AS (SELECT {logistic(5)} AS sc, swy AS tp, sw - swy AS fp FROM q_cells, q_beta)", *areas("za", "qs", [], "sc", "tp", "fp"),
    """istats AS MATERIALIZED (SELECT sum(bad * w) / sum(w) AS ttd, avg(p) AS mean_p, min(p) AS min_p,
      avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hits, sum(w) * sum(w) / sum(w * w) / count(*) AS ess FROM view_ipw)""",
]
OWN = {  # what each method adds to the scored rows: a labelled view, and its estimates
    "parcelling": BANDS + PARCELLED + [f"""view_parcelling AS MATERIALIZED (SELECT {ROWCOLS}, bad, design_w AS w FROM scored WHERE accepted = 1
      UNION ALL SELECT {ROWCOLS}, y, design_w FROM drawn_bad)"""],
    "fuzzy": [f"""view_fuzzy AS MATERIALIZED (SELECT * FROM (SELECT {ROWCOLS}, bad, design_w AS w FROM scored WHERE accepted = 1
      UNION ALL SELECT {ROWCOLS}, 1.0, design_w * least(1.0, 2.0 * pd) FROM scored WHERE accepted = 0
      UNION ALL SELECT {ROWCOLS}, 0.0, design_w * (1 - least(1.0, 2.0 * pd)) FROM scored WHERE accepted = 0) WHERE w > 1e-9)"""],
    "ipw": PROPENSITY,
}
TTD = "(wa * obs + wr * rej) / (wa + wr)"
EST = {
    "parcelling": f"SELECT rej, {TTD} AS ttd FROM sides, (SELECT avg(y) AS rej FROM drawn_bad)",
    "fuzzy": f"SELECT rej, {TTD} AS ttd FROM sides, (SELECT avg(least(1.0, 2.0 * pd)) AS rej FROM scored WHERE accepted = 0)",
    "ipw": """SELECT greatest(0, least(1, (ttd - wa / (wa + wr) * obs) / greatest(1 - wa / (wa + wr), 1e-9))) AS rej, ttd
      FROM sides, istats""",
}


def refit(m):
    return OWN[m] + card_ctes(f"v{m}", f"view_{m}", NUMERIC, CATS, "bad", "w") + [
        f"s{m} AS MATERIALIZED (SELECT {logistic(5)} AS sc, swy AS tp, sw - swy AS fp FROM v{m}_cells, v{m}_beta)",
        *areas(f"z{m}", f"s{m}", [], "sc", "tp", "fp"), f"e{m} AS MATERIALIZED ({EST[m]})"]


def estimate(m, extra="", more=""):
    return f"""SELECT '{m}' AS method, round(rej, 6) AS est_reject_bad_rate, round(e{m}.ttd, 6) AS est_ttd_bad_rate,
      round(obs, 6) AS accepted_bad_rate, round(z{m}.gini, 6) AS claimed_gini, round(z{m}.ks, 6) AS claimed_ks{extra}
      FROM sides, e{m}, z{m}{more}"""


oracle("parcelling", estimate("parcelling", ", CAST(len(e) + 1 AS BIGINT) AS n_bands", ", edges"), SCORED, refit("parcelling"))
oracle("fuzzy_augment", estimate(
    "fuzzy", ", round(raw, 6) AS mean_raw_pd_rejects, round(clipped, 6) AS frac_pd_clipped_at_1",
    ", (SELECT avg(pd) AS raw, avg(CASE WHEN 2 * pd > 1 THEN 1.0 ELSE 0.0 END) AS clipped FROM scored WHERE accepted = 0)"),
       SCORED, refit("fuzzy"))
oracle("fuzzy_rows", "SELECT state, bad, count(*) AS n, round(sum(w), 6) AS w FROM view_fuzzy GROUP BY state, bad", SCORED, OWN["fuzzy"])
oracle("ipw", estimate("ipw", """, round(mean_p, 6) AS mean_propensity_accepted, round(min_p, 6) AS min_propensity_accepted,
  round(hits, 6) AS frac_weights_capped, round(ess, 6) AS ess_ratio, round(za.auc, 6) AS propensity_auc""", ", istats, za"),
       SCORED, refit("ipw"))
oracle("positivity", """SELECT round(auc, 6) AS propensity_auc, round(min_p, 6) AS min_propensity_accepted, round(ess, 6) AS ess_ratio,
  round(hits, 6) AS frac_weights_capped FROM istats, za""", SCORED, PROPENSITY)
oracle("ipw_weights", """SELECT app_id, round(1 / p, 6) AS raw_w, round(cap, 6) AS cap, round(least(1 / p, cap), 6) AS weight FROM pw,
  (SELECT quantile_cont(1 / p, CAST(0.99 AS DOUBLE)) AS cap FROM pw)""", PROXIES,
       "pw AS MATERIALIZED (SELECT app_id, greatest(1e-4, least(1.0, 1 - pd)) AS p FROM pacc)")


# --- normal probabilities ---------------------------------------------------------------------
def _horner(coefs, a):
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {a} + {c!r})"
    return out


def cdf(x):
    a = f"abs({x})"
    frac = f"({a} + 0.65)"
    for k in (6, 5, 4, 3, 2, 1):
        frac = f"({a} + {k} / {frac})"
    body = (f"exp(-{a} * {a} / 2) * (CASE WHEN {a} < {normal.CDF_SWITCH!r} THEN {_horner(normal.CDF_NUMERATOR, a)}"
            f" / {_horner(normal.CDF_DENOMINATOR, a)} ELSE 1 / {frac} / {normal.ROOT_2PI!r} END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {body} ELSE {body} END)"


_GL = "[" + ", ".join(f"{{'x': {float(x)!r}, 'w': {float(w)!r}}}" for x, w in zip(normal.NODES, normal.NODE_WEIGHTS)) + "]"


def cdf2(h, k, rho):
    t = f"(0.5 * {rho} * (g.x + 1))"
    body = (f"g.w * 0.5 * {rho} * exp(-({h} * {h} - 2 * {t} * {h} * {k} + {k} * {k}) / (2 * (1 - {t} * {t}))) / sqrt(1 - {t} * {t})")
    area = f"list_sum([{body} for g in {_GL}])"
    return f"greatest(1e-12, least(1.0, {cdf(h)} * {cdf(k)} + {area} / (2 * pi())))"


oracle("selection_llk", f"""SELECT CAST(accepted AS BIGINT) AS accepted, round(sum(design_w * CASE WHEN accepted = 1
  THEN ln({cdf2('h', '(q * v)', '(q * 0.3)')}) ELSE ln(greatest(1e-12, {cdf('(-h)')})) END), 4) AS loglik,
  round(sum(design_w), 4) AS weight FROM (SELECT accepted, design_w, 2 * coalesce(bad, 0) - 1 AS q,
  0.4 + 0.9 * x - 0.3 * y AS h, -1.1 - 0.6 * x + 0.2 * y AS v FROM (SELECT *, (risk_score - 650) / 100.0 AS x,
  coalesce(dti, 40) / 50.0 AS y FROM stacked)) GROUP BY accepted""")

# --- selection model ----------------------------------------------------------------------------
PROBIT_ROUNDS, FULL_ROUNDS = 12, 14


def selection_ctes(p, extra=()):
    """Newton for the probit with selection: first rho = 0, then all parameters.

    Ends in ``{p}_fit`` (parameters, log-likelihoods, variance of atanh rho)
    and ``{p}_view`` (score, bads, goods).
    """
    z_num = [*NUMERIC, *extra]
    kz, kx = len(z_num) + 1, len(FEATURES)
    last = kz + 1 + kx + 1  # index of atanh rho
    src = f"""{p}_src AS MATERIALIZED (SELECT * EXCLUDE (accepted), accepted, design_w * ((SELECT count(*) FROM stacked)
      / (SELECT sum(design_w) FROM stacked)) AS unit_w FROM stacked)"""
    bins = bin_ctes(f"{p}z", f"{p}_src", z_num, CATS, "accepted", "unit_w") + bin_ctes(f"{p}x", "term", NUMERIC, CATS)
    zs, xs = [f"z{i}" for i in range(1, kz + 1)], [f"x{i}" for i in range(1, kx + 1)]
    rename = ", ".join(f"x{i} AS z{i}" for i in range(1, kz + 1))
    drop = ", ".join(f"x{i}" for i in range(1, kz + 1))
    coded = [
        code_cte(f"{p}_z0", f"{p}_src", f"{p}z", z_num, CATS),
        f"{p}_z AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {rename} FROM {p}_z0)",
        code_cte(f"{p}_zx", f"{p}_z", f"{p}x", NUMERIC, CATS),
        f"""{p}_cell AS MATERIALIZED (SELECT {', '.join(zs + xs)}, accepted AS s, coalesce(bad, 0) AS y, sum(unit_w) AS w,
          sum(design_w) AS dw, count(*) AS n FROM {p}_zx GROUP BY ALL)""",
    ]
    t = [f"t{i}" for i in range(last + 1)]
    h = " + ".join(["t0"] + [f"t{i} * z{i}" for i in range(1, kz + 1)])
    v = " + ".join([f"t{kz + 1}"] + [f"t{kz + 1 + i} * x{i}" for i in range(1, kx + 1)])
    names = ["1", *zs, "1", *xs]  # design value of each coefficient
    one = f"SELECT *, {h} AS h, {v} AS v, tanh(t{last}) AS rho FROM {p}_nb, {p}_cell WHERE it < {PROBIT_ROUNDS + FULL_ROUNDS}"
    two = f"SELECT *, 2 * y - 1 AS q, 1 - rho * rho AS gone, -h AS mh FROM ({one})"
    three = f"SELECT *, q * v AS k, q * rho AS r FROM ({two})"
    four = f"SELECT *, (k - r * h) / sqrt(gone) AS u1, (h - r * k) / sqrt(gone) AS u2 FROM ({three})"
    five = f"""SELECT *, CASE WHEN s = 1 THEN {cdf2('h', 'k', 'r')} ELSE greatest(1e-12, {cdf('mh')}) END AS L FROM ({four})"""
    pdf = "exp(-{x} * {x} / 2) / " + repr(normal.ROOT_2PI)
    six = f"""SELECT *, CASE WHEN s = 1 THEN {pdf.format(x='h')} * {cdf('u1')} / L ELSE -{pdf.format(x='h')} / L END AS lh,
      CASE WHEN s = 1 THEN {pdf.format(x='k')} * {cdf('u2')} / L ELSE 0 END AS lk,
      CASE WHEN s = 1 THEN exp(-(h * h - 2 * r * h * k + k * k) / (2 * gone)) / (2 * pi() * sqrt(gone)) / L ELSE 0 END AS lr FROM ({five})"""
    seven = f"""SELECT *, lh AS gh, q * lk AS gv, q * gone * lr AS ga,
      CASE WHEN s = 1 THEN -h * lh - r * lr - lh * lh ELSE -h * lh - lh * lh END AS hh, q * (lr - lh * lk) AS hv,
      -k * lk - r * lr - lk * lk AS vv, q * gone * (-(h - r * k) / gone * lr - lh * lr) AS ha,
      gone * (-(k - r * h) / gone * lr - lk * lr) AS va,
      gone * gone * (lr * (r / gone + (h * k * (1 + r * r) - r * (h * h + k * k)) / (gone * gone)) - lr * lr)
        - 2 * rho * gone * q * lr AS aa FROM ({six})"""
    full = f"it >= {PROBIT_ROUNDS}"

    def kind(i):
        return "a" if i == last else ("h" if i <= kz else "v")

    sums = [f"sum(w * ln(L)) AS ll"]
    for i in range(last):
        sums.append(f"sum(w * g{kind(i)} * {names[i]}) AS r{i}")
    sums.append(f"CASE WHEN {full} THEN sum(w * ga) ELSE 0 END AS r{last}")
    for i in range(last):
        for j in range(i, last):
            pair = kind(i) + kind(j)
            sums.append(f"-sum(w * {pair} * {names[i]} * {names[j]}) AS a{i}_{j}")
        sums.append(f"CASE WHEN {full} THEN -sum(w * {kind(i)}a * {names[i]}) ELSE 0 END AS a{i}_{last}")
    sums.append(f"CASE WHEN {full} THEN -sum(w * aa) ELSE 1 END AS a{last}_{last}")
    group = "it, " + ", ".join(t)
    sql = f"SELECT {group}, {', '.join(sums)} FROM ({seven}) GROUP BY {group}"
    for c in range(last):
        cols = ["it", *t, "ll"]
        for i in range(c + 1):
            cols += [f"r{i}"] + [f"a{i}_{j}" for j in range(i, last + 1)]
        for i in range(c + 1, last + 1):
            cols.append(f"r{i} - a{c}_{i} * r{c} / a{c}_{c} AS r{i}")
            cols += [f"a{i}_{j} - a{c}_{i} * a{c}_{j} / a{c}_{c} AS a{i}_{j}" for j in range(i, last + 1)]
        sql = f"SELECT {', '.join(cols)} FROM ({sql})"
    for i in range(last, -1, -1):
        known = "".join(f" - a{i}_{j} * d{j}" for j in range(i + 1, last + 1))
        sql = f"SELECT *, (r{i}{known}) / a{i}_{i} AS d{i} FROM ({sql})"
    start = "SELECT 0 AS it, " + ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in t) + ", CAST(0 AS DOUBLE) AS ll, CAST(0 AS DOUBLE) AS var"
    step = f"SELECT it + 1, {', '.join(f't{i} + d{i}' for i in range(last + 1))}, ll, 1 / a{last}_{last} FROM ({sql})"
    end = PROBIT_ROUNDS + FULL_ROUNDS
    fit = [
        f"{p}_nb AS ({start} UNION ALL {step})",
        f"""{p}_fit AS MATERIALIZED (SELECT *, tanh(t{last}) AS rho, t{last} AS alpha, sqrt(greatest(var, 0)) AS se,
          (SELECT ll FROM {p}_nb WHERE it = {PROBIT_ROUNDS + 1}) AS ll0, greatest(0, 2 * (ll - (SELECT ll FROM {p}_nb WHERE it = {PROBIT_ROUNDS + 1}))) AS lr
          FROM {p}_nb WHERE it = {end})""",
        f"""{p}_at AS MATERIALIZED (SELECT *, -h AS mh, -rho AS mr FROM (SELECT {p}_cell.*, {h} AS h, {v} AS v, rho FROM {p}_cell, {p}_fit))""",
        f"""{p}_p AS MATERIALIZED (SELECT *, CASE WHEN s = 1 THEN y ELSE greatest(0, least(1, {cdf2('mh', 'v', 'mr')} / greatest({cdf('mh')}, 1e-9))) END AS b,
          round({cdf('v')} * CAST('1e12' AS DOUBLE)) / CAST('1e12' AS DOUBLE) AS sc FROM {p}_at)""",
        f"{p}_view AS MATERIALIZED (SELECT sc, dw * b AS tp, dw * (1 - b) AS fp FROM {p}_p)",
        f"""{p}_est AS MATERIALIZED (SELECT rej, obs, (wa * obs + wr * rej) / (wa + wr) AS ttd, n, ns FROM (
          SELECT sum(n * b) FILTER (s = 0) / sum(n) FILTER (s = 0) AS rej, sum(n * b) FILTER (s = 1) / sum(n) FILTER (s = 1) AS obs,
          sum(dw) FILTER (s = 1) AS wa, sum(dw) FILTER (s = 0) AS wr, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (s = 1) AS BIGINT) AS ns FROM {p}_p))""",
    ]
    return [src, *bins, *coded, *fit]


def selection_select(p):
    z = f"(-abs(alpha / se))"
    lr_p = f"(2 * {cdf('mlr')})"
    return f"""SELECT *, round({lr_p}, 4) AS lr_p, coalesce({lr_p} < 0.05, false) AS rho_significant_5pct, round(2 * {cdf('mz')}, 4) AS wald_p FROM (
      SELECT round(rho, 4) AS rho, round(alpha, 4) AS atanh_rho, round(se * (1 - rho * rho), 4) AS se_rho, round(tanh(alpha - 1.96 * se), 4) AS rho_lo,
      round(tanh(alpha + 1.96 * se), 4) AS rho_hi, round(alpha / se, 4) AS wald_z, round(lr, 4) AS lr_stat, round(ll, 4) AS loglik,
      round(ll0, 4) AS loglik_restricted, true AS converged, n, ns AS n_selected, -sqrt(lr) AS mlr, {z} AS mz, round(rej, 4) AS est_reject_bad_rate,
      round(ttd, 4) AS est_ttd_bad_rate, round(obs, 4) AS accepted_bad_rate FROM {p}_fit, {p}_est)"""


SELECTION, EXCLUDED = selection_ctes("h"), selection_ctes("w", ("app_year",))
oracle("selection_model", f"SELECT * EXCLUDE (mlr, mz) FROM ({selection_select('h')})", SELECTION)
oracle("selection_exclusion", f"SELECT * EXCLUDE (mlr, mz) FROM ({selection_select('w')})", EXCLUDED)
LABELLED = SCORED + [c for m in OWN for c in refit(m)]
SELECTED = [*SELECTION, *areas("zheckman", "h_view", [], "sc", "tp", "fp")]
_TABLE = " UNION ALL ".join(
    f"SELECT '{m}' AS method, round(rej, 6) AS est_reject_bad_rate, round(e{m}.ttd, 6) AS est_ttd_bad_rate, round(gini, 6) AS claimed_ttd_gini FROM e{m}, z{m}"
    for m in OWN)
oracle("method_table", f"""{_TABLE} UNION ALL SELECT 'heckman', round(rej, 6), round(ttd, 6), round(gini, 6) FROM h_est, zheckman
  UNION ALL SELECT 'heckman_with_exclusion', round(rej, 6), round(ttd, 6), NULL FROM w_est""", LABELLED, SELECTED, EXCLUDED)
REPORTED = ["tested AS (SELECT * FROM scored WHERE accepted = 1 AND " + TEST + ")", *areas("ztest", "tested", [], "pd", "bad", "1 - bad")]
oracle("claimed_gini", " UNION ALL ".join(
    f"""SELECT '{m}' AS method, round(z{m}.gini, 6) AS claimed_gini, round(z{m}.ks, 6) AS claimed_ks,
    round(z{m}.gini - ztest.gini, 6) AS gini_vs_baseline_reported FROM z{m}, ztest""" for m in [*OWN, "heckman"]),
       LABELLED, SELECTED, REPORTED)

# --- policies -----------------------------------------------------------------------------------
def scen(where="true"):
    return f"""scen AS (SELECT *, concat(cutoff_type, '|', printf('%.6f', rejection_rate), '|', replicate) AS scenario FROM (
  SELECT cutoff_type, CAST(rate AS DOUBLE) AS rejection_rate, replicate FROM
  (VALUES ('risk_hard'), ('risk_soft'), ('random')) c(cutoff_type), (VALUES (0.1), (0.3), (0.5), (0.7)) g(rate), reps) WHERE {where})"""


POOL = f"pool AS MATERIALIZED (SELECT *, {EVAL} AS is_eval FROM term, reps)"
RANKED = """ranked AS MATERIALIZED (SELECT p.*, coalesce(risk_score, low - 1) AS sc FROM pool p
  JOIN (SELECT replicate, min(risk_score) AS low FROM pool GROUP BY replicate) USING (replicate))"""
SHAPE = "shape AS MATERIALIZED (SELECT replicate, count(*) AS m, avg(sc) AS mu, stddev_pop(sc) AS sd FROM ranked GROUP BY replicate)"
VALS = "vals AS MATERIALIZED (SELECT replicate, sc, count(*) AS n FROM ranked GROUP BY replicate, sc)"
HARD = f"""hard AS MATERIALIZED (SELECT scenario, thr, CASE WHEN tied > 0 AND rejection_rate * m - below > 0
  THEN least((rejection_rate * m - below) / tied, 1.0) ELSE 0.0 END AS tie_share FROM (
  SELECT scenario, rejection_rate, thr, any_value(m) AS m, sum(CASE WHEN sc < thr THEN n ELSE 0 END) AS below,
  sum(CASE WHEN sc = thr THEN n ELSE 0 END) AS tied FROM (
    SELECT scenario, rejection_rate, replicate, CASE rejection_rate WHEN CAST(0.1 AS DOUBLE) THEN q[1]
      WHEN CAST(0.3 AS DOUBLE) THEN q[2] WHEN CAST(0.5 AS DOUBLE) THEN q[3] ELSE q[4] END AS thr
    FROM (SELECT replicate, {quants('v', doubles([0.1, 0.3, 0.5, 0.7]))} AS q FROM (
      SELECT replicate, list(sc ORDER BY sc) AS v FROM ranked GROUP BY replicate))
    JOIN scen USING (replicate) WHERE cutoff_type = 'risk_hard') JOIN vals USING (replicate) JOIN shape USING (replicate)
  GROUP BY scenario, rejection_rate, thr))"""
SOFT = [
    """bis AS (SELECT scenario, replicate, rejection_rate, CAST(-50 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi, 0 AS it
      FROM scen WHERE cutoff_type = 'risk_soft' UNION ALL
      SELECT scenario, replicate, rejection_rate, CASE WHEN g < 1 - rejection_rate THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN g < 1 - rejection_rate THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM (
        SELECT scenario, replicate, rejection_rate, lo, hi, it, sum(n / (1 + exp(-((lo + hi) / 2 + 2.5 * (sc - mu) / sd)))) / any_value(m) AS g
        FROM bis JOIN vals USING (replicate) JOIN shape USING (replicate) WHERE it < 60
        GROUP BY scenario, replicate, rejection_rate, lo, hi, it))""",
    "soft AS MATERIALIZED (SELECT scenario, (lo + hi) / 2 AS a FROM bis WHERE it = 60)",
]
MASKED = f"""masked AS MATERIALIZED (SELECT r.*, s.scenario, s.cutoff_type, s.rejection_rate, CASE s.cutoff_type
  WHEN 'random' THEN u >= s.rejection_rate WHEN 'risk_hard' THEN NOT (sc < thr OR (sc = thr AND u < tie_share))
  ELSE u < 1 / (1 + exp(-(a + 2.5 * (sc - mu) / sd))) END AS seen
  FROM (SELECT x.*, c.scenario AS sid, {u('app_id', f"concat('mask:{SEED}:', c.scenario)")} AS u FROM ranked x JOIN scen c USING (replicate)) r
  JOIN scen s ON s.scenario = r.sid LEFT JOIN hard h ON h.scenario = s.scenario LEFT JOIN soft f ON f.scenario = s.scenario
  JOIN shape g ON g.replicate = r.replicate)"""
MASK = [REPS, scen(), POOL, RANKED, SHAPE, VALS, HARD, *SOFT, MASKED]
for _kind in ("random", "risk_hard", "risk_soft"):
    oracle({"random": "mask_random", "risk_hard": "mask_hard", "risk_soft": "mask_soft"}[_kind],
           f"""SELECT cutoff_type, rejection_rate, replicate, count(*) AS n, CAST(sum(CASE WHEN seen THEN 0 ELSE 1 END) AS BIGINT) AS n_declined,
  CAST(sum(app_id) FILTER (NOT seen) AS BIGINT) AS declined_ids, round(avg(bad) FILTER (seen), 6) AS accepted_bad_rate
  FROM masked WHERE cutoff_type = '{_kind}' GROUP BY cutoff_type, rejection_rate, replicate""", MASK)
FACTS = ["""allfacts AS MATERIALIZED (SELECT *, CASE WHEN n_accepted < 200 THEN 'too few approved rows'
  WHEN n_rejected < 50 THEN 'too few declined rows' END AS skipped FROM (SELECT scenario, cutoff_type, rejection_rate, replicate, count(*) AS n_pool,
  CAST(count(*) FILTER (NOT is_eval AND seen) AS BIGINT) AS n_accepted, CAST(count(*) FILTER (NOT is_eval AND NOT seen) AS BIGINT) AS n_rejected,
  avg(bad) FILTER (is_eval) AS truth_ttd_bad_rate, avg(bad) FILTER (is_eval AND NOT seen) AS truth_reject_bad_rate,
  avg(bad) FILTER (is_eval AND seen) AS truth_accepted_bad_rate FROM masked GROUP BY ALL))""",
         "facts AS MATERIALIZED (SELECT * EXCLUDE (skipped) FROM allfacts WHERE skipped IS NULL)"]
oracle("backtest_truth", f"""SELECT cutoff_type, rejection_rate, replicate, n_pool, n_accepted, n_rejected, {r('truth_ttd_bad_rate')},
  {r('truth_reject_bad_rate')}, {r('truth_accepted_bad_rate')},
  round(CAST(n_rejected AS DOUBLE) / nullif(n_accepted + n_rejected, 0), 6) AS realised_rejection_rate, skipped FROM allfacts""", MASK, FACTS)

# --- economics ----------------------------------------------------------------------------------------
oracle("loan_returns", "SELECT app_id, round(net, 6) AS net, round(lgd, 6) AS lgd FROM pcal", PROXIES)
DRAG = "(0.03 + 0.01) * 0.55 * {t} / 12"
YIELDS = [
    f"yedges AS MATERIALIZED (SELECT list_sort(list_distinct({quants('v', TENTHS)})) AS e FROM (SELECT list(pd_baseline ORDER BY pd_baseline) AS v FROM pcal))",
    f"""yb AS MATERIALIZED (SELECT *, CASE WHEN good_yield > bad_yield THEN (good_yield - {DRAG.format(t='mean_term')}) / (good_yield - bad_yield) END
      AS breakeven_bad_rate FROM (SELECT {above('pd_baseline', 'e')} AS band, count(*) AS n, avg(bad) AS bad_rate,
      avg(net) FILTER (bad = 0) AS good_yield, avg(net) FILTER (bad = 1) AS bad_yield,
      avg(greatest(0, least(1, lgd))) FILTER (bad = 1 AND lgd IS NOT NULL) AS lgd, avg(int_rate) AS mean_int_rate,
      avg(term_months) AS mean_term FROM pcal, yedges GROUP BY band))""",
    """yp AS MATERIALIZED (SELECT avg(net) FILTER (bad = 0) AS gy0, avg(net) FILTER (bad = 1) AS by0,
      coalesce(avg(greatest(0, least(1, lgd))) FILTER (bad = 1 AND lgd IS NOT NULL), 0.8) AS lgd0,
      CAST(count(*) FILTER (bad = 0) AS BIGINT) AS n_good, CAST(count(*) FILTER (bad = 1) AS BIGINT) AS n_bad FROM pcal)""",
]
# the bands of the applicants themselves, from one method's rows
OWN_BANDS = f"""aedges AS MATERIALIZED (SELECT list_sort(list_distinct({quants('v', TENTHS)})) AS e FROM (
  SELECT list(pd_baseline ORDER BY pd_baseline) AS v FROM papp WHERE method = (SELECT min(method) FROM papp)))"""
oracle("yields_by_band", f"""SELECT band, n, {', '.join(r(c) for c in ('bad_rate', 'good_yield', 'bad_yield', 'lgd', 'mean_int_rate', 'mean_term', 'breakeven_bad_rate'))} FROM yb""",
       PROXIES, YIELDS)


def even(t, funds="0.03"):
    return f"(gy0 - ({funds} + 0.01) * 0.55 * {t} / 12) / (gy0 - by0)"


EVEN = f"""round({even(36)}, 6) AS breakeven_bad_rate_36m, round({even(60)}, 6) AS breakeven_bad_rate_60m"""
oracle("breakeven", f"SELECT round(gy0, 6) AS good_yield, round(by0, 6) AS bad_yield, round(lgd0, 6) AS lgd, n_good, n_bad, {EVEN} FROM yp",
       PROXIES, YIELDS)


def valued(name, src, amount, funds="0.03"):
    return f"""{name} AS MATERIALIZED (SELECT s.*, breakeven_bad_rate, {amount} * ((1 - pd) * coalesce(good_yield, gy0) + pd * coalesce(bad_yield, by0)
      - ({funds} + 0.01) * 0.55 * coalesce(mean_term, 36) / 12) AS profit FROM {src} s
      LEFT JOIN (SELECT band, good_yield, bad_yield, mean_term, breakeven_bad_rate FROM yb) USING (band), yp)"""


oracle("expected_profit", "SELECT method, app_id, band, round(profit, 4) AS profit FROM val", PROXIES, YIELDS, OWN_BANDS,
       f"""src AS MATERIALIZED (SELECT p.*, {above('pd_baseline', 'e')} AS band, med FROM papp p, aedges,
       (SELECT quantile_cont(amount_requested, 0.5) AS med FROM stacked))""",
       valued("val", "src", "coalesce(amount_requested, med)"))


def moved(edges):
    return [f"""moved AS MATERIALIZED (SELECT s.*, {above('pd_baseline', 'e')} AS band,
  coalesce(amount_requested, quantile_cont(amount_requested, 0.5) OVER (PARTITION BY method, swap)) AS amount
  FROM swapped s, {edges} WHERE swap IN ('in', 'out'))""", valued("val", "moved", "amount"),
            "wval AS MATERIALIZED (SELECT *, profit * design_w AS wp FROM val)"]


MOVED = [OWN_BANDS, *moved("aedges")]


def poisson(u_):
    term, upto, marks = 2.718281828459045**-1, 0.0, []
    for k in range(18):
        term = term / k if k else term
        upto += term
        marks.append(upto)
    return " + ".join(f"CASE WHEN {u_} >= CAST({m!r} AS DOUBLE) THEN 1 ELSE 0 END" for m in marks)


def boot_ctes(src, value, keys, reps):
    lead = "".join(f"{k}, " for k in keys)
    return [
        f"""blk AS MATERIALIZED (SELECT {lead}block, sum({value}) AS x, count(*) AS n FROM (
          SELECT *, CAST(floor({u('app_id', repr(f'block:{SEED}'))} * 8192) AS INT) AS block FROM {src}) GROUP BY {lead}block)""",
        f"""draws AS MATERIALIZED (SELECT block, rep, {poisson('uu')} AS k FROM (SELECT block, rep, {u("concat(block, ':', rep)", repr(f'boot:{SEED}'))} AS uu
          FROM (SELECT DISTINCT block FROM blk), (SELECT unnest(range(1, {reps + 1})) AS rep)))""",
        f"""per AS (SELECT {lead}rep, sum(k * x) AS kx, sum(k * n) AS kn FROM blk JOIN draws USING (block) GROUP BY {lead}rep)""",
        f"""boot AS MATERIALIZED (SELECT {lead}max(total) AS total, quantile_cont(t, {doubles([(1.0 - 0.9) / 2.0])[1:-1]}) AS ci_lo,
          quantile_cont(t, {doubles([1.0 - (1.0 - 0.9) / 2.0])[1:-1]}) AS ci_hi FROM (SELECT {lead}total, coalesce(n * kx / nullif(kn, 0), 0) AS t FROM per
          {'JOIN' if keys else ','} (SELECT {lead}sum(x) AS total, sum(n) AS n FROM blk {f"GROUP BY {', '.join(keys)}" if keys else ''}) tt
          {f"USING ({', '.join(keys)})" if keys else ''}) {f"GROUP BY {', '.join(keys)}" if keys else ''})""",
    ]


oracle("bootstrap_total", "SELECT round(total, 2) AS total, round(ci_lo, 2) AS ci_lo, round(ci_hi, 2) AS ci_hi FROM boot", PROXIES,
       "bsrc AS (SELECT app_id, amount_requested * design_w AS x FROM pcal WHERE amount_requested IS NOT NULL)",
       boot_ctes("bsrc", "x", [], 2000))
CAME = "FILTER (swap = 'in')"
_mean = "round(sum({x} * design_w) FILTER (swap = '{s}' AND {x} IS NOT NULL) / sum(design_w) FILTER (swap = '{s}' AND {x} IS NOT NULL), {n}) AS {a}"
SWAP_FACTS = f"""sf AS MATERIALIZED (SELECT method, CAST(count(*) FILTER (swap = 'in') AS BIGINT) AS n_swap_in_rows,
  CAST(count(*) FILTER (swap = 'out') AS BIGINT) AS n_swap_out_rows, coalesce(sum(design_w) {CAME}, 0) AS sin,
  {_mean.format(x='breakeven_bad_rate', s='in', n=6, a='swap_in_breakeven_bad_rate')},
  {_mean.format(x='pd', s='in', n=6, a='swap_in_inferred_bad_rate')}, {_mean.format(x='amount', s='in', n=4, a='swap_in_mean_amount')},
  {_mean.format(x='profit', s='in', n=4, a='profit_per_swap_in_applicant')},
  round(sum(CASE WHEN profit > 0 THEN design_w ELSE 0 END) {CAME} / sum(design_w) {CAME}, 6) AS frac_swap_in_profitable,
  {_mean.format(x='pd', s='out', n=6, a='swap_out_inferred_bad_rate')},
  round(-sum(wp) FILTER (swap = 'out'), 2) AS profit_avoided_population FROM wval GROUP BY method)"""
SWAP_BODY = f"""SELECT method, round(book, 6) AS book_applicants, round(cr, 6) AS model_vs_actual_decision_corr,
  n_swap_in_rows, n_swap_out_rows, round(sin, 6) AS swap_in_applicants, swap_in_breakeven_bad_rate, swap_in_inferred_bad_rate,
  swap_in_mean_amount, profit_per_swap_in_applicant, frac_swap_in_profitable, swap_out_inferred_bad_rate, profit_avoided_population,
  round(total, 2) AS profit_forgone_population, round(ci_lo, 2) AS profit_forgone_ci_lo, round(ci_hi, 2) AS profit_forgone_ci_hi,
  {EVEN}, round(sin / greatest(book, 1), 6) AS swap_rate FROM sf JOIN boot USING (method) JOIN (SELECT method,
  sum(design_w) FILTER (accepted = 1) AS book, corr(pd, 1.0 - accepted) AS cr FROM papp GROUP BY method) USING (method), yp"""
oracle("swap_economics", SWAP_BODY, PROXIES, swap_cut(), SWAPPED, YIELDS, MOVED, SWAP_FACTS,
       boot_ctes("(SELECT * FROM wval WHERE swap = 'in')", "wp", ["method"], 2000))
SWAP_NO_INTERVAL = SWAP_BODY.replace("round(ci_lo, 2) AS profit_forgone_ci_lo, round(ci_hi, 2) AS profit_forgone_ci_hi,", "")
oracle("swap_economics_calibration_bands", SWAP_NO_INTERVAL, PROXIES, swap_cut(), SWAPPED, YIELDS, moved("yedges"), SWAP_FACTS,
       "boot AS (SELECT method, sum(wp) AS total FROM wval WHERE swap = 'in' GROUP BY method)")
oracle("profit_range", """SELECT round(min(t), 2) AS range_low, round(max(t), 2) AS range_high, bool_and(t > 0) OR bool_and(t < 0) AS all_methods_agree_sign
  FROM (SELECT method, sum(wp) AS t FROM wval WHERE swap = 'in' GROUP BY method)""", PROXIES, swap_cut(), SWAPPED, YIELDS, MOVED)
oracle("funding_sensitivity", f"""SELECT method, cost_of_funds_annual, round(any_value({even(36, 'cost_of_funds_annual')}), 6) AS breakeven_bad_rate_36m,
  round(sum(profit * design_w), 2) AS profit_forgone_population, round(sum(pd * design_w) / sum(design_w), 6) AS swap_in_inferred_bad_rate
  FROM val, yp GROUP BY method, cost_of_funds_annual""", PROXIES, swap_cut(), SWAPPED, YIELDS, OWN_BANDS,
       f"""src AS MATERIALIZED (SELECT s.*, {above('pd_baseline', 'e')} AS band, CAST(f AS DOUBLE) AS cost_of_funds_annual,
       coalesce(amount_requested, quantile_cont(amount_requested, 0.5) OVER (PARTITION BY method)) AS amount
       FROM swapped s, aedges, (VALUES (0.02), (0.03), (0.045)) c(f) WHERE swap = 'in')""",
       valued("val", "src", "amount", "cost_of_funds_annual"))
_GROUP = {"keep": "the book of today", "in": "newly approved", "out": "no longer approved", "decline": "declined before and after"}
_cols = ", ".join(f"round(sum({c} * design_w) FILTER ({c} IS NOT NULL) / sum(design_w) FILTER ({c} IS NOT NULL), 6) AS {c}" for c in NUMERIC)
oracle("swap_profile", " UNION ALL ".join(
    f"""SELECT method, '{name}' AS "group", round(sum(design_w), 6) AS applicants, {_cols} FROM swapped
    WHERE {"accepted = 1" if s == 'keep' else f"swap = '{s}'"} GROUP BY method""" for s, name in _GROUP.items()),
       PROXIES, swap_cut(), SWAPPED)

# --- the same on the fitted scores of the four methods ----------------------------------------------
_CASH = "funded_amnt, total_rec_prncp, total_rec_int, recoveries, int_rate, term_months"
_KEEP = f"app_id, {ROWCOLS}, accepted, bad, design_w, pd_baseline"
_V = " + ".join(["t6"] + [f"t{6 + i} * x{i}" for i in range(1, 6)])
FITTED = [
    f"mb AS MATERIALIZED (SELECT app_id, {ROWCOLS}, accepted, bad, design_w, pd AS pd_baseline FROM scored)",
    *[c for m in OWN for c in score_cte(f"m{m}", "mb", f"v{m}", NUMERIC, CATS)],
    code_cte("mhx", "mb", "hx", NUMERIC, CATS),
    f"mheckman AS MATERIALIZED (SELECT *, round({cdf('sv')} * CAST('1e12' AS DOUBLE)) / CAST('1e12' AS DOUBLE) AS pd FROM (SELECT *, {_V} AS sv FROM mhx, h_fit))",
    "papp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {_KEEP}, '{m}' AS method, pd FROM m{m}" for m in [*OWN, "heckman"]) + ")",
    f"""pcal AS MATERIALIZED (SELECT mb.*, {_CASH}, (total_rec_prncp + total_rec_int + recoveries - nullif(greatest(funded_amnt, 0), 0))
      / nullif(greatest(funded_amnt, 0), 0) AS net, 1 - (total_rec_prncp + recoveries) / nullif(greatest(funded_amnt, 0), 0) AS lgd
      FROM mb JOIN (SELECT app_id, {_CASH} FROM term) USING (app_id))""",
]
oracle("method_economics", SWAP_BODY, LABELLED, SELECTION, FITTED, swap_cut(), SWAPPED, YIELDS, MOVED, SWAP_FACTS,
       boot_ctes("(SELECT * FROM wval WHERE swap = 'in')", "wp", ["method"], 2000))
oracle("method_swap_profile", " UNION ALL ".join(
    f"""SELECT '{name}' AS "group", round(sum(design_w), 6) AS applicants, {_cols} FROM swapped
    WHERE method = 'heckman' AND {"accepted = 1" if s == 'keep' else f"swap = '{s}'"} HAVING count(*) > 0""" for s, name in _GROUP.items()),
       LABELLED, SELECTION, FITTED, swap_cut(), SWAPPED)

# --- regions --------------------------------------------------------------------------------------------
oracle("decline_model", terms("d", NUMERIC), "dsrc AS (SELECT *, 1 - accepted AS y FROM stacked)",
       card_ctes("d", "dsrc", NUMERIC, [], "y", "1.0"))


def residual_cte(src, p):
    return f"""res AS MATERIALIZED (SELECT *, CAST(o AS DOUBLE) / n_apps AS observed_rate, e / n_apps AS expected_rate,
      n_apps < 100 AS small, CASE WHEN n_apps >= 100 THEN 100 * (o / n_apps - e / n_apps) END AS excess_rate_pp,
      CASE WHEN n_apps >= 100 THEN (o - e) / sqrt(greatest(v, 1e-9)) END AS z FROM (
      SELECT zip3, count(*) AS n_apps, CAST(sum(1 - accepted) AS DOUBLE) AS o, sum({p}) AS e, sum({p} * (1 - {p})) AS v
      FROM {src} GROUP BY zip3))"""


RES = residual_cte("stacked", PROXY)
RESCOLS = """zip3, n_apps, round(o, 6) AS observed_declines, round(e, 6) AS expected_declines, round(v, 6) AS var,
  round(observed_rate, 6) AS observed_rate, round(expected_rate, 6) AS expected_rate, round(excess_rate_pp, 6) AS excess_rate_pp,
  round(z, 6) AS z, abs(z) > 3 AS flagged, small"""
oracle("zip_residuals", f"SELECT {RESCOLS} FROM res", RES)
oracle("model_zip_residuals", f"SELECT {RESCOLS} FROM res", "dsrc AS (SELECT *, 1 - accepted AS y FROM stacked)",
       card_ctes("d", "dsrc", NUMERIC, [], "y", "1.0"), score_cte("ds", "stacked", "d", NUMERIC, [], out="p"),
       residual_cte("ds", "p"))
CHI = f"""CASE WHEN j % 2 = 0 THEN list_sum([exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)) for i in range(0, j // 2)])
  ELSE 2 * {cdf('(-sqrt(chi2))')} + CASE WHEN j > 1 THEN list_sum([exp(-chi2 / 2 + (i - 0.5) * ln(chi2 / 2) - lgamma(i + 0.5)) for i in range(1, (j - 1) // 2 + 1)]) ELSE 0 END END"""
oracle("zip_dispersion", f"""SELECT j AS n_zip3, ns AS n_zip3_small, na AS n_apps_small, round(chi2, 6) AS chi2, round(sd, 6) AS sd_of_z, nf AS n_flagged, round(mx, 6) AS max_excess_decline_pp,
  round(mn, 6) AS min_excess_decline_pp, j AS chi2_df, round({CHI}, 6) AS chi2_p, round(chi2 / j, 6) AS dispersion_ratio,
  round(2 * {cdf('(-3.0)')} * j, 6) AS n_flagged_expected_by_chance, round(nf - 2 * {cdf('(-3.0)')} * j, 6) AS excess_flags,
  round(q[2] - q[1], 6) AS iqr_excess_decline_pp FROM (SELECT count(z) AS j, CAST(count_if(small) AS BIGINT) AS ns, CAST(sum(CASE WHEN small THEN n_apps ELSE 0 END) AS BIGINT) AS na, sum(z * z) AS chi2, stddev_pop(z) AS sd,
  CAST(sum(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS nf, max(excess_rate_pp) AS mx, min(excess_rate_pp) AS mn,
  quantile_cont(excess_rate_pp, {doubles([0.25, 0.75])}) AS q FROM res HAVING count(z) > 0)""", RES)
oracle("zip_top_k", """(SELECT 'top' AS "end", zip3, round(z, 6) AS z FROM res WHERE NOT small ORDER BY res.z DESC, zip3 LIMIT 10)
  UNION ALL (SELECT 'bottom', zip3, round(z, 6) FROM res WHERE NOT small ORDER BY res.z, zip3 LIMIT 10)""", RES)
oracle("zip_largest_gaps", """SELECT zip3, round(excess_rate_pp, 6) AS excess_rate_pp FROM res WHERE NOT small ORDER BY abs(res.excess_rate_pp) DESC, zip3 LIMIT 15""", RES)
oracle("z_histogram", """SELECT bin_no, round(lo + bin_no * width, 6) AS left_edge, n, round(n / (sum(n) OVER () * width), 6) AS density FROM (
  SELECT CAST(least(floor((z - lo) / width), 49) AS BIGINT) AS bin_no, count(*) AS n, any_value(lo) AS lo, any_value(width) AS width
  FROM (SELECT z, lo, (hi - lo) / 50 AS width FROM (SELECT z FROM res WHERE NOT small), (SELECT min(z) AS lo, max(z) AS hi FROM res)) GROUP BY 1)""", RES)


# --- keyed backtest (labelling methods) ---------------------------------------------------------------
def backtest_ctes(scenarios: str, replicates: int, scales, with_ipw: bool) -> list:
    """CTEs of the whole backtest, ending in ``est`` and the Gini tables.

    Every fit is keyed by scenario (and by assumed scale and method).
    """
    one, three = ["scenario"], ["scenario", "scale", "method"]
    one_w = "CAST(1 AS DOUBLE)"
    cols = f"scenario, replicate, app_id, {ROWCOLS}, bad"
    scale_rows = ", ".join(f"({x})" for x in scales)
    views = [f"""SELECT scenario, scale, 'parcelling' AS method, {ROWCOLS}, bad, {one_w} AS w FROM scored, scales WHERE seen
        UNION ALL SELECT scenario, scale, 'parcelling', {ROWCOLS}, y, {one_w} FROM drawn_bad""",
             f"""SELECT * FROM (SELECT scenario, scale, 'fuzzy', {ROWCOLS}, bad, {one_w} AS w FROM scored, scales WHERE seen
        UNION ALL SELECT scenario, scale, 'fuzzy', {ROWCOLS}, {one_w}, least({one_w}, scale * pd) FROM scored, scales WHERE NOT seen
        UNION ALL SELECT scenario, scale, 'fuzzy', {ROWCOLS}, CAST(0 AS DOUBLE), 1 - least({one_w}, scale * pd) FROM scored, scales WHERE NOT seen) WHERE w > 1e-9"""]
    est = ["SELECT scenario, scale, 'parcelling' AS method, avg(y) AS rej, CAST(NULL AS DOUBLE) AS ttd0 FROM drawn_bad GROUP BY ALL",
           "SELECT scenario, scale, 'fuzzy', avg(least(1.0, scale * pd)), NULL FROM scored, scales WHERE NOT seen GROUP BY ALL"]
    out = [
        f"reps AS (SELECT unnest(range(0, {replicates})) AS replicate)",
        scen(scenarios),
        POOL, RANKED, SHAPE, VALS, HARD, *SOFT, MASKED, *FACTS,
        "kept AS MATERIALIZED (SELECT * FROM masked SEMI JOIN facts USING (scenario))",
        f"bfit AS MATERIALIZED (SELECT {cols} FROM kept WHERE NOT is_eval AND seen)",
        f"fits AS MATERIALIZED (SELECT {cols}, seen FROM kept WHERE NOT is_eval)",
        f"evs AS MATERIALIZED (SELECT {cols}, seen FROM kept WHERE is_eval)",
        f"scales AS (SELECT CAST(s AS DOUBLE) AS scale FROM (VALUES {scale_rows}) t(s))",
        *card_ctes("a", "bfit", NUMERIC, CATS, keys=one),
        *score_cte("scored", "fits", "a", NUMERIC, CATS, keys=one),
        """sides AS MATERIALIZED (SELECT scenario, CAST(count(*) FILTER (seen) AS DOUBLE) AS wa,
          CAST(count(*) FILTER (NOT seen) AS DOUBLE) AS wr, avg(bad) FILTER (seen) AS obs FROM scored GROUP BY scenario)""",
        f"""edges AS MATERIALIZED (SELECT scenario, list_sort(list_distinct({quants('v', TENTHS)})) AS e FROM (
          SELECT scenario, list(pd ORDER BY pd) AS v FROM scored WHERE seen GROUP BY scenario))""",
        f"""bands AS MATERIALIZED (SELECT scenario, band, CASE WHEN n >= 50 THEN own ELSE obs END AS band_rate FROM (
          SELECT scenario, {above('pd', 'e')} AS band, count(*) AS n, avg(bad) AS own FROM scored JOIN edges USING (scenario)
          WHERE seen GROUP BY ALL) JOIN sides USING (scenario))""",
        f"""drawn_bad AS MATERIALIZED (SELECT *, CASE WHEN uu < least(1.0, scale * coalesce(band_rate, obs)) THEN 1.0 ELSE 0.0 END AS y
          FROM (SELECT s.*, {above('pd', 'e')} AS band, obs, {u('app_id', f"concat('parcel:{SEED}#', replicate)")} AS uu
            FROM scored s JOIN edges USING (scenario) JOIN sides USING (scenario) WHERE NOT seen)
          LEFT JOIN bands USING (scenario, band), scales)""",
    ]
    if with_ipw:
        out += ["ufits AS MATERIALIZED (SELECT *, CASE WHEN seen THEN 1.0 ELSE 0.0 END AS y FROM fits)"]
        out += card_ctes("q", "ufits", NUMERIC, CATS, "y", "1.0", one)
        out += score_cte("approved", "fits", "q", NUMERIC, CATS, keys=one)
        out += ["capped AS MATERIALIZED (SELECT *, greatest(1e-4, least(1.0, pd)) AS p FROM approved WHERE seen)",
                "cap AS MATERIALIZED (SELECT scenario, quantile_cont(1 / p, CAST(0.99 AS DOUBLE)) AS cap FROM capped GROUP BY scenario)",
                "iview AS MATERIALIZED (SELECT *, least(1 / p, cap) AS w FROM capped JOIN cap USING (scenario))"]
        views.append(f"SELECT scenario, scale, 'ipw', {ROWCOLS}, bad, w FROM iview, scales")
        est.append("""SELECT scenario, scale, 'ipw', greatest(0, least(1, (ttd - wa / (wa + wr) * obs) / greatest(1 - wa / (wa + wr), 1e-9))), ttd
          FROM (SELECT scenario, sum(bad * w) / sum(w) AS ttd FROM iview GROUP BY scenario) JOIN sides USING (scenario), scales""")
    out += [
        f"view AS MATERIALIZED ({' UNION ALL '.join(views)})",
        f"""est AS MATERIALIZED (SELECT scenario, scale, method, rej, coalesce(ttd0, (wa * obs + wr * rej) / (wa + wr)) AS ttd
          FROM ({' UNION ALL '.join(est)}) JOIN sides USING (scenario))""",
        *card_ctes("v", "view", NUMERIC, CATS, "bad", "w", three),
        f"""vs AS MATERIALIZED (SELECT scenario, scale, method, {logistic(5)} AS sc, swy AS tp, sw - swy AS fp
          FROM v_cells JOIN v_beta USING (scenario, scale, method))""",
        *areas("claimed", "vs", three, "sc", "tp", "fp"),
        "evm AS MATERIALIZED (SELECT evs.*, scale, method FROM evs JOIN (SELECT scenario, scale, method FROM est) USING (scenario))",
        *score_cte("evp", "evm", "v", NUMERIC, CATS, keys=three),
        *areas("actual", "evp", three, "pd", "bad", "1 - bad"),
    ]
    return out


BT = backtest_ctes("true", 5, [2.0], True) + score_cte("evb", "evs", "a", NUMERIC, CATS, keys=["scenario"]) + [
    *areas("bact", "evb", ["scenario"], "pd", "bad", "1 - bad"),
    "evbs AS (SELECT * FROM evb WHERE seen)",
    *areas("brep", "evbs", ["scenario"], "pd", "bad", "1 - bad"),
    f"pfit AS MATERIALIZED (SELECT replicate, {ROWCOLS}, bad FROM pool WHERE NOT is_eval)",
    *card_ctes("o", "pfit", NUMERIC, CATS, keys=["replicate"]),
    f"pev AS MATERIALIZED (SELECT replicate, {ROWCOLS}, bad FROM pool WHERE is_eval)",
    *score_cte("pevp", "pev", "o", NUMERIC, CATS, keys=["replicate"]),
    *areas("best", "pevp", ["replicate"], "pd", "bad", "1 - bad"),
    """common AS MATERIALIZED (SELECT facts.*, CAST(n_rejected AS DOUBLE) / (n_accepted + n_rejected) AS realised_rejection_rate,
      bact.gini AS baseline_actual_ttd_gini, brep.gini AS baseline_reported_gini, best.gini AS oracle_ttd_gini
      FROM facts JOIN bact USING (scenario) JOIN brep USING (scenario) JOIN best USING (replicate))""",
    f"""bt AS MATERIALIZED (SELECT *, est_ttd_bad_rate - truth_ttd_bad_rate AS bad_rate_bias,
      est_reject_bad_rate - truth_reject_bad_rate AS reject_bad_rate_bias, claimed_gini - actual_ttd_gini AS gini_bias,
      CASE WHEN method = '{NO_CORRECTION}' THEN 0 ELSE actual_ttd_gini - baseline_actual_ttd_gini END AS gini_uplift FROM (
      SELECT common.*, '{NO_CORRECTION}' AS method, truth_accepted_bad_rate AS est_ttd_bad_rate, CAST(NULL AS DOUBLE) AS est_reject_bad_rate,
        baseline_reported_gini AS claimed_gini, baseline_actual_ttd_gini AS actual_ttd_gini FROM common
      UNION ALL SELECT common.*, method, ttd, rej, claimed.gini, actual.gini FROM common JOIN est USING (scenario)
        JOIN claimed USING (scenario, scale, method) JOIN actual USING (scenario, scale, method)))""",
]
_BT = ["truth_ttd_bad_rate", "truth_reject_bad_rate", "truth_accepted_bad_rate", "realised_rejection_rate", "baseline_actual_ttd_gini",
       "baseline_reported_gini", "oracle_ttd_gini", "est_ttd_bad_rate", "est_reject_bad_rate", "claimed_gini", "actual_ttd_gini",
       "bad_rate_bias", "reject_bad_rate_bias", "gini_bias", "gini_uplift"]
LABELLERS = [NO_CORRECTION, "parcelling", "fuzzy", "ipw"]
UNFITTED = f"""SELECT cutoff_type, rejection_rate, replicate, n_pool, n_accepted, n_rejected, CAST(2 AS DOUBLE), method,
  {', '.join('NULL' for _ in _BT)}, skipped FROM allfacts, (SELECT unnest({LABELLERS!r}) AS method) WHERE skipped IS NOT NULL"""
oracle("backtest_rows", f"""SELECT cutoff_type, rejection_rate, replicate, n_pool, n_accepted, n_rejected, CAST(2 AS DOUBLE) AS reject_bad_scale,
  method, {', '.join(r(c) for c in _BT)}, CAST(NULL AS VARCHAR) AS skipped FROM bt UNION ALL {UNFITTED}""", BT)


def _spread(c):
    return f"avg({c}) AS {c}, stddev_samp({c}) AS {c}_sd"


SUMMARY = f"""summ AS MATERIALIZED (SELECT cutoff_type, rejection_rate, method, {_spread('bad_rate_bias')}, avg(abs(bad_rate_bias)) AS abs_bad_rate_bias,
  {_spread('gini_bias')}, avg(abs(gini_bias)) AS abs_gini_bias, {_spread('gini_uplift')}, avg(actual_ttd_gini) AS actual_ttd_gini,
  avg(truth_ttd_bad_rate) AS truth_ttd_bad_rate, avg(oracle_ttd_gini) AS oracle_ttd_gini, avg(realised_rejection_rate) AS realised_rejection_rate,
  count(DISTINCT CASE WHEN truth_ttd_bad_rate IS NOT NULL THEN replicate END) AS n_reps FROM (SELECT cutoff_type, rejection_rate, replicate,
  method, {', '.join(_BT)} FROM bt UNION ALL SELECT cutoff_type, rejection_rate, replicate, method, {', '.join('NULL' for _ in _BT)}
  FROM allfacts, (SELECT unnest({LABELLERS!r}) AS method) WHERE skipped IS NOT NULL) GROUP BY cutoff_type, rejection_rate, method)"""
_SUM = ["bad_rate_bias", "bad_rate_bias_sd", "abs_bad_rate_bias", "gini_bias", "gini_bias_sd", "abs_gini_bias", "gini_uplift",
        "gini_uplift_sd", "actual_ttd_gini", "truth_ttd_bad_rate", "oracle_ttd_gini", "realised_rejection_rate"]
oracle("backtest_summary", f"SELECT cutoff_type, rejection_rate, method, {', '.join(r(c) for c in _SUM)}, n_reps FROM summ", BT, SUMMARY)
RISKY = "cutoff_type IN ('risk_hard', 'risk_soft')"
oracle("method_ranking", f"""SELECT method, round(avg(abs_bad_rate_bias), 6) AS mean_abs_bad_rate_bias, round(avg(abs_gini_bias), 6) AS mean_abs_gini_bias,
  round(avg(gini_uplift), 6) AS mean_gini_uplift, round(avg(gini_bias_sd), 6) AS instability FROM summ WHERE {RISKY} GROUP BY method""", BT, SUMMARY)
HOLDS = f"""steps AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY rejection_rate) AS step FROM (
  SELECT method, rejection_rate, avg(abs_bad_rate_bias) AS bias FROM summ WHERE {RISKY} GROUP BY method, rejection_rate)),
holds AS MATERIALIZED (SELECT method, max(CASE WHEN so_far AND step = seen THEN rejection_rate END) AS holds_up_to FROM (
  SELECT *, bool_and(coalesce(100 * bias <= 2, false)) OVER w AS so_far, count(*) OVER w AS seen FROM steps
  WINDOW w AS (PARTITION BY method ORDER BY step ROWS UNBOUNDED PRECEDING)) GROUP BY method)"""
oracle("holds_up_to", "SELECT method, holds_up_to FROM holds", BT, SUMMARY, HOLDS)
oracle("breaking_point", f"""SELECT CAST(2 AS DOUBLE) AS tolerance_pp, low AS lowest_rate, high AS highest_rate, best AS best_rate,
  coalesce(names, '') AS best_methods, best = high AS whole_range, base AS baseline_holds_up_to, coalesce(base >= best, false) AS baseline_held_as_far
  FROM (SELECT *, (SELECT string_agg(method, ', ' ORDER BY method) FROM holds
    WHERE method <> '{NO_CORRECTION}' AND holds_up_to = best) AS names FROM (SELECT max(holds_up_to) FILTER (method <> '{NO_CORRECTION}') AS best,
    max(holds_up_to) FILTER (method = '{NO_CORRECTION}') AS base, (SELECT min(rejection_rate) FROM steps) AS low,
    (SELECT max(rejection_rate) FROM steps) AS high FROM holds))""", BT, SUMMARY, HOLDS)

# Student's t with odd or even integer degrees of freedom, as a finite cosine series
_TH = "atan(t / sqrt(df))"
TAIL = f"""(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * ({_TH} + CASE WHEN df > 1 THEN sin({_TH}) * list_sum(
    [cos({_TH}) ** (2 * i + 1) * list_product(list_concat([CAST(1 AS DOUBLE)], [CAST(2 * j AS DOUBLE) / (2 * j + 1) for j in range(1, i + 1)])) for i in range(0, (df - 3) // 2 + 1)]) ELSE 0 END)
  ELSE sin({_TH}) * list_sum([cos({_TH}) ** (2 * i) * list_product(list_concat([CAST(1 AS DOUBLE)], [CAST(2 * j - 1 AS DOUBLE) / (2 * j) for j in range(1, i + 1)])) for i in range(0, df // 2)]) END) / 2"""
oracle("null_case", f"""SELECT method, round(e, 6) AS mean_abs_bad_rate_bias, round(e0, 6) AS baseline_abs_bad_rate_bias, round(d, 6) AS excess_over_baseline,
  round(p, 6) AS p_one_sided, n AS n_pairs, round(g, 6) AS mean_abs_gini_bias, fails AS hallucinates
  FROM (SELECT *, d > 0.01 AND p < 0.05 AND method <> '{NO_CORRECTION}' AS fails FROM (SELECT *, CASE WHEN flat THEN 1 ELSE {TAIL} END AS p FROM (
    SELECT *, n - 1 AS df, d / nullif(sd / sqrt(n), 0) AS t, method = '{NO_CORRECTION}' OR n < 3 OR most <= 1e-8 OR coalesce(sd, 0) <= 0 AS flat FROM (
      SELECT a.method, avg(abs(a.bad_rate_bias)) AS e, avg(abs(b.bad_rate_bias)) AS e0, avg(abs(a.bad_rate_bias) - abs(b.bad_rate_bias)) AS d,
        stddev_samp(abs(a.bad_rate_bias) - abs(b.bad_rate_bias)) AS sd, max(abs(abs(a.bad_rate_bias) - abs(b.bad_rate_bias))) AS most,
        count(*) AS n, avg(abs(a.gini_bias)) AS g FROM bt a JOIN bt b ON a.cutoff_type = b.cutoff_type AND a.rejection_rate = b.rejection_rate
        AND a.replicate = b.replicate WHERE a.cutoff_type = 'random' AND b.method = '{NO_CORRECTION}' GROUP BY a.method))))""", BT)
SENS = backtest_ctes("cutoff_type IN ('risk_hard', 'random') AND rejection_rate BETWEEN 0.2 AND 0.6", 2, [1.0, 1.5, 2.0, 3.0], False) + [
    """sens AS MATERIALIZED (SELECT method, scale, cutoff_type, avg(abs(ttd - truth_ttd_bad_rate)) AS abs_bad_rate_bias,
      avg(ttd - truth_ttd_bad_rate) AS bad_rate_bias, avg(abs(claimed.gini - actual.gini)) AS abs_gini_bias FROM facts JOIN est USING (scenario)
      JOIN claimed USING (scenario, scale, method) JOIN actual USING (scenario, scale, method) GROUP BY method, scale, cutoff_type)"""]
oracle("scale_sensitivity", f"""SELECT method, scale AS reject_bad_scale, cutoff_type, {r('abs_bad_rate_bias')}, {r('bad_rate_bias')}, {r('abs_gini_bias')},
  n_fitted, n_skipped FROM (SELECT * FROM (SELECT cutoff_type, count(*) FILTER (skipped IS NULL) AS n_fitted,
    count(skipped) AS n_skipped FROM allfacts GROUP BY cutoff_type), (SELECT unnest(['parcelling', 'fuzzy']) AS method),
    (SELECT unnest([CAST(1 AS DOUBLE), 1.5, 2, 3]) AS scale))
  LEFT JOIN sens USING (method, scale, cutoff_type)""", SENS)
oracle("best_scale", """SELECT cutoff_type, method, arg_min(scale, abs_bad_rate_bias) AS reject_bad_scale,
  round(min(abs_bad_rate_bias), 6) AS abs_bad_rate_bias FROM sens GROUP BY cutoff_type, method""", SENS)


# --- the headline document ------------------------------------------------------------------------------
def section(name: str, of: str, key: str = "''", other: str = "") -> str:
    """Numeric columns of a query's result as (section, metric, key, value); ``other`` columns are left out."""
    dropped = f" EXCLUDE ({other})" if other else ""
    return f"""SELECT '{name}' AS section, metric, who AS key, value FROM (
      SELECT CAST({key} AS VARCHAR) AS who, CAST(COLUMNS(*{dropped}) AS DOUBLE) FROM ({ORACLES[of]}))
      UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (who))))"""


oracle("headline_metrics", " UNION ALL ".join([
    section("data", "panel_rates"), section("data", "overlap_share"),
    section("coverage", "field_coverage", "field", "field"), section("baseline", "evaluate_split", "is_test", "is_test"),
    section("information_value", "iv_table", "feature", "feature"),
    section("methods", "method_table", "method", "method"), section("positivity", "positivity"),
    section("selection", "selection_model", other="converged, rho_significant_5pct"),
    section("ranking", "method_ranking", "method", "method"),
    section("null_case", "null_case", "method", "method, hallucinates"), section("yields", "breakeven"),
    section("economics", "method_economics", "method", "method"),
    section("sensitivity", "funding_sensitivity", "concat_ws(' ', method, cost_of_funds_annual)", "method, cost_of_funds_annual"),
    section("regions", "zip_dispersion")]))
