"""Accepted and declined application files, harmonised to one schema."""
from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AMOUNT_WINDOW, DTI_WINDOW, SCORE_WINDOW, Audit
from ..functions import fields as R
from ..runtime import scratch_root

# --- fixed values: file columns and the types they are read as ---------------
ACCEPTED_FIELDS = {
    "loan_amnt": "double", "funded_amnt": "double", "term": "string", "int_rate": "string",
    "issue_d": "string", "loan_status": "string", "emp_length": "string", "dti": "double",
    "zip_code": "string", "addr_state": "string", "fico_range_low": "double",
    "fico_range_high": "double", "total_pymnt": "double", "total_rec_prncp": "double",
    "total_rec_int": "double", "recoveries": "double", "grade": "string",
}
DECLINED_FIELDS = {
    "Amount Requested": ("amount_requested", "double"),
    "Application Date": ("application_date", "string"),
    "Risk_Score": ("risk_score", "double"),
    "Debt-To-Income Ratio": ("dti_ratio", "string"),
    "Zip Code": ("zip_code", "string"),
    "State": ("state", "string"),
    "Employment Length": ("emp_length", "string"),
}


def _csv(spark: SparkSession, path: str, tasks: int | None) -> DataFrame:
    """Header-named text columns; the parser only decodes those selected later.

    A gzip file is one split, so it is spread over ``tasks`` before the work.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .csv(path))
    return raw.repartition(tasks) if tasks else raw


def _typed(raw: DataFrame, names: dict, row_id: str | None) -> DataFrame:
    missing = [c for c in names if c not in raw.columns]
    cols = []
    for source, (target, kind) in names.items():
        c = F.lit(None).cast("string") if source in missing else F.col(f"`{source}`")
        cols.append((R.number(c) if kind == "double" else c.cast("string")).alias(target))
    if row_id:
        return raw.select(F.col(row_id).cast("string").alias("app_id"), *cols)
    # No key in the file: a digest of the row's fields and the number of its
    # copy. Equal rows are counted and dealt out again, so each is a row of its own.
    held = [F.col(f"`{s}`") for s in names if s not in missing]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in held]))
    counted = raw.select(digest.alias("digest"), *cols).groupBy("digest", *[t for t, _ in names.values()]).agg(
        F.count(F.lit(1)).alias("copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return counted.select("*", copy).select(
        F.concat_ws("-", "digest", "copy").alias("app_id"), *[t for t, _ in names.values()])


def read_accepted(spark: SparkSession, path: str, row_id: str | None = None,
                  tasks: int | None = None) -> DataFrame:
    """17 of the accepted file's columns, typed; unparseable numbers are null."""
    names = {c: (c, kind) for c, kind in ACCEPTED_FIELDS.items()}
    return _typed(_csv(spark, path, tasks), names, row_id)


def read_declined(spark: SparkSession, path: str, row_id: str | None = None,
                  tasks: int | None = None) -> DataFrame:
    return _typed(_csv(spark, path, tasks), DECLINED_FIELDS, row_id)


def _optional(raw: DataFrame, name: str, kind: str):
    return F.col(name) if name in raw.columns else F.lit(None).cast(kind)


def harmonise_accepted(raw: DataFrame, fill: bool = True) -> DataFrame:
    """Accepted rows on the shared schema plus outcome and cash flows.

    ``fill=False`` leaves nulls in ``state`` and ``zip3`` for coverage reports.
    """
    state, zip3 = F.col("addr_state"), R.zip_prefix("zip_code")
    issued = R.month_year("issue_d")
    status = R.filled("loan_status", "")
    return raw.where(F.col("loan_amnt").isNotNull()).select(
        "app_id",
        R.windowed(R.band_midpoint("fico_range_low", "fico_range_high"), SCORE_WINDOW).alias("risk_score"),
        R.windowed(R.number("dti"), DTI_WINDOW).alias("dti"),
        R.employment_years("emp_length").alias("emp_length_yrs"),
        R.windowed(R.number("loan_amnt"), AMOUNT_WINDOW).alias("amount_requested"),
        (R.filled(state, "XX") if fill else state).alias("state"),
        (R.filled(zip3, "<NA>") if fill else zip3).alias("zip3"),
        issued.alias("app_date"), F.year(issued).alias("app_year"),
        R.outcome(status).alias("bad"), status.alias("loan_status"),
        R.filled(_optional(raw, "grade", "string"), "NA").alias("grade"),
        R.percent("int_rate").alias("int_rate"),
        R.leading_months("term").alias("term_months"),
        *[R.number(_optional(raw, c, "double")).alias(c) for c in
          ["funded_amnt", "total_rec_prncp", "total_rec_int", "recoveries", "total_pymnt"]],
        F.lit(1).alias("accepted"))


def harmonise_declined(raw: DataFrame, fill: bool = True) -> DataFrame:
    state, zip3 = F.col("state"), R.zip_prefix("zip_code")
    asked = R.iso_date("application_date")
    return raw.select(
        "app_id",
        R.windowed(R.number("risk_score"), SCORE_WINDOW).alias("risk_score"),
        R.windowed(R.percent("dti_ratio"), DTI_WINDOW).alias("dti"),
        R.employment_years("emp_length").alias("emp_length_yrs"),
        R.windowed(R.number("amount_requested"), AMOUNT_WINDOW).alias("amount_requested"),
        (R.filled(state, "XX") if fill else state).alias("state"),
        (R.filled(zip3, "<NA>") if fill else zip3).alias("zip3"),
        asked.alias("app_date"), F.year(asked).alias("app_year"),
        F.lit(None).cast("double").alias("bad"), F.lit(0).alias("accepted"))


def file_facts(spark: SparkSession, path: str) -> list:
    """Name, size and time of every file of an input; nothing if there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        rows = files.select("path", "length", F.col("modificationTime").cast("double").alias("at")).collect()
    except AnalysisException:
        return []
    return sorted(map(list, rows))


def cached(spark: SparkSession, name: str, build, spec: Audit, *inputs: str,
           root: str | None = None) -> DataFrame:
    """A Parquet copy of ``build()``, reused while settings and input files match.

    The path carries a digest of the settings and of the inputs' names, sizes
    and times, so a changed seed or a replaced file never meets rows of before.
    """
    seen = [json.dumps([path, file_facts(spark, path)]) for path in inputs]
    path = f"{root or scratch_root(spark)}/{name}-{spec.digest(*seen)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not written yet
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
