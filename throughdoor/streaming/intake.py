"""Incremental intake: the row-wise stages on a stream of application files.

Harmonising, seeded sampling and scoring look at one row at a time and need no
state, so the batch functions run unchanged on a streaming DataFrame. This is
how a file too large for one pass, or still growing, is sampled as it arrives.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Audit
from ..operators import sampling, scorecard
from ..sources import applications


def stream_declined(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of raw declined applications, as Parquet with a known schema."""
    return spark.readStream.schema(schema).parquet(folder)


def intake(raw: DataFrame, spec: Audit) -> DataFrame:
    """Harmonised rows of the seeded sample; the draw depends on the row key only."""
    rows = applications.harmonise_declined(raw)
    return sampling.bernoulli(rows, "app_id", spec.sample.declined_rate, f"declined_sample:{spec.seed}")


def score(rows: DataFrame, cards: scorecard.Scorecards) -> DataFrame:
    """P(bad) of arriving applicants under fitted scorecards."""
    return cards.score(rows)


def write(rows: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, once for all files present; returns the query."""
    return (rows.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
