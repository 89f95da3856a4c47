"""Session set-up and written intermediates."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g"):
    """A session for tests and the benchmark; clusters bring their own.

    It gets a folder for intermediates unless the machine's defaults name one.
    """
    builder = SparkSession.builder
    if not SparkConf().get("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="throughdoor-"))
    return (
        builder.master(f"local[{cores}]")
        .appName("throughdoor")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def prepare(spark: SparkSession) -> None:
    """Let Spark split generated methods that HotSpot would not compile.

    Binning and scoring compare a value with many edges at once. As one
    generated method beyond 8,000 bytes of code that stays interpreted and is
    several times slower; below this limit Spark splits it. A session that sets
    the limit itself keeps its own.
    """
    if spark.conf.get(HUGE_METHOD) == "65535":
        spark.conf.set(HUGE_METHOD, "8000")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("build the session with spark.checkpoint.dir, a folder that all executors share")
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, and it gives
    the planner the real size of the result: a join against it is broadcast
    only while its files stay under ``spark.sql.autoBroadcastJoinThreshold``
    and is a shuffle join beyond that.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt evenly over at least two tasks a core, by ranges of ``order`` if given.

    For tables of few bytes whose rows cost much time each: Spark plans tasks by bytes.
    """
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else df.repartition(tasks)


def small_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A handful of driver-side rows (model parameters) as a local relation.

    Built from Arrow, so the planner knows its size and broadcasts it.
    """
    names = [f.name for f in schema.fields]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


PARAMETER_ROWS = 100_000


def localize(df: DataFrame, label: str) -> DataFrame:
    """Model parameters (a row or two per key) as a local relation.

    Fetches at most ``PARAMETER_ROWS`` rows; a larger table is written instead
    and joined like any other.
    """
    table = df.limit(PARAMETER_ROWS + 1).toArrow()
    if table.num_rows > PARAMETER_ROWS:
        return materialize(df, label)
    return df.sparkSession.createDataFrame(table, df.schema)
