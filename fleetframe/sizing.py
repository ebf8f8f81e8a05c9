"""Size checks and splitting of hot groups.

An operator that must see the rows of one key in order (numbering, running state) is only
safe in one task while that key is small. The helpers here measure the largest group with
a partially aggregated count and, for keys above the limit, cut the key's time line into
chunks of about ``rows_per_task`` rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType

ROWS_PER_TASK = 4_000_000
STEPS_PER_CHUNK = 4
MIN_STEPS = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage, reachable by the driver and all executors.

    ``spark.checkpoint.dir`` of the session; where that is unset, a folder in the session's
    warehouse, which Spark's own tables need to be shared as well.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lineage"


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (columnar, survives executors)."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(rows, rows of the largest group); one partially aggregated pass over ``by``."""
    counted = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
    row = counted.agg(F.sum("count").alias("total"), F.max("count").alias("top")).first()
    return row.total or 0, row.top or 0


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join on ``on`` where null keys match each other; keeps the left key columns."""
    other = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, cond, how).drop(*[f"_r_{c}" for c in on])


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp column as microseconds since 1970, independent of the session zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def hot_keys(df: DataFrame, by: list[str], t: str, rows_per_task: int) -> DataFrame | None:
    """Keys of more than ``rows_per_task`` timed rows with their count; None if there are none."""
    return hot_keys_and_rows(df, by, t, rows_per_task)[0]


def hot_keys_and_rows(df: DataFrame, by: list[str], t: str, rows_per_task: int) -> tuple[DataFrame | None, int]:
    """:func:`hot_keys` and the number of all rows, in the same pass."""
    seen = Observation()
    counted = df.groupBy(*by).agg(F.count(t).alias("_n"), F.count(F.lit(1)).alias("_all")).observe(seen, F.sum("_all").alias("rows"))
    stats = shared_table(counted.filter(F.col("_n") > rows_per_task).drop("_all"))
    return None if stats.isEmpty() else stats, seen.get["rows"] or 0


def time_chunks(
    df: DataFrame, by: list[str], t: str, rows_per_task: int, hot: DataFrame | None,
    name: str = "_chunk",
) -> DataFrame:
    """Add a chunk number that cuts ``hot`` keys along the long column ``t``.

    Other keys keep chunk 0; rows without a time get chunk -1. A hot key is cut at quantiles of
    its own times, so a far outlier or a burst makes no chunk large. Equal times always share
    a chunk.
    """
    untimed = F.when(F.col(t).isNull(), F.lit(-1))
    if hot is None:
        return df.withColumn(name, F.coalesce(untimed, F.lit(0)))
    top = hot.agg(F.max("_n")).first()[0]
    steps = max(MIN_STEPS, STEPS_PER_CHUNK * -(-top // rows_per_task))
    quantiles = join_null_safe(df.select(*by, t), hot, by, "left_semi").groupBy(*by).agg(
        F.percentile_approx(t, [i / steps for i in range(1, steps)], 20 * steps).alias("_q")
    )
    # Every key takes as many of the quantiles as it has chunks.
    chunks = F.ceil(F.col("_n") / rows_per_task).cast("int")
    cuts = shared_table(join_null_safe(hot, quantiles, by, "inner").select(*by, F.array_distinct(F.transform(
        F.sequence(F.lit(1), chunks - 1),
        lambda i: F.get("_q", F.greatest(F.lit(0), F.floor(i * steps / chunks).cast("int") - 1)),
    )).alias("_cuts")))
    placed = join_null_safe(df, cuts, by, "left")
    chunk = F.size(F.filter("_cuts", lambda c: c < F.col(t)))
    return placed.select(
        *df.columns,
        F.coalesce(untimed, F.when(F.col("_cuts").isNotNull(), chunk), F.lit(0)).cast("int").alias(name),
    )
