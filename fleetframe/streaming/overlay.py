"""Last-definition-wins overlay of a stream of definitions.

Each micro-batch is folded to one partial row per key and appended under its batch number,
so a retried batch overwrites itself. Reading folds the partials again, which is exact
because first position and last value combine in any grouping. :func:`compact` bounds the
number of partials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import ORDER


def _partial(df: DataFrame, key, order) -> DataFrame:
    values = [c for c in df.columns if c not in (*key, *order)]
    at = F.struct(*order)
    return df.groupBy(*key).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last_at"),
        F.max_by(F.struct(*values), at).alias("_last"),
    )


def _fold(partials: DataFrame, key) -> DataFrame:
    return partials.groupBy(*key).agg(
        F.min("_first").alias("_first"), F.max("_last_at").alias("_last_at"),
        F.max_by("_last", "_last_at").alias("_last"),
    )


def start_overlay(
    stream: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("name",),
    order: Sequence[str] = ORDER, **trigger,
):
    """Start the query that maintains the overlay under ``path``; returns the query."""

    def append(batch: DataFrame, batch_id: int) -> None:
        _partial(batch, list(key), list(order)).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_overlay(spark: SparkSession, path: str, key: Sequence[str] = ("name",)) -> DataFrame:
    """The merged definitions so far, with first position and last values."""
    folded = _fold(spark.read.parquet(path).drop("batch"), list(key))
    return folded.select(*key, "_first.*", "_last.*")


def compact(spark: SparkSession, path: str, target: str, key: Sequence[str] = ("name",)) -> None:
    """Fold all partials of a stopped query into the single batch 0 of a new folder."""
    _fold(spark.read.parquet(path).drop("batch"), list(key)).write.parquet(f"{target}/batch=0")
