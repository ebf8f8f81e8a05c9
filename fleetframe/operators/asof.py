"""Aggregates over what follows a row in its key's order, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sizing import ROWS_PER_TASK, hot_keys_and_rows, join_null_safe, shared_table, time_chunks

ROWS_PER_PARTITION = 250_000


class Following(NamedTuple):
    """One aggregate: over rows, over the results of chunks, and of the chunk's own and the later ones' result."""

    of_rows: Column
    of_chunks: callable
    both: callable


def count_of(value: Column) -> Following:
    return Following(F.count(value), lambda c: F.sum(c), lambda a, b: a + F.coalesce(b, F.lit(0)))


def least_of(value: Column) -> Following:
    return Following(F.min(value), lambda c: F.min(c), lambda a, b: F.least(a, b))


def following(
    rows: DataFrame, key: Sequence[str], at: str, late: Column, values: dict[str, Following],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add to each row the aggregates over the rows of its key with a larger ``at`` (a number), itself included.

    Among equal ``at``, rows for which ``late`` holds follow the others. One
    sorted pass, never a join of pairs; chunks of hot keys add what the chunks after them hold. Its
    partitions are as many as the rows ask for: left to their bytes, which shrink to little on the way, one task would
    sort millions of rows. Rows without ``at`` see nothing and count for none.
    """
    key = list(key)
    hot, total = hot_keys_and_rows(rows, key, at, rows_per_task)
    chunked = time_chunks(rows, key, at, rows_per_task, hot)
    groups = [*key, "_chunk"]
    seen = Window.partitionBy(*groups).orderBy(F.col(at).desc(), late.desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: v.of_rows.over(seen) for n, v in values.items()}
    if hot is not None:
        later = Window.partitionBy(*key).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = join_null_safe(chunked, hot, key, "left_semi").groupBy(*groups).agg(
            *[v.of_rows.alias(f"_sum_{n}") for n, v in values.items()])
        # A row for each chunk of a hot key: written, so that the planner knows how few they are.
        carried = shared_table(sums.select(
            *groups, *[v.of_chunks(F.col(f"_sum_{n}")).over(later).alias(f"_later_{n}") for n, v in values.items()]))
        chunked = join_null_safe(chunked, carried, groups, "left")
        out = {n: values[n].both(c, F.col(f"_later_{n}")) for n, c in out.items()}
    partitions = -(-total // ROWS_PER_PARTITION)
    if partitions > 1:
        chunked = chunked.repartition(partitions, *groups)
    known = F.col(at).isNotNull()
    return chunked.select(*rows.columns, *[F.when(known, c).alias(n) for n, c in out.items()])
