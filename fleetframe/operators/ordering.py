"""Numbering and ordered text, safe for groups of any size."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..sizing import join_null_safe

ROWS_PER_RANGE = 50_000
MAX_RANGES = 1024
SAMPLES_PER_RANGE = 40


def _sort_keys(order: Sequence) -> list[tuple[Column, bool, bool]]:
    """(value, descending, nulls first) of each order item: a name, a column or a sort order of a named column."""
    out = []
    for item in order:
        found = re.fullmatch(r"Column<'(.*) (ASC|DESC) NULLS (FIRST|LAST)'>", str(item), re.S)
        if isinstance(item, str):
            out.append((F.col(item), False, True))
        elif found:
            out.append((F.col(found[1]), found[2] == "DESC", found[3] == "FIRST"))
        else:
            out.append((item, False, True))
    return out


def _literal(value, kind: DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _not_before(keys: list[tuple[Column, bool, bool]], bound, kinds: list[DataType]) -> Column:
    """Whether a row comes at or after ``bound`` in the order of ``keys``."""
    result = F.lit(True)
    for (value, down, nulls_first), b, kind in reversed(list(zip(keys, bound, kinds))):
        if b is None:
            after = value.isNotNull() if nulls_first else F.lit(False)
            same = value.isNull()
        else:
            at = _literal(b, kind)
            after = F.coalesce(value < at if down else value > at, F.lit(not nulls_first))
            same = value.eqNullSafe(at)
        result = after | (same & result)
    return result


def range_number(df: DataFrame, order: Sequence, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> Column | None:
    """Number of the range, in ``order``, that a row of ``df`` falls into; None if one range is enough.

    There is one range for each ``rows_per_range`` of the ``rows``, cut at quantiles of a sample of
    fixed size for each range. The bounds are literals, so every reading of ``df`` puts a row into
    the same range; which rows were sampled changes sizes only, never a result.
    """
    ranges = min(MAX_RANGES, -(-rows // rows_per_range))
    if ranges < 2:
        return None
    keys = _sort_keys(order)
    lean = df.select(*[value.alias(f"k{i}") for i, (value, _, _) in enumerate(keys)])
    sorts = [getattr(F.col(f"k{i}"), f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")()
             for i, (_, down, first) in enumerate(keys)]
    share = min(1.0, 1.2 * ranges * SAMPLES_PER_RANGE / rows)
    seen = lean.sample(share, seed=7).orderBy(*sorts).collect()
    cuts = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    kinds = [f.dataType for f in lean.schema.fields]

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_not_before(keys, cuts[mid], kinds), place(mid + 1, hi)).otherwise(place(lo, mid))

    return place(0, len(cuts)) if cuts else None


def enumerate_rows(
    df: DataFrame,
    order: Sequence,
    by: Sequence[str] = (),
    name: str = "row_no",
    rows_per_task: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add a 1-based number in ``order``, restarting for every group ``by``.

    ``order`` must be total; rows equal in all of it share a range and are numbered as they come.
    The order is cut into ranges by a histogram of its own (see :func:`range_number`): rows are
    counted for each (group, range) by a partial aggregate, the counts of a group's earlier ranges
    are added up, and rows are numbered inside (group, range). No task holds a whole group, and
    nothing is written. ``df`` is read once to count, once to sample, and twice to number.
    """
    by = list(by)
    ranges = range_number(df, order, df.count(), rows_per_task)
    if ranges is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    group = [*by, "_range"]
    placed = df.withColumn("_range", ranges)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_RANGES rows for each group.
    starts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).select(
        *group, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return join_null_safe(placed.withColumn("_no", inside), starts, group, "inner").select(
        *df.columns, (F.col("_start") + F.col("_no")).alias(name)
    )


def join_text(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence,
    text: str,
    sep: str = ", ",
    name: str | None = None,
    items_per_part: int = 1000,
    rows_per_task: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Join ``text`` in ``order`` into one cell per group.

    A cell holds at most ``items_per_part`` items; a longer group continues in the rows
    ``part`` = 1, 2, ..., so the result is whole and no task collects an unbounded group.
    """
    numbered = enumerate_rows(df, order, by, "_no", rows_per_task)
    cell = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_no", F.col(text).alias("_t")))),
                    lambda e: e["_t"]),
        sep,
    )
    part = F.floor((F.col("_no") - 1) / items_per_part).cast("int")
    return (
        numbered.withColumn("part", part).groupBy(*by, "part").agg(cell.alias(name or text))
    )
