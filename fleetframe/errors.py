"""The ``on_error`` switch shared by every operator that can reject rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F


class _Pair(NamedTuple):
    good: DataFrame
    rejects: DataFrame


class Split(_Pair):
    """Accepted rows and rejected rows (the latter keep their error column).

    ``rows`` has both in one frame with the error column, for callers that want each input
    row once; reading ``good`` and ``rejects`` runs the plan before them twice.
    """

    rows: DataFrame | None = None

    @classmethod
    def of(cls, good: DataFrame, rejects: DataFrame, rows: DataFrame) -> Split:
        out = cls(good, rejects)
        out.rows = rows
        return out


def split(df: DataFrame, error: str = "error", on_error: str = "quarantine") -> Split:
    """Separate rows by a nullable error column.

    ``quarantine`` sets bad rows aside; ``fail`` makes the job fail on the first bad row.
    """
    if on_error == "quarantine":
        return Split.of(
            df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull()), df
        )
    if on_error == "fail":
        ok = F.when(F.col(error).isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("rejected row: "), F.col(error))).cast("boolean")
        )
        return Split.of(df.filter(ok).drop(error), df.filter(F.lit(False)), df.filter(ok))
    raise ValueError(f"on_error must be 'quarantine' or 'fail', not {on_error!r}")
