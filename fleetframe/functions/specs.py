"""Validation of ``name=value`` and ``name[=version]`` texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Split, split
from ..schemas import OPERATORS
from .semver import is_semver


# --- fixed values: Unicode White_Space ---------------------------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ---------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(text, F.lit(WHITE_SPACE))


def _judge(trimmed: Column) -> Column:
    sign = F.instr(trimmed, F.lit("="))
    name, value = F.substr(trimmed, F.lit(1), sign - 1), F.substr(trimmed, sign + 1)
    error = (
        F.when(trimmed.isNull() | (trimmed == ""), "EmptyInput")
        .when((sign == 0) | value.contains("="), "InvalidEqualSignCount")
        .when(sign == 1, "EmptyName")
        .when(value == "", "EmptyValue")
    )
    return F.struct(
        F.when(error.isNull(), name).alias("name"),
        F.when(error.isNull(), value).alias("value"),
        error.alias("error"),
    )


def parameter(text: Column) -> Column:
    """``STRUCT<name, value, error>`` of one ``name=value`` text; checks in fixed order."""
    return _judge(strip(text))


def parse_parameters(df: DataFrame, col: str, on_error: str = "quarantine") -> Split:
    """One parameter per row: adds ``name`` and ``value``, rejects keep ``error``."""
    parsed = df.withColumn("_p", parameter(F.col(col))).select(*df.columns, "_p.*")
    return split(parsed, "error", on_error)


def parse_parameter_lists(df: DataFrame, col: str, on_error: str = "quarantine") -> Split:
    """Parameters separated by single spaces: one row per parameter with its ``pos``.

    The first bad part rejects its whole text, so the check stays within the row.
    """
    trimmed = strip(F.col(col))
    items = F.transform(F.transform(F.split(trimmed, " ", -1), strip), _judge)
    with_items = df.withColumn("_items", items).withColumn(
        "error",
        F.when(F.col(col).isNull(), "EmptyInput").otherwise(
            F.get(F.filter("_items", lambda i: i["error"].isNotNull()), F.lit(0))["error"]
        ),
    )
    # A rejected text keeps one row without a parameter.
    rows = with_items.select(
        *df.columns, "error",
        F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_items"))).alias("pos", "_p"),
    ).select(*df.columns, "pos", "_p.name", "_p.value", "error")
    good, rejects = split(rows, "error", on_error)
    return Split.of(good, rejects.drop("pos", "name", "value"), rows)


def parse_operator_specs(
    df: DataFrame, col: str, valid: Iterable[str] = OPERATORS, on_error: str = "quarantine"
) -> Split:
    """``name`` or ``name=version``: adds ``name`` and a nullable ``version``."""
    trimmed = strip(F.col(col))
    sign = F.instr(trimmed, F.lit("="))
    name = F.when(sign == 0, trimmed).otherwise(F.substr(trimmed, F.lit(1), sign - 1))
    version = F.when(sign > 0, F.substr(trimmed, sign + 1))
    error = (
        F.when(F.col(col).isNull() | (trimmed == ""), "EmptyInput")
        .when(version.contains("="), "InvalidEqualSignCount")
        .when(~name.isin(*valid), "InvalidName")
        .when(version == "", "MissingVersion")
        .when(version.isNotNull() & ~is_semver(version), "ParseVersion")
    )
    checked = df.select(
        *df.columns, error.alias("error"),
        F.when(error.isNull(), name).alias("name"),
        F.when(error.isNull(), version).alias("version"),
    )
    return split(checked, "error", on_error)


def format_operator_spec(name: Column, version: Column) -> Column:
    return F.concat(name, F.coalesce(F.concat(F.lit("="), version), F.lit("")))
