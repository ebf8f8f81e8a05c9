"""Semantic versions as Columns: validity, fields and an order-preserving key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Grammar of semver.org 2.0.0; numbers have no leading zeros.
SEMVER = (
    r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
    r"(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
    r"(\.(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?"
    r"(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?\z"
)
U64_MAX = "18446744073709551615"
_IDS = "ARRAY<STRUCT<text: BOOLEAN, digits: INT, id: STRING, len: INT>>"


def _head(v: Column) -> Column:
    return F.substring_index(v, "+", 1)


def _core_text(v: Column) -> Column:
    return F.substring_index(_head(v), "-", 1)


def _core(v: Column) -> Column:
    return F.transform(F.split(_core_text(v), r"\."), lambda x: x.try_cast("decimal(20,0)"))


def prerelease(v: Column) -> Column:
    """Text between the first ``-`` and the build metadata; empty for a release."""
    head = _head(v)
    return F.substr(head, F.length(_core_text(v)) + 2)


def build_metadata(v: Column) -> Column:
    return F.substr(v, F.length(_head(v)) + 2)


def is_semver(v: Column) -> Column:
    """Null-safe: true only for a full three-part version whose parts fit 64 bits."""
    fits = F.forall(
        _core(v), lambda n: n.isNotNull() & (n <= F.lit(U64_MAX).cast("decimal(20,0)"))
    )
    # Shorter numbers always fit, so the parts are only parsed when one has 20 digits.
    small = ~v.rlike("[0-9]{20}")
    return F.coalesce(v.rlike(SEMVER) & (small | F.coalesce(fits, F.lit(False))), F.lit(False))


def _identifiers(text: Column) -> Column:
    """Dot-separated identifiers; digits compare by value and sort before other text."""
    parts = F.filter(F.split(text, r"\."), lambda x: x != "")

    def key(x):
        number = F.regexp_replace(x, "^0+", "")
        digits = x.rlike(r"^[0-9]+\z")
        return F.struct(
            (~digits).alias("text"),
            F.when(digits, F.length(number)).otherwise(F.lit(0)).alias("digits"),
            F.when(digits, number).otherwise(x).alias("id"),
            F.length(x).alias("len"),
        )

    return F.when(text == "", F.array().cast(_IDS)).otherwise(F.transform(parts, key))


def semver_key(v: Column) -> Column:
    """Comparable struct in semantic-version order; null for an invalid version.

    Spark compares arrays element by element with the shorter first, which is the
    pre-release rule. Build metadata is the last tie breaker.
    """
    return F.when(
        is_semver(v),
        F.struct(
            _core(v).alias("core"),
            (prerelease(v) == "").alias("is_release"),
            _identifiers(prerelease(v)).alias("pre"),
            _identifiers(build_metadata(v)).alias("build"),
        ),
    )


def sort_versions(versions: Column, on_error: str = "quarantine") -> Column:
    """Sort one (bounded) array of version texts; invalid ones fail or are left out."""
    keyed = F.transform(versions, lambda v: F.struct(semver_key(v).alias("k"), v.alias("v")))
    if on_error == "fail":
        bad = F.filter(keyed, lambda e: e["k"].isNull())
        keyed = F.when(F.size(bad) == 0, keyed).otherwise(
            F.raise_error(F.concat(F.lit("invalid version: "), F.get(bad, F.lit(0))["v"]))
        )
    else:
        keyed = F.filter(keyed, lambda e: e["k"].isNotNull())
    return F.transform(F.array_sort(keyed), lambda e: e["v"])
