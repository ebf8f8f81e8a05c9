"""The two channel rules. They disagree on purpose and must not be merged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .semver import is_semver, prerelease


def channel_of_tag(v: Column) -> Column:
    """Channel of a published registry tag: only exactly ``0.0.0-dev`` is dev."""
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v == "0.0.0-dev", "dev")
        .when(v.contains("-pr"), "test")
        .otherwise("stable")
    )


def channel_of_version(v: Column) -> Column:
    """Channel a requested version is installed from; no version means dev."""
    pre = prerelease(v)
    return (
        F.when(v.isNull(), "dev")
        .when(~is_semver(v), F.lit(None).cast("string"))
        .when(pre.isin("nightly", "dev"), "dev")
        .when(pre.startswith("pr"), "test")
        .otherwise("stable")
    )
