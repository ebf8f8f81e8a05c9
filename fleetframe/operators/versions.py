"""Registry artifacts and versions: index, matrix, report, latest and outdated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Split, split
from ..functions.channels import channel_of_tag
from ..functions.semver import semver_key
from ..schemas import CHANNELS
from .ordering import join_text


def artifact_versions(artifacts: DataFrame, on_error: str = "quarantine") -> Split:
    """(project, chart, version) of each tagged artifact; one row per architecture.

    The repository name splits at its first slash. Only the first tag counts.
    """
    slash = F.instr("repository", F.lit("/"))
    tag = F.get("tags", F.lit(0))["name"]
    version = F.replace(F.replace(tag, F.lit("-arm64"), F.lit("")), F.lit("-amd64"), F.lit(""))
    rows = artifacts.withColumns({
        "error": F.when(F.coalesce(slash, F.lit(0)) == 0, "UnexpectedRepositoryName"),
        "project": F.substr("repository", F.lit(1), slash - 1),
        "chart": F.substr("repository", slash + 1),
        "version": version,
    })
    return split(rows.filter(F.col("error").isNotNull() | F.col("version").isNotNull()), "error", on_error)


def version_index(
    rows: DataFrame, by: Sequence[str] = (), channel: Column | None = None,
    on_error: str = "quarantine",
) -> Split:
    """(channel, chart, version, copies, key): the versions of every chart by channel.

    Equal versions are folded into ``copies`` before the shuffle, so a chart's list stays
    as long as its distinct versions however many artifacts it has.
    """
    channel = channel_of_tag(F.col("version")) if channel is None else channel
    index = (
        rows.withColumn("channel", channel)
        .groupBy(*by, "channel", "chart", "version")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", semver_key(F.col("version")))
        .withColumn("error", F.when(F.col("key").isNull(), "InvalidVersion"))
    )
    return split(index, "error", on_error)


def version_matrix(operators: DataFrame, index: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every operator in every channel with its versions; an empty list is one null row."""
    cells = operators.withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS]))
    ).withColumn("chart", F.concat("operator", F.lit("-operator")))
    return cells.join(index, [*by, "channel", "chart"], "left")


def version_lists(
    matrix: DataFrame, by: Sequence[str] = ("operator", "channel"), copies_per_item: int = 1000,
    items_per_part: int = 1000,
) -> DataFrame:
    """Versions of each matrix cell as sorted text, every copy listed; see ``join_text``."""
    runs = matrix.withColumn(
        "_run",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1,
                             F.lit(copies_per_item))),
    ).withColumn(
        "versions",
        F.array_join(
            F.array_repeat(
                F.col("version"),
                F.least(F.col("copies") - F.col("_run"), F.lit(copies_per_item)).cast("int"),
            ), ", ",
        ),
    )
    return join_text(runs, list(by), ["key", "version", "_run"], "versions",
                     items_per_part=items_per_part)


def version_report(
    matrix: DataFrame, by: Sequence[str] = ("operator",), channels: Sequence[str] = CHANNELS,
    items_per_part: int = 1000,
) -> DataFrame:
    """One row per operator with the version text of each channel as a column.

    Pass ``channels=("stable",)`` for the short listing. Very long lists continue in
    further rows, numbered by ``part``.
    """
    texts = version_lists(
        matrix.filter(F.col("channel").isin(*channels)), [*by, "channel"],
        items_per_part=items_per_part,
    )
    cell = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("versions"))), F.lit(""))
    return texts.groupBy(*by, "part").agg(*[cell(c).alias(c) for c in channels])


def explode_index(meta: DataFrame) -> DataFrame:
    """Chart index (repo, entries map) as rows (repo, chart, pos, name, version)."""
    return meta.select("repo", F.explode("entries").alias("chart", "list")).select(
        "repo", "chart", F.posexplode("list").alias("pos", "e")
    ).select("repo", "chart", "pos", F.col("e.name").alias("name"),
             F.col("e.version").alias("version"))


def latest_release(
    feed: DataFrame, prefix: str, by: Sequence[str] = (), order: Sequence[str] = ("pos",),
    on_error: str = "quarantine",
) -> Split:
    """First published entry of the feed whose name has the prefix, as a version.

    Feed order decides, not the highest version. The prefix is removed repeatedly.
    """
    published = ~F.col("draft") & ~F.col("prerelease") & F.col("name").startswith(prefix)
    # A feed without a published entry keeps its row, so that it can be rejected.
    first = feed.groupBy(*by).agg(F.min_by("name", F.when(published, F.struct(*order))).alias("name"))
    latest = first.withColumn(
        "latest",
        F.regexp_replace("name", F.concat(F.lit(r"^(\Q"), F.lit(prefix), F.lit(r"\E)+")), F.lit(""))
        if prefix else F.col("name"),
    )
    error = F.when(F.col("name").isNull(), "FindLatestRelease").when(
        semver_key(F.col("latest")).isNull(), "ParseVersion"
    )
    return split(latest.withColumn("error", error), "error", on_error)


def outdated(
    installed: DataFrame, latest: DataFrame, by: Sequence[str], only_outdated: bool = True
) -> DataFrame:
    """Compare ``installed.version`` with ``latest.latest``; strictly newer is out-of-date."""
    newer = semver_key(F.col("latest")) > semver_key(F.col("version"))
    joined = installed.join(latest.select(*by, "latest"), list(by)).withColumn(
        "state", F.when(newer, "out-of-date").otherwise("up-to-date")
    )
    return joined.filter(newer) if only_outdated else joined
