"""Exported registry pages, their completeness, release feeds, sinks and source order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import Split, split
from ..schemas import ARTIFACT_PAGE, ARTIFACT_PAGE_SIZE, REPOSITORY_PAGE_SIZE

_PAGE_FILE = r"/([0-9]+)\.json$"


def read_artifact_pages(spark: SparkSession, path: str, on_error: str = "quarantine") -> Split:
    """Pages ``<project>/<repository>/<page>.json`` under ``path`` as one row per artifact.

    A repository name may itself hold slashes. An empty page keeps one row with null
    ``pos``, so the audit still sees it.
    """
    file = F.col("_metadata.file_path")
    # All between the root and the page number; the root may be written with or without a scheme.
    root = path.split("://", 1)[-1].split("/", 1)[-1].strip("/")
    name = F.regexp_replace(
        F.substring_index(F.concat(F.lit("/"), file), "/" + root + "/", -1) if root else file, _PAGE_FILE, "")
    pages = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        name.alias("repository"), F.regexp_extract(file, _PAGE_FILE, 1).try_cast("int").alias("page"), "value",
    )
    return parse_artifact_pages(pages, on_error)


def parse_artifact_pages(pages: DataFrame, on_error: str = "quarantine") -> Split:
    """Pages (repository, page, JSON ``value``) as one row per artifact; see above."""
    pages = pages.select("repository", "page", F.from_json("value", ARTIFACT_PAGE).alias("artifacts")).withColumn(
        "error", F.when(F.col("artifacts").isNull(), "ParseArtifacts"))
    good, rejects = split(pages, "error", on_error)
    return Split(
        good.select("repository", "page", F.posexplode_outer("artifacts").alias("pos", "a"))
        .select("repository", "page", "pos", "a.digest", "a.tags"),
        rejects.select("repository", "page", "error"),
    )


def audit_pages(
    artifacts: DataFrame, by: Sequence[str] = ("repository",), page_size: int = ARTIFACT_PAGE_SIZE
) -> DataFrame:
    """Repositories whose pages are not 1..n with only the last one short, and why.

    Rows are folded per page first, so one huge repository is spread over its pages.
    """
    pages = artifacts.groupBy(*by, "page").agg(F.count("pos").alias("n"))
    per_repo = pages.groupBy(*by).agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.count(F.lit(1)).alias("pages"), F.max_by("n", "page").alias("last_count"),
        F.count_if(F.col("n") < page_size).alias("short_pages"), F.max("n").alias("top_count"),
    )
    problem = (
        F.when((F.col("first_page") != 1) | (F.col("pages") != F.col("last_page")), "MissingPage")
        .when(F.col("top_count") > page_size, "OversizedPage")
        .when(F.col("last_count") >= page_size, "UnfinishedListing")
        .when(F.col("short_pages") > 1, "ShortPageInside")
    )
    return per_repo.withColumn("problem", problem)


def page_gaps(artifacts: DataFrame, by: Sequence[str] = ("repository",)) -> DataFrame:
    """Page intervals that a repository lacks, and pages that it has more than once.

    One row for each interval: ``first_page``, ``last_page``, ``problem`` (MissingPages or DoubledPage)
    and ``copies`` of a doubled page. Pages count from 1. Islands of consecutive pages begin and end where a
    neighbour is missing, which two joins on the page find; only their edges are put in order, so
    a long listing without gaps orders two rows. Rows without a page are ignored.
    """
    by = list(by)
    places = artifacts.filter(F.col("page") >= 1).groupBy(*by, "page", "pos").agg(F.count(F.lit(1)).alias("_n"))
    pages = places.groupBy(*by, "page").agg(F.max("_n").alias("copies"))
    have = pages.select(*by, "page")
    beside = lambda step: have.select(*by, (F.col("page") + step).alias("page"))
    starts = have.join(beside(1), [*by, "page"], "left_anti").withColumn("_end", F.lit(0))
    ends = have.join(beside(-1), [*by, "page"], "left_anti").withColumn("_end", F.lit(1))
    edges = Window.partitionBy(*by).orderBy("page", "_end")
    before = F.coalesce(F.lag("page").over(edges), F.lit(0))
    missing = starts.unionByName(ends).withColumn("_before", before).filter(
        (F.col("_end") == 0) & (F.col("page") > F.col("_before") + 1)
    ).select(*by, (F.col("_before") + 1).alias("first_page"), (F.col("page") - 1).alias("last_page"),
             F.lit("MissingPages").alias("problem"), F.lit(None).cast("long").alias("copies"))
    doubled = pages.filter(F.col("copies") > 1).select(
        *by, F.col("page").alias("first_page"), F.col("page").alias("last_page"), F.lit("DoubledPage").alias("problem"), "copies")
    return missing.unionByName(doubled)


def audit_repositories(
    repositories: DataFrame, by: Sequence[str], limit: int = REPOSITORY_PAGE_SIZE
) -> DataFrame:
    """Repository lists come unpaged, so exactly ``limit`` entries were probably cut off."""
    return repositories.groupBy(*by).agg(F.count(F.lit(1)).alias("repositories")).withColumn(
        "maybe_cut", F.col("repositories") >= limit
    )


def read_feed(spark: SparkSession, path: str, on_error: str = "quarantine") -> Split:
    """Release feeds (JSON arrays) as rows (file, pos, name, prerelease, draft); unreadable files rejected.

    An empty feed keeps one row with null ``pos``.
    """
    entry = "ARRAY<STRUCT<name: STRING, prerelease: BOOLEAN, draft: BOOLEAN>>"
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", entry).alias("entries"),
    ).withColumn("error", F.when(F.col("entries").isNull(), "ParseFeed"))
    good, rejects = split(files, "error", on_error)
    return Split(
        good.select("file", F.posexplode_outer("entries").alias("pos", "e")).select(
            "file", "pos", "e.name", F.coalesce("e.prerelease", F.lit(False)).alias("prerelease"),
            F.coalesce("e.draft", F.lit(False)).alias("draft")),
        rejects.select("file", "error"),
    )


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write any listing as JSON lines (or parquet)."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"fmt must be 'json' or 'parquet', not {fmt!r}")
    df.write.mode(mode).format(fmt).save(path)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def with_source_order(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union of sources, later ones taking precedence by a larger ``source_ord``."""
    numbered = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
