"""Queries over registry artifacts and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels, locations, specs
from ..operators import versions as V
from ..operators.ordering import enumerate_rows
from ..schemas import CHANNELS
from ..sizing import shared_table
from .views import table, view

# Sort key of the three version shapes in the data, for the outside engine.
KEY = (
    "CAST(regexp_extract({v}, '^([0-9]+)', 1) AS BIGINT), "
    "CAST(regexp_extract({v}, '^[0-9]+[.]([0-9]+)', 1) AS BIGINT), "
    "CAST(regexp_extract({v}, '^[0-9]+[.][0-9]+[.]([0-9]+)', 1) AS BIGINT), "
    "CASE WHEN {v} LIKE '%-%' THEN 0 ELSE 1 END, {v}"
)


def artifacts(spark, sf):
    tag = F.col("tag")
    tags = F.when(tag.isNotNull(), F.array(
        F.struct(tag.alias("name")), F.struct(F.lit("latest").alias("name"))))
    return view(spark, sf, "v_artifact").select("id", "repository", tags.alias("tags"))


def index(spark, sf):
    """The index is small and read several times, so it is written once."""
    return shared_table(V.version_index(V.artifact_versions(artifacts(spark, sf)).good).rows)


def matrix(spark, sf, rows=None):
    rows = index(spark, sf) if rows is None else rows
    return V.version_matrix(view(spark, sf, "v_operator"), rows.filter(F.col("error").isNull()).drop("error"))


def _rejected(rows):
    """Versions that the index rejects, in the columns of the matrix."""
    return rows.filter(F.col("error").isNotNull()).select(
        F.regexp_replace("chart", "-operator$", "").alias("operator"), "channel", "version",
        F.col("copies").cast("bigint").alias("copies"), "error")


def version_matrix(spark, sf):
    rows = index(spark, sf)
    numbered = enumerate_rows(matrix(spark, sf, rows), ["key"], ["operator", "channel"], "position")
    return numbered.select(
        "operator", "channel", "version", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
        F.when(F.col("version").isNotNull(), F.col("position")).alias("position"),
    ).unionByName(_rejected(rows), allowMissingColumns=True)


INDEX_SQL = """
    SELECT CASE WHEN version = '0.0.0-dev' THEN 'dev' WHEN version LIKE '%-pr%' THEN 'test'
                ELSE 'stable' END AS channel, chart, version, count(*) AS copies
    FROM (SELECT substring(repository, 8) AS chart,
                 replace(replace(tag, '-arm64', ''), '-amd64', '') AS version FROM {v_artifact} WHERE starts_with(repository, 'charts/'))
    WHERE version IS NOT NULL GROUP BY ALL"""
_REJECTED_SQL = "left(chart, length(chart) - 9) AS operator, channel, version, CAST(copies AS BIGINT) AS copies"
MATRIX_SQL = f"""
    SELECT o.operator, c.channel, i.version, i.copies
    FROM {{v_operator}} o CROSS JOIN (VALUES ('stable'), ('test'), ('dev')) c(channel)
    LEFT JOIN ({INDEX_SQL}) i ON i.channel = c.channel AND i.chart = o.operator || '-operator' AND i.version <> 'latest-build'"""


def version_report(spark, sf):
    report = V.version_report(matrix(spark, sf))
    return report.select("operator", F.col("part").cast("int").alias("part"), "stable", "test", "dev")


def artifact_versions(spark, sf):
    good = F.col("error").isNull()
    return V.artifact_versions(artifacts(spark, sf)).rows.select(
        "id", *[F.when(good, c).alias(n) for n, c in (
            ("project", F.col("project")), ("chart", F.col("chart")), ("version", F.col("version")),
            ("channel", channels.channel_of_tag(F.col("version"))))], "error")


def channel_compare(spark, sf):
    v = F.col("version")
    rows = view(spark, sf, "v_version").select(
        "id", "version", channels.channel_of_tag(v).alias("by_tag"),
        channels.channel_of_version(v).alias("by_version"))
    return rows.withColumn("same", F.col("by_tag").eqNullSafe(F.col("by_version")).cast("int"))


def latest_outdated(spark, sf):
    latest = V.latest_release(view(spark, sf, "v_feed"), "tool-", ["repo"])
    rows = V.outdated(view(spark, sf, "v_tool"), latest.good, ["repo"], only_outdated=False)
    return rows.select("id", "repo", "version", "latest", "state").unionByName(
        latest.rejects.select("repo", F.col("error").alias("state")), allowMissingColumns=True)


def _chart_indexes(spark, sf):
    """One chart index for each customer."""
    rows = table(spark, sf, "customer")
    key = F.col("c_custkey")
    entry = lambda chart, i: F.struct(
        chart.alias("name"), F.concat(F.lit(f"{i}."), (key % 7).cast("string"), F.lit(".0")).alias("version"))
    chart_a, chart_b = F.lit("a-operator"), F.concat(F.lower("c_mktsegment"), F.lit("-operator"))
    return rows.select(
        key.alias("repo"),
        F.create_map(chart_a, F.array(entry(chart_a, 1), entry(chart_a, 2)),
                     chart_b, F.array(F.when(key % 31 == 0, F.struct(chart_b.alias("name"), F.lit("three").alias("version")))
                                      .otherwise(entry(chart_b, 3)))).alias("entries"))


def index_explode(spark, sf):
    return V.explode_index(_chart_indexes(spark, sf))


def chart_matrix(spark, sf):
    """The operator list from chart repositories, of which each serves one channel."""
    rows = V.explode_index(_chart_indexes(spark, sf))
    channel = F.get(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("repo") % 3).cast("int"))
    found = shared_table(V.version_index(rows, channel=channel).rows)
    names = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("operator")).union(
        spark.sql("SELECT * FROM VALUES ('a'), ('none') AS t(operator)")).distinct()
    return V.version_matrix(names, found.filter(F.col("error").isNull()).drop("error")).select(
        "operator", "channel", "version", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
    ).unionByName(_rejected(found), allowMissingColumns=True)


def crd_url(spark, sf):
    rows = view(spark, sf, "v_version")
    template = "https://example.com/%1$s-operator/%2$s/deploy/helm/%1$s-operator/crds/crds.yaml"
    return rows.select("id", locations.crd_url(F.lower("product"), F.col("version"), template).alias("url"))


def location_kind(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", locations.chart_source_kind(url).alias("kind"), locations.path_or_url(url).alias("form"))


def cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", locations.cache_key(F.col("url")).alias("cache_key"))


def spec_validate(spark, sf):
    key = F.col("p_partkey")
    text = (
        F.when(key % 8 == 0, "").when(key % 8 == 1, "airflow").when(key % 8 == 2, "airflow=")
        .when(key % 8 == 3, "airflow=1.2.3=").when(key % 8 == 4, "airflow=23.7")
        .when(key % 8 == 5, "nosuch=1.2.3")
        .when(key % 8 == 6, F.concat(F.lit("  zookeeper=1."), F.col("p_size").cast("string"), F.lit(".3 ")))
        .otherwise(F.concat(F.lit("trino=0."), F.col("p_size").cast("string"), F.lit(".0-rc1")))
    )
    both = specs.parse_operator_specs(
        table(spark, sf, "part").select(key.alias("id"), text.alias("text")), "text").rows
    spec = specs.format_operator_spec(F.col("name"), F.col("version"))
    return both.select("id", "name", "version", "error", spec.alias("spec"))


QUERIES = {
    "version_matrix": version_matrix, "version_report": version_report,
    "artifact_versions": artifact_versions, "channel_compare": channel_compare,
    "latest_outdated": latest_outdated, "index_explode": index_explode, "chart_matrix": chart_matrix, "crd_url": crd_url,
    "location_kind": location_kind, "cache_key": cache_key, "spec_validate": spec_validate,
}

_INDEX_ROWS = """
        SELECT c_custkey AS repo, chart, CAST(pos AS INT) AS pos, chart AS name,
               CASE WHEN major = 3 AND c_custkey % 31 = 0 THEN 'three'
                    ELSE CAST(major AS STRING) || '.' || CAST(c_custkey % 7 AS STRING) || '.0' END AS version
        FROM (SELECT c_custkey, 'a-operator' AS chart, 0 AS pos, 1 AS major FROM {customer}
              UNION ALL SELECT c_custkey, 'a-operator', 1, 2 FROM {customer}
              UNION ALL SELECT c_custkey, lower(c_mktsegment) || '-operator', 0, 3 FROM {customer})"""

ORACLE = {
    "version_matrix": f"""
        SELECT operator, channel, version, CAST(coalesce(copies, 0) AS BIGINT) AS copies,
               CASE WHEN version IS NOT NULL THEN CAST(row_number() OVER (
                 PARTITION BY operator, channel ORDER BY {KEY.format(v='version')}) AS BIGINT) END AS position, NULL AS error
        FROM ({MATRIX_SQL})
        UNION ALL SELECT {_REJECTED_SQL}, NULL, 'InvalidVersion' FROM ({INDEX_SQL}) WHERE version = 'latest-build'""",
    "version_report": f"""
        WITH runs AS (
          SELECT operator, channel, version, run, least(copies - run, 1000) AS n
          FROM (SELECT *, unnest(generate_series(0, coalesce(copies, 1) - 1, 1000)) AS run FROM ({MATRIX_SQL}))),
        items AS (
          SELECT operator, channel, version, run, left(repeat(version || ', ', CAST(n AS INT)),
                 CAST(length(version || ', ') * n - 2 AS INT)) AS t,
                 row_number() OVER (PARTITION BY operator, channel ORDER BY {KEY.format(v='version')}, run) AS rn
          FROM runs),
        texts AS (
          SELECT operator, channel, CAST((rn - 1) // 1000 AS INT) AS part, string_agg(t, ', ' ORDER BY rn) AS t
          FROM items GROUP BY ALL)
        SELECT operator, part,
               coalesce(max(CASE WHEN channel = 'stable' THEN t END), '') AS stable,
               coalesce(max(CASE WHEN channel = 'test' THEN t END), '') AS test,
               coalesce(max(CASE WHEN channel = 'dev' THEN t END), '') AS dev
        FROM texts GROUP BY ALL""",
    "artifact_versions": """
        SELECT id, 'charts' AS project, substring(repository, 8) AS chart, version,
               CASE WHEN version = '0.0.0-dev' THEN 'dev' WHEN version LIKE '%-pr%' THEN 'test'
                    ELSE 'stable' END AS channel, NULL AS error
        FROM (SELECT *, replace(replace(tag, '-arm64', ''), '-amd64', '') AS version FROM {v_artifact})
        WHERE version IS NOT NULL AND starts_with(repository, 'charts/')
        UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'UnexpectedRepositoryName' FROM {v_artifact} WHERE NOT starts_with(repository, 'charts/')""",
    "channel_compare": """
        SELECT *, CASE WHEN by_tag IS NOT DISTINCT FROM by_version THEN 1 ELSE 0 END AS same
        FROM (SELECT id, version,
                CASE WHEN version IS NULL THEN NULL WHEN version = '0.0.0-dev' THEN 'dev'
                     WHEN version LIKE '%-pr%' THEN 'test' ELSE 'stable' END AS by_tag,
                CASE WHEN version IS NULL THEN 'dev'
                     WHEN split_part(version, '-', 2) IN ('nightly', 'dev') THEN 'dev'
                     WHEN starts_with(split_part(version, '-', 2), 'pr') THEN 'test'
                     ELSE 'stable' END AS by_version
              FROM {v_version})""",
    "latest_outdated": """
        WITH latest AS (
          SELECT repo, regexp_replace(arg_min(name, pos), '^(tool-)+', '') AS latest FROM {v_feed}
          WHERE NOT draft AND NOT prerelease AND starts_with(name, 'tool-') GROUP BY repo),
        feeds AS (SELECT DISTINCT repo FROM {v_feed})
        SELECT id, repo, version, latest,
               CASE WHEN [CAST(split_part(latest, '.', 1) AS INT), CAST(split_part(latest, '.', 2) AS INT)]
                       > [CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)]
                    THEN 'out-of-date' ELSE 'up-to-date' END AS state
        FROM {v_tool} JOIN latest USING (repo)
        UNION ALL SELECT NULL, repo, NULL, NULL, 'FindLatestRelease' FROM feeds ANTI JOIN latest USING (repo)""",
    "index_explode": _INDEX_ROWS,
    "chart_matrix": f"""
        WITH found AS (SELECT [{', '.join(repr(c) for c in CHANNELS)}][repo % 3 + 1] AS channel, chart, version, count(*) AS copies
                       FROM ({_INDEX_ROWS}) GROUP BY ALL)
        SELECT o.operator, c.channel, i.version, CAST(coalesce(i.copies, 0) AS BIGINT) AS copies, NULL AS error
        FROM (SELECT DISTINCT lower(c_mktsegment) AS operator FROM {{customer}} UNION SELECT 'a' UNION SELECT 'none') o
        CROSS JOIN (VALUES ('stable'), ('test'), ('dev')) c(channel)
        LEFT JOIN found i ON i.channel = c.channel AND i.chart = o.operator || '-operator' AND i.version <> 'three'
        UNION ALL SELECT {_REJECTED_SQL}, 'InvalidVersion' FROM found WHERE version = 'three'""",
    "crd_url": """
        SELECT id, 'https://example.com/' || lower(product) || '-operator/'
               || CASE WHEN version LIKE '%-dev' THEN 'main' ELSE version END
               || '/deploy/helm/' || lower(product) || '-operator/crds/crds.yaml' AS url
        FROM {v_version}""",
    "location_kind": """
        SELECT page_id,
               CASE WHEN starts_with(url, 'oci://') THEN 'Oci'
                    WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN 'Repo'
                    ELSE 'Local' END AS kind,
               CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN 'Url'
                    ELSE 'Path' END AS form
        FROM {pages}""",
    "cache_key": r"""
        SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '-', 'g') || '-' || sha256(url) AS cache_key
        FROM {pages}""",
    "spec_validate": """
        SELECT *, name || coalesce('=' || version, '') AS spec FROM (
        SELECT p_partkey AS id,
               CASE p_partkey % 8 WHEN 1 THEN 'airflow' WHEN 6 THEN 'zookeeper' WHEN 7 THEN 'trino' END AS name,
               CASE p_partkey % 8 WHEN 6 THEN '1.' || CAST(p_size AS STRING) || '.3'
                                  WHEN 7 THEN '0.' || CAST(p_size AS STRING) || '.0-rc1' END AS version,
               CASE p_partkey % 8 WHEN 0 THEN 'EmptyInput' WHEN 2 THEN 'MissingVersion'
                    WHEN 3 THEN 'InvalidEqualSignCount' WHEN 4 THEN 'ParseVersion'
                    WHEN 5 THEN 'InvalidName' END AS error
        FROM {part})""",
}
