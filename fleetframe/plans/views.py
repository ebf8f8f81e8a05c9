"""Fleet tables derived from the given benchmark tables.

The benchmark data has no cluster objects, so every query runs on views over whole tables.
A view is plain SQL that Spark and DuckDB both read; ``{name}`` stands for a table or
another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "v_artifact": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 83 = 5 THEN '' ELSE 'charts/' END || lower(replace(p_brand, '#', '-')) || '-operator' AS repository,
               CASE WHEN p_partkey % 89 = 7 THEN 'latest-build' ELSE CASE p_partkey % 7
                 WHEN 0 THEN '0.0.0-dev'
                 WHEN 1 THEN '0.0.0-pr' || CAST(p_partkey % 400 AS STRING)
                 WHEN 2 THEN NULL
                 ELSE CAST(20 + p_size % 6 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING)
                      || '.' || CAST(p_partkey % 3 AS STRING)
                      || CASE p_partkey % 5 WHEN 0 THEN '-amd64' WHEN 1 THEN '-arm64' ELSE '' END
               END END AS tag
        FROM {part}""",
    "v_operator": """
        SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS operator FROM {part}
        UNION SELECT DISTINCT lower(p_type) AS operator FROM {part}""",
    "v_version": """
        SELECT p_partkey AS id,
               CASE p_partkey % 6
                 WHEN 0 THEN '0.0.0-dev' WHEN 1 THEN '0.0.0-nightly'
                 WHEN 2 THEN '0.0.0-pr' || CAST(p_partkey AS STRING)
                 WHEN 3 THEN '1.' || CAST(p_size AS STRING) || '.0-dev'
                 WHEN 4 THEN NULL
                 ELSE '1.' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING)
               END AS version,
               p_type AS product
        FROM {part}""",
    "v_feed": """
        SELECT CAST(p_partkey % 25 AS INT) AS repo, p_partkey AS pos,
               CASE WHEN p_partkey % 3 = 0 THEN 'other-' WHEN p_partkey % 11 = 0 THEN 'tool-tool-'
                    ELSE 'tool-' END
               || CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || '.0' AS name,
               p_size % 5 = 0 OR p_partkey % 25 = 24 AS draft, p_size % 7 = 0 AS prerelease
        FROM {part}""",
    "v_tool": """
        SELECT s_suppkey AS id, s_nationkey AS repo,
               CAST(s_suppkey % 9 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.0' AS version
        FROM {supplier}""",
    "v_def": """
        SELECT o_custkey AS name, CAST(substring(o_orderpriority, 1, 1) AS INT) AS source_ord,
               o_orderkey AS pos, o_totalprice AS value
        FROM {orders}""",
    "v_text_param": """
        SELECT event_id, user_id AS request,
               CASE event_id % 9
                 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN 'k=' WHEN 3 THEN '=v' WHEN 4 THEN 'a=b=c'
                 WHEN 5 THEN '  k1=' || regexp_extract(props, '([0-9]+)', 1) || ' '
                 WHEN 6 THEN CASE WHEN event_id % 41 = 0 THEN 'x=1' ELSE 'k3=y' END
                 ELSE 'k' || CAST(event_id % 4 AS STRING) || '=' || regexp_extract(props, '([0-9]+)', 1)
               END AS text
        FROM {events}""",
    "v_installed": """
        SELECT CAST(s_suppkey % 25 AS INT) AS cluster, 'ns' || CAST(s_suppkey % 3 AS STRING) AS namespace,
               'rel-' || CAST(s_suppkey AS STRING) AS release,
               CAST(1 + s_suppkey % 4 AS STRING) || '.0.0' AS version
        FROM {supplier}""",
    "v_wanted": """
        SELECT CAST(c_custkey % 25 AS INT) AS cluster, 'ns' || CAST(c_custkey % 3 AS STRING) AS namespace,
               'rel-' || CAST(c_custkey AS STRING) AS release,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE CAST(1 + c_custkey % 6 AS STRING) || '.0.0' END AS version
        FROM {customer}""",
    "v_object": """
        SELECT c_custkey AS id, CAST(c_custkey % 5 AS INT) AS cluster,
               'ns' || CAST(c_custkey % 3 AS STRING) AS namespace,
               'obj-' || CAST(c_custkey AS STRING) AS owner,
               CASE c_custkey % 3 WHEN 0 THEN 'trino' WHEN 1 THEN 'kafka' ELSE 'hdfs' END AS product
        FROM {customer}""",
    "v_service": """
        SELECT CAST(o_custkey % 5 AS INT) AS cluster, 'ns' || CAST(o_custkey % 3 AS STRING) AS namespace,
               CASE o_custkey % 3 WHEN 0 THEN 'trino' WHEN 1 THEN 'kafka' ELSE 'hdfs' END AS product,
               'obj-' || CAST(o_custkey AS STRING) AS owner,
               CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'obj-' || CAST(o_custkey AS STRING) ELSE '' END
               || 'obj-' || CAST(o_custkey AS STRING)
               || '-s' || CAST(o_orderkey AS STRING) AS name,
               o_orderkey AS pos,
               CASE o_orderstatus WHEN 'P' THEN 'NodePort' WHEN 'O' THEN 'LoadBalancer'
                    ELSE 'ClusterIP' END AS type,
               CASE WHEN o_orderkey % 7 = 0 THEN 'lb' || CAST(o_orderkey AS STRING) END AS hostname,
               CASE WHEN o_orderkey % 2 = 0 THEN '10.1.0.' || CAST(o_orderkey % 200 AS STRING) END AS ip,
               CAST(o_orderkey % 4 AS INT) AS shape,
               'node-' || CAST(o_custkey % 5 + 5 * (o_orderkey % 30) AS STRING) AS node
        FROM {orders}""",
    "v_port": """
        SELECT CAST(o_custkey % 5 AS INT) AS cluster, 'ns' || CAST(o_custkey % 3 AS STRING) AS namespace,
               'obj-' || CAST(o_custkey AS STRING) AS owner,
               CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'obj-' || CAST(o_custkey AS STRING) ELSE '' END
               || 'obj-' || CAST(o_custkey AS STRING)
               || '-s' || CAST(o_orderkey AS STRING) AS name,
               o_orderkey AS pos, l_linenumber AS port_pos,
               CASE l_linenumber % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'https-x' WHEN 2 THEN 'ui' END
               AS port_name,
               8000 + l_linenumber AS port,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE 30000 + l_linenumber END AS node_port
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "v_listener": """
        SELECT CAST(s_suppkey % 5 AS INT) AS cluster, 'ns' || CAST(s_suppkey % 3 AS STRING) AS namespace,
               CASE s_suppkey % 3 WHEN 0 THEN 'trino' WHEN 1 THEN 'kafka' ELSE 'hdfs' END AS product,
               'obj-' || CAST(s_suppkey AS STRING) AS owner, s_suppkey AS pos,
               CASE WHEN s_suppkey % 4 = 0 THEN 'other'
                    ELSE 'listener-obj-' || CAST(s_suppkey AS STRING) || '-default' END AS name,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '10.2.0.' || CAST(s_suppkey AS STRING) END
               AS address
        FROM {supplier}""",
    "v_node": """
        SELECT s_nationkey AS cluster, CAST(s_suppkey % 5 AS INT) AS zone,
               'node-' || CAST(s_suppkey AS STRING) AS name, s_suppkey AS pos,
               CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS taint_count,
               CASE WHEN s_suppkey % 97 = 5 THEN 'two'
                    ELSE CASE s_suppkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '1500m' ELSE '0.5' END END AS cpu,
               CASE s_suppkey % 3 WHEN 0 THEN '4Gi' WHEN 1 THEN '512Mi' ELSE '1000000Ki' END AS memory,
               CASE s_suppkey % 6 WHEN 0 THEN 'kind://x' WHEN 1 THEN 'k3s://x' WHEN 2 THEN 'ionos://x'
                    WHEN 3 THEN 'aws://x' END AS provider_id,
               CASE WHEN s_suppkey % 6 = 4 THEN 'v1' END AS minikube,
               CASE s_suppkey % 5 WHEN 0 THEN NULL ELSE 'in-' || CAST(s_suppkey AS STRING) END AS internal,
               CASE WHEN s_suppkey % 2 = 0 THEN 'out-' || CAST(s_suppkey AS STRING) END AS external
        FROM {supplier}""",
    "v_request": """
        SELECT p_partkey AS spec, CAST(p_partkey % 25 AS INT) AS cluster,
               CASE WHEN p_partkey % 50 = 7 THEN 'lots' ELSE CAST(p_size * 100 AS STRING) || 'm' END AS cpu,
               CAST(p_size AS STRING) || 'Gi' AS memory
        FROM {part}""",
    "v_condition": """
        SELECT CAST(o_custkey % 25 AS INT) AS cluster, o_custkey AS stacklet, o_orderkey AS ord,
               CASE WHEN o_orderkey % 4 = 0 THEN 'deployment' ELSE 'cluster' END AS kind,
               CASE o_orderkey % 3 WHEN 0 THEN 'Available' WHEN 1 THEN 'Stopped' ELSE 'Degraded' END AS type,
               CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'False' ELSE 'Unknown' END AS status,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS message
        FROM {orders}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _expand(sql: str) -> str:
    """Replace view names by their SQL until only tables are left."""
    return _NAME.sub(
        lambda m: f"({_expand(VIEWS[m[1]])})" if m[1] in VIEWS else m[0], sql
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run view SQL on Spark."""
    text = _expand(sql)
    used = {n: table(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, VIEWS[name])


def plain(sql: str) -> str:
    """The same SQL with bare table names, as an outside engine runs it."""
    return _NAME.sub(lambda m: m[1], _expand(sql))
