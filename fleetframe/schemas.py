"""Row types of the fleet tables and the constant dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Every cluster-scoped table carries these two columns; operators take them as ``scope``.
SCOPE = ("cluster_id", "snapshot_ts")

# --- fixed values -------------------------------------------------------------------
CHANNELS = ("stable", "test", "dev")
DEFAULT_CHART_VERSION = "0.0.0-dev"
DEFAULT_NAMESPACE = "default"
DEFAULT_MAX_AGE_SECONDS = 3600
DEFAULT_PURGE_INTERVAL_SECONDS = 900
PROTECTED_ENTRIES = (".cache-last-purge",)
ARTIFACT_PAGE_SIZE = 20
REPOSITORY_PAGE_SIZE = 100

OPERATORS = (
    "airflow", "commons", "druid", "hbase", "hdfs", "hello-world", "hive", "kafka",
    "listener", "nifi", "opa", "opensearch", "secret", "spark-k8s", "superset", "trino",
    "zookeeper",
)

# (product, API group without the vendor domain, version, kind)
PRODUCTS = (
    ("airflow", "airflow", "v1alpha1", "AirflowCluster"),
    ("druid", "druid", "v1alpha1", "DruidCluster"),
    ("hbase", "hbase", "v1alpha1", "HbaseCluster"),
    ("hdfs", "hdfs", "v1alpha1", "HdfsCluster"),
    ("hive", "hive", "v1alpha1", "HiveCluster"),
    ("kafka", "kafka", "v1alpha1", "KafkaCluster"),
    ("nifi", "nifi", "v1alpha1", "NifiCluster"),
    ("opa", "opa", "v1alpha1", "OpaCluster"),
    ("opensearch", "opensearch", "v1alpha1", "OpenSearchCluster"),
    ("spark-connect", "spark", "v1alpha1", "SparkConnectServer"),
    ("spark-history", "spark", "v1alpha1", "SparkHistoryServer"),
    ("superset", "superset", "v1alpha1", "SupersetCluster"),
    ("trino", "trino", "v1alpha1", "TrinoCluster"),
    ("zookeeper", "zookeeper", "v1alpha1", "ZookeeperCluster"),
)

LABEL_NAME = "app.kubernetes.io/name"
LABEL_APP = "app.kubernetes.io/app"
LABEL_INSTANCE = "app.kubernetes.io/instance"
# -------------------------------------------------------------------------------------


def _constant(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal relation: its size is known to the planner, so it is broadcast."""
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def operator_names(spark: SparkSession, names=OPERATORS) -> DataFrame:
    """(operator, pos) dimension in catalog order."""
    return _constant(spark, [(n, i) for i, n in enumerate(names)], "operator, pos")


def product_kinds(spark: SparkSession, domain: str, products=PRODUCTS) -> DataFrame:
    """(product, product_ord, group, version, kind) dimension; groups end in ``domain``."""
    rows = [(p, i, f"{g}.{domain}", v, k) for i, (p, g, v, k) in enumerate(products)]
    return _constant(spark, rows, "product, product_ord, `group`, version, kind")


MANIFEST = "STRUCT<kind: STRING, location: STRING>"
PARAMETER = "STRUCT<name: STRING, description: STRING, default: STRING>"
RESOURCES = "STRUCT<memory: STRING, cpu: STRING, pvc: STRING>"
RAW_MANIFEST = "STRUCT<helmChart: STRING, plainYaml: STRING>"


def demo_spec(vendor: str) -> str:
    """DDL of one raw demo spec; the stack reference field is ``<vendor>Stack``."""
    return (
        "description STRING, documentation STRING, supportedNamespaces ARRAY<STRING>, "
        f"`{vendor}Stack` STRING, labels ARRAY<STRING>, manifests ARRAY<{RAW_MANIFEST}>, "
        f"resourceRequests {RESOURCES}, parameters ARRAY<{PARAMETER}>"
    )


def stack_spec(vendor: str) -> str:
    """DDL of one raw stack spec; fields ``<vendor>Release`` and ``<vendor>Operators``."""
    return (
        f"description STRING, `{vendor}Release` STRING, supportedNamespaces ARRAY<STRING>, "
        f"`{vendor}Operators` ARRAY<STRING>, labels ARRAY<STRING>, "
        f"manifests ARRAY<{RAW_MANIFEST}>, resourceRequests {RESOURCES}, "
        f"parameters ARRAY<{PARAMETER}>"
    )


RELEASE_SPEC = (
    "releaseDate STRING, description STRING, "
    "products MAP<STRING, STRUCT<operatorVersion: STRING>>"
)
CHART_FILE = (
    "releaseName STRING, name STRING, repo STRUCT<name: STRING, url: STRING>, "
    "version STRING, options STRING"
)
CHART_INDEX = "entries MAP<STRING, ARRAY<STRUCT<name: STRING, version: STRING>>>"
ARTIFACT_PAGE = "ARRAY<STRUCT<digest: STRING, tags: ARRAY<STRUCT<name: STRING>>>>"
HELM_RELEASE = (
    "name STRING, version STRING, namespace STRING, status STRING, lastUpdated STRING"
)
CONDITIONS = (
    "ARRAY<STRUCT<type: STRING, status: STRING, message: STRING>>"
)
