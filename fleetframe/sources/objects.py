"""Exported cluster objects and Helm releases.

Exports are JSON lines under ``kind=<Kind>/cluster_id=<id>/snapshot_date=<date>/``, one
object per line with the listing position ``pos`` and the export time ``snapshot_ts``
beside the usual Kubernetes fields. Kind, cluster and date prune folders before any file
is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import Split, split
from ..functions.maps import label
from ..operators.state import api_group, api_version_part
from ..schemas import HELM_RELEASE, LABEL_APP, LABEL_INSTANCE, LABEL_NAME

_META = (
    "STRUCT<name: STRING, namespace: STRING, labels: MAP<STRING, STRING>, resourceVersion: STRING>"
)
_FOLDERS = ("kind", "cluster_id", "snapshot_date")
_HEAD = f"snapshot_ts TIMESTAMP, pos INT, apiVersion STRING, metadata {_META}"
_BODY = {
    "Service": (
        "spec STRUCT<type: STRING, ports: ARRAY<STRUCT<name: STRING, port: INT, nodePort: INT>>>, "
        "status STRUCT<loadBalancer: STRUCT<ingress: ARRAY<STRUCT<hostname: STRING, ip: STRING>>>>"
    ),
    "Listener": (
        "status STRUCT<ingressAddresses: "
        "ARRAY<STRUCT<address: STRING, ports: MAP<STRING, INT>>>>"
    ),
    "Endpoints": "subsets ARRAY<STRUCT<addresses: ARRAY<STRUCT<nodeName: STRING>>>>",
    "Node": (
        "spec STRUCT<taints: ARRAY<STRUCT<key: STRING>>, providerID: STRING>, "
        "status STRUCT<allocatable: MAP<STRING, STRING>, "
        "addresses: ARRAY<STRUCT<type: STRING, address: STRING>>>"
    ),
    "Deployment": "status STRUCT<conditions: ARRAY<STRUCT<type: STRING, status: STRING, message: STRING>>>",
    "StatefulSet": "status STRUCT<conditions: ARRAY<STRUCT<type: STRING, status: STRING, message: STRING>>>",
}


def _ports_of_listener():
    return F.transform(
        "status.ingressAddresses",
        lambda a: F.struct(
            a["address"].alias("address"),
            F.transform(F.map_entries(a["ports"]),
                        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("port")))
            .alias("ports"),
        ),
    )


def _columns(kind: str) -> list:
    if kind == "Service":
        return [
            F.col("spec.type").alias("type"),
            F.transform("spec.ports", lambda p: F.struct(
                p["name"].alias("name"), p["port"].alias("port"), p["nodePort"].alias("node_port")
            )).alias("ports"),
            F.col("status.loadBalancer.ingress").alias("ingress"),
        ]
    if kind == "Listener":
        return [_ports_of_listener().alias("ingress_addresses")]
    if kind == "Endpoints":
        return [F.transform("subsets", lambda s: F.struct(
            F.transform(s["addresses"], lambda a: F.struct(a["nodeName"].alias("node_name")))
            .alias("addresses")
        )).alias("subsets")]
    if kind == "Node":
        return [
            F.transform("spec.taints", lambda t: t["key"]).alias("taints"),
            F.col("spec.providerID").alias("provider_id"),
            F.col("status.allocatable").alias("allocatable"),
            F.col("status.addresses").alias("addresses"),
        ]
    return [F.col("status.conditions").alias("conditions")]


_CORRUPT = "_corrupt"


def _lines(reader, path: str, folders: Sequence[str], schema: str) -> DataFrame:
    """JSON lines below ``folders`` with the text of those that cannot be read and where they stand.

    Lines are parsed by an expression that always reads the whole schema, so a line is good or bad
    whichever columns are asked for.
    """
    lines = reader.schema(", ".join(["value STRING", *[f"{c} STRING" for c in folders]])).text(path)
    parsed = F.from_json("value", f"{schema}, {_CORRUPT} STRING", {"columnNameOfCorruptRecord": _CORRUPT})
    return lines.filter(F.trim("value") != "").select(
        *folders, parsed.alias("_line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
    ).select(*folders, "_line.*", "file", "block_start").withColumn("error", F.when(F.col(_CORRUPT).isNotNull(), "ParseLine"))


def _checked(rows: DataFrame, keep: Sequence[str], on_error: str) -> Split:
    """Good lines, and the rejected ones as (keep, file, block_start, line, error)."""
    good, rejects = split(rows, "error", on_error)
    return Split.of(
        good.drop("file", "block_start", _CORRUPT),
        rejects.select(*keep, "file", "block_start", F.col(_CORRUPT).alias("line"), "error"), rows)


def read_objects(
    spark: SparkSession, path: str, kind: str, clusters: Sequence[str] | None = None,
    namespace: str | None = None, streaming: bool = False,
) -> DataFrame:
    """Objects of one kind from an export; all namespaces unless one is given.

    Known kinds come with typed columns. Any other kind (custom resources) comes with its
    status as a JSON ``body``; a kind that was never exported yields no rows. A line that is no JSON
    of that shape is left out here; :func:`read_objects_checked` reports or refuses it.
    """
    reader = spark.readStream if streaming else spark.read
    return read_lines(reader, path, kind, clusters, namespace).good


def read_objects_checked(
    spark: SparkSession, path: str, kind: str, clusters: Sequence[str] | None = None,
    namespace: str | None = None, on_error: str = "quarantine",
) -> Split:
    """:func:`read_objects` with the lines it cannot read: cluster and date of the folder, file, start of
    the file block that holds the line, its text. ``fail`` ends the job at the first one."""
    return read_lines(spark.read, path, kind, clusters, namespace, on_error)


def read_lines(reader, path, kind, clusters=None, namespace=None, on_error="quarantine") -> Split:
    checked = _checked(
        _lines(reader, path, _FOLDERS, f"{_HEAD}, {_BODY.get(kind, 'status STRING')}").filter(F.col("kind") == kind),
        ["cluster_id", "snapshot_date"], on_error)
    rejects = checked.rejects
    if clusters is not None:
        rejects = rejects.filter(F.col("cluster_id").isin(*clusters))
    return Split(_objects(checked.good, kind, clusters, namespace), rejects)


def _objects(rows: DataFrame, kind: str, clusters: Sequence[str] | None, namespace: str | None) -> DataFrame:
    typed = kind in _BODY
    if clusters is not None:
        rows = rows.filter(F.col("cluster_id").isin(*clusters))
    if namespace is not None:
        rows = rows.filter(F.col("metadata.namespace") == namespace)
    labels = F.col("metadata.labels")
    head = [
        "cluster_id", "snapshot_ts", "pos", F.col("metadata.name").alias("name"),
        F.col("metadata.namespace").alias("namespace"), labels.alias("labels"),
        label(labels, LABEL_NAME).alias("product"), label(labels, LABEL_INSTANCE).alias("owner"),
        label(labels, LABEL_APP).alias("app"),
        F.col("metadata.resourceVersion").alias("resource_version"),
    ]
    if typed:
        return rows.select(*head, *_columns(kind))
    status = F.concat(F.lit('{"status":'), F.coalesce("status", F.lit("null")), F.lit("}"))
    return rows.select(
        *head, F.col("apiVersion").alias("api_version"), "kind",
        api_group(F.col("apiVersion")).alias("group"),
        api_version_part(F.col("apiVersion")).alias("version"), status.alias("body"),
    )


def read_releases(
    spark: SparkSession, path: str, clusters: Sequence[str] | None = None
) -> DataFrame:
    """Exported Helm releases in every state, partitioned by ``cluster_id``.

    The update time stays text; ``updated_at`` is its parsed form where it has one. A line that cannot be
    read is left out here; :func:`read_releases_checked` reports or refuses it.
    """
    return read_releases_checked(spark, path, clusters).good


def read_releases_checked(
    spark: SparkSession, path: str, clusters: Sequence[str] | None = None, on_error: str = "quarantine"
) -> Split:
    """:func:`read_releases` with the lines it cannot read, as in :func:`read_objects_checked`."""
    rows = _lines(spark.read, path, ["cluster_id"], f"snapshot_ts TIMESTAMP, pos INT, {HELM_RELEASE}")
    if clusters is not None:
        rows = rows.filter(F.col("cluster_id").isin(*clusters))
    checked = _checked(rows, ["cluster_id"], on_error)
    good = checked.good.withColumnRenamed("lastUpdated", "last_updated").withColumn(
        "updated_at", F.try_to_timestamp(F.substring("last_updated", 1, 19))
    )
    return Split(good, checked.rejects)
