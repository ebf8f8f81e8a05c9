"""Queries that run a stream over files, stop it, and continue it from its checkpoint.

Each writes its table as files in two steps. The stream reads what is there and stops; after the second
step it is started anew with the same checkpoint, and reads only what is new. The result is that
of the batch form over the whole table.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions.maps import text_map
from ..schemas import LABEL_NAME
from ..sizing import shared_dir
from ..sources import objects as O
from ..streaming import overlay as V, ttl as T
from . import catalogs, ttls
from .views import table, view

NOW = {"availableNow": True}


@contextmanager
def _settings(spark, **values):
    """Session settings for the time of a run; a stream keeps those it started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _in_two_runs(spark, halves, write, start):
    """Folder of results after two runs of the stream that ``start(source, out, checkpoint)`` starts."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source, out, checkpoint = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))
    cores = str(spark.sparkContext.defaultParallelism)
    with _settings(spark, **{"spark.sql.streaming.stateStore.providerClass": T.ROCKSDB, "spark.sql.shuffle.partitions": cores}):
        for half in halves:
            write(half, source)
            start(source, out, checkpoint).awaitTermination()
    return out


def _at_middle(df, at):
    """Rows up to the middle of their times, and those after it."""
    middle = df.agg(F.percentile_approx(F.unix_micros(F.col(at).cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col(at).cast("timestamp")) <= middle
    return [df.filter(early), df.filter(~early)]


def _appended(make, schema):
    def start(spark, source, out, checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        return make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**NOW).start()

    return start


def _replayed(spark, log, make):
    start = _appended(make, log.schema)
    out = _in_two_runs(spark, _at_middle(log, "ts"), lambda half, path: half.write.mode("append").parquet(path), lambda *a: start(spark, *a))
    return spark.read.parquet(out)


def ttl_replay_stream(spark, sf):
    log = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = _replayed(spark, log, lambda s: T.ttl_replay_stream(s, ["user_id"], "ts", ttls.DAY, ["event_id"]))
    return out.select("event_id", "user_id", "status")


def interval_gate_stream(spark, sf):
    log = table(spark, sf, "events").select("event_id", "event_type", "ts")
    out = _replayed(spark, log, lambda s: T.interval_gate_stream(s, ["event_type"], "ts", 900, ["event_id"]))
    return out.select("event_id", "event_type", F.col("passed").cast("int").alias("passed"))


def overlay_stream(spark, sf):
    definitions = view(spark, sf, "v_def")
    odd = F.col("pos") % 2 == 1

    def start(source, out, checkpoint):
        stream = spark.readStream.schema(definitions.schema).parquet(source)
        return V.start_overlay(stream, out, checkpoint, **NOW)

    out = _in_two_runs(spark, [definitions.filter(odd), definitions.filter(~odd)],
                       lambda half, path: half.write.mode("append").parquet(path), start)
    return V.read_overlay(spark, out).select("name", "source_ord", "pos", "value")


def exported_services_stream(spark, sf):
    """Service objects of two exports, a day each, as they arrive."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    rows = table(spark, sf, "customer").select(
        F.lit("Service").alias("kind"), F.concat(F.lit("c"), text(key % 5)).alias("cluster_id"),
        F.when(key % 2 == 0, "2024-01-01").otherwise("2024-01-02").alias("snapshot_date"), key.cast("int").alias("pos"),
        F.struct(F.col("c_name").alias("name"), F.concat(F.lit("ns"), text(key % 3)).alias("namespace"),
                 text_map({LABEL_NAME: F.lower("c_mktsegment")}).alias("labels")).alias("metadata"),
        F.struct(F.lit("NodePort").alias("type"), F.array(F.struct(F.lit("http").alias("name"), (key % 1000).cast("int").alias("nodePort"))).alias("ports")).alias("spec"))

    def start(source, out, checkpoint):
        services = O.read_objects(spark, source, "Service", streaming=True).select(
            "cluster_id", "pos", "name", "namespace", "product", "type", F.get("ports", F.lit(0))["node_port"].alias("node_port"))
        return services.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**NOW).start()

    out = _in_two_runs(
        spark, [rows.filter(F.col("pos") % 2 == i) for i in range(2)],
        lambda half, path: half.write.mode("append").partitionBy("kind", "cluster_id", "snapshot_date").json(path), start)
    return spark.read.parquet(out)


QUERIES = {
    "ttl_replay_stream": ttl_replay_stream, "interval_gate_stream": interval_gate_stream, "overlay_stream": overlay_stream,
    "exported_services_stream": exported_services_stream,
}

ORACLE = {
    "ttl_replay_stream": ttls.ORACLE["ttl_replay"],
    "interval_gate_stream": ttls.ORACLE["interval_gate"],
    "overlay_stream": f"SELECT * EXCLUDE (row_no) FROM ({catalogs.ORACLE['overlay']})",
    "exported_services_stream": """
        SELECT 'c' || CAST(c_custkey % 5 AS STRING) AS cluster_id, CAST(c_custkey AS INT) AS pos, c_name AS name,
               'ns' || CAST(c_custkey % 3 AS STRING) AS namespace, lower(c_mktsegment) AS product, 'NodePort' AS type,
               CAST(c_custkey % 1000 AS INT) AS node_port FROM {customer}""",
}
