"""Queries applying time-to-live rules to logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ttl as T
from .views import query, table

DAY = 86400


def ttl_status(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("ts"))
    entries = table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 2).alias("key"), F.col("o_orderdate").alias("modified"))
    rows = T.ttl_status(requests, entries, 400 * DAY).rows
    status = F.when(F.col("error").isNull(), F.col("status")).alias("status")
    return rows.select("key", "l_linenumber", "l_partkey", "l_suppkey", status, "error")


def ttl_asof(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("ts"))
    entries = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("modified"))
    out = T.ttl_status_asof(requests, entries, 60 * DAY)
    return out.select("key", "l_orderkey", "l_linenumber", "l_partkey",
                      F.unix_seconds("stored_at").alias("stored_at"), "status")


def ttl_replay(spark, sf):
    log = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return T.ttl_replay(log, ["user_id"], "ts", DAY, ["event_id"]).select("event_id", "user_id", "status")


def interval_gate(spark, sf):
    log = table(spark, sf, "events").select("event_id", "event_type", "ts")
    out = T.interval_gate(log, ["event_type"], "ts", 900, ["event_id"])
    return out.select("event_id", "event_type", F.col("passed").cast("int").alias("passed"))


def _entries(spark, sf):
    name = F.when(F.col("o_orderkey") % 50 == 0, ".cache-last-purge").otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"), F.col("o_orderdate").alias("modified"))


def now():
    return F.unix_micros(F.expr("timestamp'1999-01-01 00:00:00 UTC'"))


def expired_entries(spark, sf):
    # One pass: what a purge of all removes, and of these what is expired as well.
    old = T.is_expired(F.unix_micros(F.col("modified").cast("timestamp")), now(), 300 * DAY)
    modes = F.when(old, F.array(F.lit("all"), F.lit("expired"))).otherwise(F.array(F.lit("all")))
    return T.select_expired(_entries(spark, sf), now(), 300 * DAY, "all").select(
        "o_orderkey", F.explode(modes).alias("mode"))


def entry_ages(spark, sf):
    return T.entry_ages(_entries(spark, sf), now()).select("o_orderkey", "age_seconds")


VISITS = "SELECT CAST(l_suppkey % 25 AS INT) AS cluster, l_shipdate AS ts FROM {lineitem}"
STORED = """
    SELECT o_orderkey, CAST(o_custkey % 25 AS INT) AS cluster, o_orderdate AS modified,
           CASE WHEN o_orderkey % 50 = 0 THEN '.cache-last-purge' ELSE 'c' || CAST(o_custkey AS STRING) END AS name FROM {orders}"""


def purge_replay(spark, sf):
    out = T.purge_replay(query(spark, sf, VISITS), query(spark, sf, STORED), 30 * DAY, 90 * DAY, entry_order=["o_orderkey"])
    return out.select("o_orderkey", "cluster", "name", F.unix_seconds("removed_at").alias("removed_at"), "fate")


QUERIES = {
    "purge_replay": purge_replay,
    "ttl_status": ttl_status, "ttl_asof": ttl_asof, "ttl_replay": ttl_replay,
    "interval_gate": interval_gate, "expired_entries": expired_entries, "entry_ages": entry_ages,
}


def _replay(key: str, due: str, out: str) -> str:
    """Walk each key's sorted log, carrying the anchor from row to row."""
    return f"""
        WITH RECURSIVE log AS (
          SELECT event_id, {key} AS key, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn
          FROM {{events}}),
        walk AS (
          SELECT event_id, key, rn, ts AS anchor, 'Miss' AS status FROM log WHERE rn = 1
          UNION ALL
          SELECT l.event_id, l.key, l.rn, CASE WHEN {due} THEN l.ts ELSE w.anchor END,
                 CASE WHEN {due} THEN 'Expired' ELSE 'Hit' END
          FROM walk w JOIN log l ON l.key = w.key AND l.rn = w.rn + 1)
        SELECT event_id, key AS {key}, {out} FROM walk"""


ORACLE = {
    "purge_replay": f"""
        WITH RECURSIVE days AS (
          SELECT cluster, ts, row_number() OVER (PARTITION BY cluster ORDER BY ts) AS rn FROM (SELECT DISTINCT cluster, ts FROM ({VISITS}))),
        walk AS (
          SELECT cluster, rn, ts AS anchor, true AS passed FROM days WHERE rn = 1
          UNION ALL
          SELECT d.cluster, d.rn, CASE WHEN d.ts - w.anchor >= INTERVAL 30 DAY THEN d.ts ELSE w.anchor END, d.ts - w.anchor >= INTERVAL 30 DAY
          FROM walk w JOIN days d ON d.cluster = w.cluster AND d.rn = w.rn + 1),
        passes AS (SELECT cluster, anchor AS day FROM walk WHERE passed),
        stored AS (SELECT *, modified + INTERVAL 90 DAY AS due, lead(modified) OVER (PARTITION BY cluster, name ORDER BY modified, o_orderkey) AS again FROM ({STORED})),
        found AS (
          SELECT s.*, CASE WHEN name <> '.cache-last-purge' AND (again IS NULL OR p.day <= again) THEN p.day END AS removed
          FROM stored s ASOF LEFT JOIN passes p ON s.cluster = p.cluster AND s.due < p.day)
        SELECT o_orderkey, cluster, name, CAST(epoch(removed) AS BIGINT) AS removed_at,
               CASE WHEN removed IS NOT NULL THEN 'removed' WHEN again IS NOT NULL THEN 'replaced' ELSE 'kept' END AS fate FROM found""",
    "ttl_status": """
        SELECT l_orderkey AS key, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN o_orderkey IS NULL THEN 'Miss' WHEN l_shipdate < o_orderdate THEN NULL
                    WHEN l_shipdate - o_orderdate > INTERVAL 400 DAY THEN 'Expired' ELSE 'Hit' END AS status,
               CASE WHEN l_shipdate < o_orderdate THEN 'FutureTimestamp' END AS error
        FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey * 2""",
    "ttl_asof": """
        WITH e AS (SELECT DISTINCT o_custkey AS key, o_orderdate AS modified FROM {orders})
        SELECT l_suppkey AS key, l_orderkey, l_linenumber, l_partkey,
               CAST(epoch(e.modified) AS BIGINT) AS stored_at,
               CASE WHEN e.modified IS NULL THEN 'Miss'
                    WHEN l_shipdate - e.modified > INTERVAL 60 DAY THEN 'Expired' ELSE 'Hit' END AS status
        FROM {lineitem} l ASOF LEFT JOIN e ON l.l_suppkey = e.key AND l.l_shipdate >= e.modified""",
    "ttl_replay": _replay("user_id", "l.ts - w.anchor > INTERVAL 1 DAY", "status"),
    "interval_gate": _replay(
        "event_type", "l.ts - w.anchor >= INTERVAL 15 MINUTE",
        "CASE WHEN status = 'Hit' THEN 0 ELSE 1 END AS passed"),
    "expired_entries": """
        WITH e AS (SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderkey % 50 <> 0)
        SELECT o_orderkey, 'all' AS mode FROM e
        UNION ALL SELECT o_orderkey, 'expired' FROM e
        WHERE TIMESTAMP '1999-01-01' - o_orderdate > INTERVAL 300 DAY""",
    "entry_ages": """
        SELECT o_orderkey, greatest(0, CAST(epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate) AS BIGINT)) AS age_seconds
        FROM {orders} WHERE o_orderkey % 50 <> 0""",
}
