"""Queries planning the installation of demos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import label
from ..operators import installs as I
from ..operators.capacity import cluster_capacity
from .capacities import _CAPACITY, nodes
from .states import resources
from .views import query

# Specs as plain rows; lists are built from these cells on both sides.
REQUESTS = """
    SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS cluster, 'ops' AS operator_namespace,
           CASE WHEN o_orderkey % 29 = 0 THEN 'nodemo' ELSE 'demo-' || CAST(o_orderkey % 200 AS STRING) END AS demo,
           CASE WHEN o_orderkey % 3 = 0 THEN 'default' ELSE 'ns' || CAST(o_orderkey % 4 AS STRING) END AS namespace,
           o_orderkey % 2 = 0 AS accepted, o_orderkey % 10 = 3 AS skip_release,
           CASE o_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'size=9' WHEN 2 THEN 'size=9 size=8' WHEN 3 THEN 'color=red'
             WHEN 4 THEN 'size' WHEN 5 THEN 'size=2 shape=1 x=2' ELSE 'size=4 color=blue' END AS stack_text,
           CASE o_orderkey % 13 WHEN 0 THEN '=1' WHEN 1 THEN 'size=7 a=b=c' WHEN 2 THEN 'tint=1' WHEN 3 THEN 'size='
             WHEN 4 THEN 'color=pink' ELSE '' END AS demo_text
    FROM {orders}"""
DEMOS = """
    SELECT 'demo-' || CAST(p_partkey AS STRING) AS name,
           CASE WHEN p_partkey % 17 = 0 THEN 'nostack' ELSE 'stack-' || CAST(p_partkey % 10 AS STRING) END AS stack,
           CASE p_partkey % 4 WHEN 1 THEN 'ns1 ns2 demo-' || CAST(p_partkey AS STRING) WHEN 2 THEN 'ns0 ns2 ns3 default' ELSE '' END AS allowed,
           CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 23 = 5 THEN 'lots' ELSE CAST(p_size * 100 AS STRING) || 'm' END AS cpu,
           CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS STRING) || 'Gi' END AS memory,
           CAST(p_size AS STRING) AS size,
           CASE WHEN p_partkey % 19 = 7 THEN 'Widget' ELSE 'Deployment' END AS kind
    FROM {part}"""
STACKS = """
    SELECT 'stack-' || CAST(s_suppkey AS STRING) AS name, s_suppkey AS no,
           CASE WHEN s_suppkey % 10 = 6 THEN 'r99' ELSE 'r' || CAST(s_nationkey AS STRING) END AS release,
           CASE WHEN s_suppkey % 10 = 2 THEN 'default ns1 ns2' ELSE '' END AS allowed,
           CASE WHEN s_suppkey % 3 = 0 THEN '2500m' END AS cpu, CASE WHEN s_suppkey % 3 = 0 THEN '5Gi' END AS memory
    FROM {supplier}"""
INSTALLED = """
    SELECT CAST(c_custkey % 250 AS INT) AS cluster, 'ops' AS operator_namespace,
           'p' || CAST(c_custkey % 97 AS STRING) || '-operator' AS release,
           CAST(min(c_custkey) % 10 AS STRING) || '.' || CAST(c_custkey % 97 AS STRING) || '.0' AS version
    FROM {customer} GROUP BY c_custkey % 250, c_custkey % 97"""
LIVE = """
    SELECT CAST(user_id % 25 AS INT) AS cluster, CASE WHEN event_id % 3 = 0 THEN 'apps' WHEN event_id % 3 = 1 THEN ''
             ELSE 'rbac.example.com' END AS grp,
           CASE WHEN event_id % 3 = 0 THEN 'Deployment' WHEN event_id % 3 = 1 THEN 'ConfigMap' ELSE 'ClusterRole' END AS kind,
           CASE WHEN event_id % 3 = 0 THEN 'app-demo-' || CAST(event_id % 200 AS STRING)
                WHEN event_id % 3 = 1 THEN 'cm-demo-' || CAST(event_id % 200 AS STRING)
                ELSE 'role-' || CAST(event_id % 10 AS STRING) END AS name,
           CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'ns' || CAST(user_id % 4 AS STRING) END AS namespace,
           CAST(max(event_id) AS STRING) AS resource_version
    FROM {events} GROUP BY 1, 2, 3, 4, 5"""


def _words(name):
    return F.filter(F.split(F.col(name), " "), lambda w: w != "")


def _parameters(size, color):
    cell = lambda name, default: F.struct(F.lit(name).alias("name"), default.alias("default"))
    return F.array(cell("size", size), cell("color", F.lit(color)))


def _manifests(*cells):
    return F.array(*[F.struct(F.lit(v).alias("api_version"), k.alias("kind"), n.alias("name")) for v, k, n in cells])


def demo_install_plan(spark, sf):
    requests = query(spark, sf, REQUESTS).withColumns(
        {"stack_parameters": _words("stack_text"), "parameters": _words("demo_text")}).drop("stack_text", "demo_text")
    demos = query(spark, sf, DEMOS).select(
        "name", "stack", _words("allowed").alias("supported_namespaces"), "cpu", "memory",
        _parameters(F.col("size"), "green").alias("parameters"),
        _manifests(("v1", F.lit("ConfigMap"), F.concat(F.lit("cm-"), "name")),
                   ("apps/v1", F.col("kind"), F.concat(F.lit("app-"), "name"))).alias("manifests"))
    no = F.col("no")
    product = lambda n: F.concat(F.lit("p"), n.cast("string"))
    stacks = query(spark, sf, STACKS).select(
        "name", "release", _words("allowed").alias("supported_namespaces"), "cpu", "memory",
        F.when(no % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(product(no % 5), product((no + 1) % 5))).alias("operators"),
        _parameters(F.lit("s"), "grey").alias("parameters"),
        _manifests(("rbac.example.com/v1", F.lit("ClusterRole"), F.concat(F.lit("role-"), no.cast("string")))).alias("manifests"))
    releases = query(spark, sf, "SELECT 'r' || CAST(n_nationkey AS STRING) AS name, n_nationkey AS no FROM {nation}").select(
        "name", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
            i.alias("pos"), product(i).alias("name"),
            F.concat((no % 10).cast("string"), F.lit("."), i.cast("string"), F.lit(".0")).alias("version"))).alias("products"))
    live = query(spark, sf, LIVE).withColumnRenamed("grp", "group").withColumn("version", F.lit("v1"))
    plan = I.demo_install_plan(
        requests, demos, stacks, releases, cluster_capacity(nodes(spark, sf), ["cluster"]).good, query(spark, sf, INSTALLED),
        resources(spark), live, "example.com", "fleet", "Acme", scope=["cluster"])
    cell = lambda name: label(F.col("labels"), f"example.com/{name}").alias(f"{name}_label")
    return plan.select("id", "cluster", "item", "stage", "ord", "name", "value", "action", "namespace", cell("demo"), cell("stack"),
                       F.coalesce(F.size("labels"), F.lit(0)).alias("labels"), "error", "detail")


QUERIES = {"demo_install_plan": demo_install_plan}

_BAD = ("CASE WHEN w IS NULL OR w = '' THEN 'EmptyInput' WHEN len(string_split(w, '=')) <> 2 THEN 'InvalidEqualSignCount' "
        "WHEN string_split(w, '=')[1] = '' THEN 'EmptyName' WHEN string_split(w, '=')[2] = '' THEN 'EmptyValue' END")


def _read(text: str, out: str) -> str:
    """Per request: first unreadable text, else first unknown name, and the last value given for each name."""
    return f"""
      {out}_words AS (SELECT id, unnest(string_split({text}, ' ')) AS w, generate_subscripts(string_split({text}, ' '), 1) AS nth FROM req WHERE {text} <> ''),
      {out}_read AS (SELECT id, nth, {_BAD} AS bad, string_split(w, '=')[1] AS name, string_split(w, '=')[2] AS value FROM {out}_words),
      {out} AS (SELECT id, arg_min(bad, nth) FILTER (bad IS NOT NULL) AS bad,
          arg_min(name, nth) FILTER (bad IS NULL AND name NOT IN ('size', 'color')) AS unknown,
          arg_max(value, nth) FILTER (bad IS NULL AND name = 'size') AS size, arg_max(value, nth) FILTER (bad IS NULL AND name = 'color') AS color
        FROM {out}_read GROUP BY id)"""


_NAMES = "'size, color'"
_NEED_CPU = "CASE WHEN {0}.cpu <> 'lots' THEN CAST(replace({0}.cpu, 'm', '') AS BIGINT) END"
_NEED_MEM = "CAST(replace({0}.memory, 'Gi', '') AS BIGINT) * 1073741824"


def _outside(spec: str) -> str:
    return f"({spec}.allowed <> '' AND NOT list_contains(string_split({spec}.allowed, ' '), target))"


def _warnings(stage: int, spec: str) -> str:
    cells = (("InsufficientCpu", _NEED_CPU.format(spec), "cpu_millis"), ("InsufficientMemory", _NEED_MEM.format(spec), "memory_bytes"))
    return " UNION ALL ".join(
        f"SELECT id, {stage}, {i}, 'warning', '{name}', CAST({need} AS STRING) || ' > ' || CAST({there} AS STRING), NULL, NULL "
        f"FROM whole WHERE {need} > {there}" for i, (name, need, there) in enumerate(cells))


def _shown(stage: int, out: str, size: str, color: str) -> str:
    cells = (("DEMO", "demo"), ("NAMESPACE", "target"), ("STACK", "whole.stack"), ("color", f"coalesce({out}.color, {color})"), ("size", f"coalesce({out}.size, {size})"))
    return " UNION ALL ".join(
        f"SELECT whole.id, {stage}, {i}, 'parameter', '{name}', {value}, NULL, NULL FROM whole LEFT JOIN {out} USING (id)" for i, (name, value) in enumerate(cells))


ORACLE = {
    "demo_install_plan": f"""
      WITH req AS ({REQUESTS}), demos AS ({DEMOS}), stacks AS ({STACKS}), capacity AS ({_CAPACITY}),
      installed AS ({INSTALLED}), live AS ({LIVE}), {_read('stack_text', 'sp')}, {_read('demo_text', 'dp')},
      whole AS MATERIALIZED (
        SELECT req.*, d, s, d.stack, s.release, k.cluster IS NOT NULL AS sized, k.cpu_millis, k.memory_bytes, n_nationkey, d.name IS NOT NULL AS has_demo,
          CASE WHEN req.namespace = 'default' AND accepted THEN req.demo ELSE req.namespace END AS target
        FROM req LEFT JOIN demos d ON d.name = req.demo LEFT JOIN stacks s ON s.name = d.stack
          LEFT JOIN {{nation}} ON 'r' || CAST(n_nationkey AS STRING) = s.release LEFT JOIN capacity k ON k.cluster = req.cluster),
      judged AS MATERIALIZED (
        SELECT whole.id, CASE
            WHEN d.name IS NULL THEN {{'stage': 1, 'error': 'NoSuchDemo', 'detail': demo}}
            WHEN s.name IS NULL THEN {{'stage': 2, 'error': 'NoSuchStack', 'detail': whole.stack}}
            WHEN {_outside('d')} THEN {{'stage': 3, 'error': 'UnsupportedNamespace', 'detail': replace(d.allowed, ' ', ', ')}}
            WHEN d.cpu IS NOT NULL AND NOT sized THEN {{'stage': 3, 'error': 'UnknownCapacity', 'detail': NULL}}
            WHEN d.cpu = 'lots' THEN {{'stage': 3, 'error': 'ParseCpuResourceRequirements', 'detail': d.cpu}}
            WHEN {_outside('s')} THEN {{'stage': 4, 'error': 'UnsupportedNamespace', 'detail': replace(s.allowed, ' ', ', ')}}
            WHEN s.cpu IS NOT NULL AND NOT sized THEN {{'stage': 4, 'error': 'UnknownCapacity', 'detail': NULL}}
            WHEN NOT skip_release AND n_nationkey IS NULL THEN {{'stage': 5, 'error': 'NoSuchRelease', 'detail': whole.release}}
            WHEN sp.bad IS NOT NULL THEN {{'stage': 6, 'error': sp.bad, 'detail': NULL}}
            WHEN sp.unknown IS NOT NULL THEN {{'stage': 6, 'error': 'InvalidParameter', 'detail': sp.unknown || ', expected ' || {_NAMES}}}
            WHEN dp.bad IS NOT NULL THEN {{'stage': 8, 'error': dp.bad, 'detail': NULL}}
            WHEN dp.unknown IS NOT NULL THEN {{'stage': 8, 'error': 'InvalidParameter', 'detail': dp.unknown || ', expected ' || {_NAMES}}}
          END AS failed
        FROM whole LEFT JOIN sp USING (id) LEFT JOIN dp USING (id)),
      steps(id, stage, ord, item, name, value, grp, kind) AS (
        SELECT id, 0, 0, 'request', demo, target, NULL, NULL FROM whole
        UNION ALL {_warnings(3, 'd')} UNION ALL {_warnings(4, 's')}
        UNION ALL SELECT id, 5, CAST(i AS INT), 'operator', 'p' || CAST(i AS STRING), CAST(n_nationkey % 10 AS STRING) || '.' || CAST(i AS STRING) || '.0', NULL, NULL
          FROM whole, generate_series(0, 4) g(i) WHERE NOT skip_release AND n_nationkey IS NOT NULL AND (s.no % 4 = 0 OR i IN (s.no % 5, (s.no + 1) % 5))
        UNION ALL {_shown(6, 'sp', "'s'", "'grey'")}
        UNION ALL SELECT id, 7, 0, 'manifest', 'role-' || CAST(s.no AS STRING), NULL, 'rbac.example.com', 'ClusterRole' FROM whole WHERE s.name IS NOT NULL
        UNION ALL {_shown(8, 'dp', 'd.size', "'green'")}
        UNION ALL SELECT id, 9, 0, 'manifest', 'cm-' || demo, NULL, '', 'ConfigMap' FROM whole
        UNION ALL SELECT id, 9, 1, 'manifest', 'app-' || demo, NULL, 'apps', d.kind FROM whole),
      looked AS (
        SELECT x.*, q.cluster, q.demo, q.stack, CASE WHEN x.kind IN ('ConfigMap', 'Deployment') THEN q.target END AS namespace, failed,
          CASE WHEN item = 'operator' THEN CASE WHEN i.version IS NULL THEN 'install' WHEN i.version = x.value THEN 'skip_same' ELSE 'error_conflict' END
               WHEN item = 'manifest' AND x.kind <> 'Widget' THEN CASE WHEN v.name IS NULL THEN 'apply' ELSE 'patch_merge' END END AS action,
          CASE WHEN item = 'operator' AND i.version <> x.value THEN 'OperatorConflict' WHEN x.kind = 'Widget' THEN 'UnknownKind' END AS error
        FROM steps x JOIN whole q USING (id) JOIN judged USING (id)
          LEFT JOIN installed i ON item = 'operator' AND i.cluster = q.cluster AND i.release = x.name || '-operator'
          LEFT JOIN live v ON item = 'manifest' AND v.cluster = q.cluster AND v.grp = x.grp AND v.kind = x.kind AND v.name = x.name
            AND coalesce(v.namespace, '') = CASE WHEN x.kind = 'ClusterRole' THEN '' ELSE q.target END
        WHERE failed IS NULL OR x.stage < failed.stage),
      firsts AS (
        SELECT *, min(CASE WHEN error IS NOT NULL THEN stage * 10 + ord END) OVER (PARTITION BY id) AS nth,
          arg_min(error, CASE WHEN error IS NOT NULL THEN stage * 10 + ord END) OVER (PARTITION BY id) AS first_error,
          arg_min(name, CASE WHEN error IS NOT NULL THEN stage * 10 + ord END) OVER (PARTITION BY id) AS first_name FROM looked),
      ended AS (SELECT *, coalesce(nth // 10, failed.stage) AS last FROM firsts)
      SELECT id, cluster, item, ['done', {', '.join(f"'{s}'" for s in I.STAGES)}][CASE WHEN item = 'request' THEN coalesce(last, 0) ELSE stage END + 1] AS stage,
        ord, name, CASE WHEN item = 'operator' AND action <> 'install' THEN NULL ELSE value END AS value,
        CASE WHEN item = 'request' THEN CASE WHEN last IS NULL THEN 'install' ELSE 'fail' END ELSE action END AS action, namespace,
        CASE WHEN item = 'manifest' THEN demo END AS demo_label, CASE WHEN item = 'manifest' AND stage = 7 THEN stack END AS stack_label,
        CASE WHEN item = 'manifest' THEN CASE WHEN stage = 7 THEN 4 ELSE 3 END ELSE 0 END AS labels,
        CASE WHEN item = 'request' THEN coalesce(first_error, failed.error) ELSE error END AS error,
        CASE WHEN item = 'request' THEN CASE WHEN nth IS NULL THEN failed.detail ELSE first_name END END AS detail
      FROM ended WHERE last IS NULL OR stage <= last""",
}
