"""Queries comparing desired with installed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import label, text_map
from ..operators import state as S
from ..schemas import OPERATORS, operator_names
from .views import query, table, view

ON = ("cluster", "namespace", "release")


def installed(spark, sf):
    names = F.array(*[F.lit(n) for n in (*OPERATORS, "grafana", "loki", "other")])
    key = F.col("o_orderkey")
    releases = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster"), F.concat(F.lit("ns"), (key % 2).cast("string")).alias("namespace"),
        F.concat(F.get(names, (key % 20).cast("int")), F.lit("-operator")).alias("name"),
        F.concat((key % 6).cast("string"), F.lit(".0.0")).alias("version"), key.alias("pos"))
    return S.installed_operators(releases, operator_names(spark), ["cluster"])


def install_plan(spark, sf):
    wanted = view(spark, sf, "v_wanted").withColumn("mode", F.explode(F.array(F.lit("install"), F.lit("upsert"))))
    return S.install_plan(wanted, view(spark, sf, "v_installed"), F.col("mode"), ON)


def uninstall_plan(spark, sf):
    return S.uninstall_plan(view(spark, sf, "v_wanted"), view(spark, sf, "v_installed"), ON)


CRDS = "https://example.com/%1$s-operator/%2$s/deploy/helm/%1$s-operator/crds/crds.yaml"


def upgrade_steps(spark, sf):
    """The guarded upgrade of every cluster with its definition step."""
    plan = upgrade_plan(spark, sf).filter(F.col("variant") == "guarded").drop("variant")
    return S.definition_upgrades(plan, CRDS, ("cluster", "release", "product", "version"))


def upgrade_plan(spark, sf):
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("release"))
    names = F.array(*[F.lit(n) for n in OPERATORS])
    products = requests.select("release").distinct().select(
        "release", F.posexplode(names).alias("pos", "product")).select(
        "release", "product", F.concat(F.length("release").cast("string"), F.lit("."),
                                       F.col("pos").cast("string"), F.lit(".0")).alias("version"))
    # Nobody has zookeeper.
    charts = ["other" if n == "zookeeper" else n for n in OPERATORS] + ["grafana", "loki", "other"]
    chart = F.concat(F.get(F.array(*[F.lit(n) for n in charts]), (F.col("o_orderkey") % 20).cast("int")),
                     F.lit("-operator"))
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("cluster"), chart.alias("name"))
    variant = lambda name, inc, guard: F.struct(
        F.lit(name).alias("variant"), F.array(*[F.lit(n) for n in inc]).cast("array<string>").alias("inc"),
        F.lit(guard).alias("guard"))
    variants = F.array(variant("guarded", [], True), variant("open", [], False), variant("include", ["trino"], False))
    return S.upgrade_plan(
        requests.withColumn("_v", F.explode(variants)).select("cluster", "release", "_v.*"), products, have, OPERATORS,
        F.col("inc"), ["hive"], F.col("guard"), ["cluster"], ["variant"])


DESIRED = """
    SELECT c_custkey AS id, 'obj-' || CAST(c_custkey AS STRING) AS name,
           CASE c_custkey % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'apps/v1' WHEN 2 THEN 'rbac.example.com/v1' END
           AS api_version,
           CASE WHEN c_custkey % 21 = 0 THEN 'Widget' WHEN c_custkey % 4 = 0 THEN 'ConfigMap'
                WHEN c_custkey % 4 = 1 THEN 'Deployment' ELSE 'ClusterRole' END AS kind,
           'own' AS namespace FROM {customer}"""
ACTUAL = """
    SELECT 'obj-' || CAST(s_suppkey AS STRING) AS name,
           CASE s_suppkey % 4 WHEN 1 THEN 'apps' WHEN 2 THEN 'rbac.example.com' ELSE '' END AS "group",
           'v1' AS version,
           CASE s_suppkey % 4 WHEN 0 THEN 'ConfigMap' WHEN 1 THEN 'Deployment' ELSE 'ClusterRole' END AS kind,
           CASE WHEN s_suppkey % 4 = 2 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'elsewhere' ELSE 'target' END
           AS namespace,
           CAST(s_suppkey * 10 AS STRING) AS resource_version FROM {supplier}"""


def resources(spark):
    return spark.sql("""
        SELECT * FROM VALUES ('', 'v1', 'ConfigMap', 'Namespaced', array('list', 'get')),
          ('apps', 'v1', 'Deployment', 'Namespaced', array('list')),
          ('batch', 'v1', 'Job', 'Namespaced', array('get')),
          ('rbac.example.com', 'v1', 'ClusterRole', 'Cluster', array('list'))
        AS t(`group`, version, kind, scope, verbs)""")


def state_diff(spark, sf):
    rows = S.object_identity(query(spark, sf, DESIRED), resources(spark), F.lit("target")).rows
    actual = query(spark, sf, ACTUAL.replace('"group"', "`group`"))
    on = ("group", "version", "kind", "name")
    return S.diff_objects(rows, actual, "manifest", on).select(
        "id", "group", "kind", "namespace", F.coalesce("error", "action").alias("action"),
        F.when(F.col("error").isNull(), F.col("live_version")).alias("live_version"))


def crd_diff(spark, sf):
    desired = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("namespace"),
        F.concat(F.lit("crd-"), F.col("p_partkey").cast("string")).alias("name"))
    actual = table(spark, sf, "supplier").select(
        F.lit(None).cast("string").alias("namespace"),
        F.concat(F.lit("crd-"), (F.col("s_suppkey") * 3).cast("string")).alias("name"),
        F.col("s_suppkey").cast("string").alias("resource_version"))
    return S.diff_objects(desired, actual, "crd", ("name",)).select("id", "action", "live_version")


def label_overlay(spark, sf):
    key = F.col("c_custkey")
    objs = table(spark, sf, "customer").select(
        key.alias("id"), "c_custkey", "c_mktsegment",
        F.when(key % 3 == 0, text_map({"app": "a", "example.com/vendor": "old"}))
        .when(key % 3 == 1, text_map({"app": F.lower("c_mktsegment")})).alias("labels"))
    extra = S.demo_labels("example.com", "fleet", "Acme", F.concat(F.lit("d"), key.cast("string")),
                          F.lower("c_mktsegment"))
    out = S.add_labels(objs, extra)
    cell = lambda name, alias: label(F.col("labels"), name).alias(alias)
    return out.select("id", cell("app", "app"), cell("example.com/vendor", "vendor"),
                      cell("example.com/demo", "demo"), cell("example.com/stack", "stack"),
                      F.size("labels").alias("entries"))


def teardown(spark, sf):
    key = F.col("o_orderkey")
    kinds = F.array(*[F.struct(F.lit(g).alias("group"), F.lit("v1").alias("version"), F.lit(k).alias("kind"))
                      for g, k in (("", "ConfigMap"), ("apps", "Deployment"), ("batch", "Job"),
                                   ("rbac.example.com", "ClusterRole"))])
    kind = F.get(kinds, (key % 4).cast("int"))
    objs = table(spark, sf, "orders").select(
        key.alias("id"), kind["group"].alias("group"), kind["version"].alias("version"),
        kind["kind"].alias("kind"),
        F.when(key % 4 != 3, F.concat(F.lit("ns"), (key % 3).cast("string"))).alias("namespace"),
        text_map({"demo": F.col("o_orderpriority")}).alias("labels"))
    pick = lambda ns: S.select_by_label(objs, resources(spark), "demo", "1-URGENT", ns)
    return pick("ns1").unionByName(pick(None)).select("id", "kind", "namespace")


def group_suffix(spark, sf):
    crds = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("x")).otherwise(F.lit("")),
                 F.lower("p_type"), F.lit(".example.com")).alias("group"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"))
    return S.select_by_group_suffix(crds, "large.example.com")


GROUPS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END || lower(p_type) || '.example.com' AS grp,
                   CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM {part}"""
SUFFIXES = """SELECT right(lower(p_type), CAST(p_size % 9 AS INT)) || CASE WHEN p_size % 4 = 1 THEN '.example.org' ELSE '.example.com' END AS suffix
              FROM {part}"""


def group_suffix_table(spark, sf):
    crds = query(spark, sf, GROUPS).withColumnRenamed("grp", "group")
    return S.longest_group_suffix(crds, query(spark, sf, SUFFIXES), ["id"])


QUERIES = {
    "group_suffix_table": group_suffix_table,
    "installed": lambda s, d: installed(s, d), "install_plan": install_plan,
    "uninstall_plan": uninstall_plan, "upgrade_plan": upgrade_plan, "upgrade_steps": upgrade_steps, "state_diff": state_diff,
    "crd_diff": crd_diff, "label_overlay": label_overlay, "teardown": teardown,
    "group_suffix": group_suffix,
}

_OPS20 = "[" + ", ".join(f"'{n}'" for n in (*OPERATORS, "grafana", "loki", "other")) + "]"
_OPS = "[" + ", ".join(f"'{n}'" for n in OPERATORS) + "]"
_HAVE = f"SELECT o_custkey AS cluster, {_OPS20}[o_orderkey % 20 + 1] AS product, o_orderkey FROM {{orders}}"

_UPGRADE = f"""
        WITH have AS (SELECT DISTINCT cluster, product FROM ({_HAVE})
                      WHERE product NOT IN ('grafana', 'loki', 'other', 'zookeeper')),
        ops AS (SELECT CAST(i AS INT) AS i, {_OPS}[i + 1] AS product FROM generate_series(0, {len(OPERATORS) - 1}) g(i)),
        rows AS (
          SELECT c_custkey AS cluster, c_mktsegment AS release, o.product,
                 CAST(length(c_mktsegment) AS STRING) || '.' || CAST(o.i AS STRING) || '.0' AS version,
                 h.product IS NOT NULL AS here,
                 c_custkey NOT IN (SELECT cluster FROM have) AS bare
          FROM {{customer}} CROSS JOIN ops o LEFT JOIN have h ON h.cluster = c_custkey AND h.product = o.product
          WHERE o.product <> 'hive')
        SELECT cluster, release, product, version, action, variant FROM rows,
             (VALUES ('uninstall'), ('install')) a(action), (VALUES ('guarded'), ('open'), ('include')) v(variant)
        WHERE here OR (action = 'install' AND variant = 'include' AND product = 'trino')
           OR (bare AND (variant = 'open' OR variant = 'include' AND action = 'uninstall'))"""

ORACLE = {
    "group_suffix_table": f"""
        SELECT id, grp AS "group", arg_max(suffix, length(suffix)) AS suffix
        FROM ({GROUPS}) JOIN (SELECT DISTINCT suffix FROM ({SUFFIXES})) ON ends_with(grp, suffix) WHERE name IS NOT NULL GROUP BY id, grp""",
    "installed": f"""
        SELECT cluster, 'ns' || CAST(o_orderkey % 2 AS STRING) AS namespace, product || '-operator' AS name,
               CAST(arg_max(o_orderkey % 6, o_orderkey) AS STRING) || '.0.0' AS version, min(o_orderkey) AS pos
        FROM ({_HAVE}) WHERE product NOT IN ('grafana', 'loki', 'other') GROUP BY 1, 2, 3""",
    "install_plan": """
        SELECT w.*, i.version AS current_version, mode,
               CASE WHEN i.version IS NULL THEN 'install' WHEN w.version IS NULL THEN 'skip_unspecified'
                    WHEN w.version = i.version THEN 'skip_same'
                    WHEN mode = 'install' THEN 'error_conflict' ELSE 'replace' END AS action,
               CASE WHEN i.version IS NULL THEN coalesce(w.version, '0.0.0-dev')
                    WHEN w.version <> i.version AND mode = 'upsert' THEN w.version END AS target_version
        FROM {v_wanted} w LEFT JOIN {v_installed} i USING (cluster, namespace, release),
             (VALUES ('install'), ('upsert')) m(mode)""",
    "uninstall_plan": """
        SELECT w.*, i.version AS current_version,
               CASE WHEN i.version IS NULL THEN 'not_installed' ELSE 'uninstall' END AS action
        FROM {v_wanted} w LEFT JOIN {v_installed} i USING (cluster, namespace, release)""",
    "upgrade_plan": _UPGRADE,
    "upgrade_steps": f"""
        SELECT cluster, release, product, version, s.action, CAST(s.step AS INT) AS step,
               CASE WHEN s.step = 1 THEN 'https://example.com/' || product || '-operator/' || version
                 || '/deploy/helm/' || product || '-operator/crds/crds.yaml' END AS url
        FROM ({_UPGRADE}) p JOIN (VALUES ('uninstall', 'uninstall', 0), ('install', 'upgrade_definitions', 1),
             ('install', 'install', 2)) s(of_action, action, step) ON p.action = s.of_action
        WHERE variant = 'guarded'""",
    "state_diff": f"""
        WITH d AS (SELECT *, CASE c_custkey % 4 WHEN 1 THEN 'apps' WHEN 2 THEN 'rbac.example.com'
                                  WHEN 0 THEN '' END AS grp,
                          CASE WHEN c_custkey % 4 IN (0, 1) THEN 'target' END AS ns
                   FROM (SELECT *, id AS c_custkey FROM ({DESIRED}))),
        e AS (SELECT *, CASE WHEN api_version IS NULL THEN 'ObjectType' WHEN kind = 'Widget' THEN 'UnknownKind'
                        END AS error FROM d)
        SELECT e.id, e.grp AS "group", e.kind, CASE WHEN error IS NULL THEN e.ns END AS namespace,
               CASE WHEN error IS NOT NULL THEN error WHEN a.name IS NOT NULL THEN 'patch_merge' ELSE 'apply' END AS action,
               a.resource_version AS live_version
        FROM e LEFT JOIN ({ACTUAL}) a ON error IS NULL AND a.name = e.name AND a.kind = e.kind
             AND a."group" = e.grp AND coalesce(a.namespace, '') = coalesce(e.ns, '')""",
    "crd_diff": """
        SELECT p_partkey AS id, CASE WHEN s_suppkey IS NULL THEN 'create' ELSE 'replace' END AS action,
               CAST(s_suppkey AS STRING) AS live_version
        FROM {part} LEFT JOIN {supplier} ON p_partkey = s_suppkey * 3""",
    "label_overlay": """
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN lower(c_mktsegment) END AS app,
               'Acme' AS vendor, 'd' || CAST(c_custkey AS STRING) AS demo, lower(c_mktsegment) AS stack,
               CASE WHEN c_custkey % 3 < 2 THEN 5 ELSE 4 END AS entries
        FROM {customer}""",
    "teardown": """
        SELECT o_orderkey AS id, ['ConfigMap', 'Deployment', 'Job', 'ClusterRole'][o_orderkey % 4 + 1] AS kind,
               CASE WHEN o_orderkey % 4 <> 3 THEN 'ns1' END AS namespace
        FROM {orders} WHERE o_orderpriority = '1-URGENT'
          AND (o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 = 1 OR o_orderkey % 4 = 3)""",
    "group_suffix": """
        SELECT * FROM (
          SELECT p_partkey AS id,
                 CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END || lower(p_type) || '.example.com' AS "group",
                 CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM {part})
        WHERE "group" LIKE '%large.example.com' AND name IS NOT NULL""",
}
QUERIES["installed"] = installed
