"""Queries over cluster capacity and environments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import text_map
from ..functions.quantity import cpu_millis, memory_bytes, quantity_error
from ..operators import capacity as P
from .views import query, table, view

SCOPE = ("cluster",)


def nodes(spark, sf):
    count = F.col("taint_count")
    taints = F.when(count.isNotNull(), F.array_repeat(F.lit("taint"), count))
    labels = F.when(F.col("minikube").isNotNull(), F.create_map(F.lit(P.MINIKUBE_LABEL), F.col("minikube")))
    return view(spark, sf, "v_node").select(
        "cluster", "name", "pos", taints.alias("taints"), "provider_id", labels.alias("labels"),
        text_map({"cpu": F.col("cpu"), "memory": F.col("memory")}).alias("allocatable"))


def capacity(spark, sf):
    total = P.cluster_capacity(nodes(spark, sf), SCOPE)
    return total.good.select(
        "cluster", "nodes", "untainted_nodes", F.col("cpu_millis").cast("bigint").alias("cpu_millis"),
        F.col("memory_bytes").cast("bigint").alias("memory_bytes"),
    ).unionByName(total.rejects.select("cluster", "name", "error"), allowMissingColumns=True)


def capacity_check(spark, sf):
    requests = view(spark, sf, "v_request").select("spec", "cluster", "cpu", "memory")
    rows = P.checked_capacity(requests, P.cluster_capacity(nodes(spark, sf), SCOPE).good, SCOPE)
    return rows.select(
        "spec", "cluster", F.coalesce("error", "violation").alias("violation"),
        F.col("required").cast("bigint").alias("required"), F.col("available").cast("bigint").alias("available"))


def environment(spark, sf):
    env = P.guess_environment(nodes(spark, sf), SCOPE)
    return env.withColumn("preset", P.listener_preset(F.col("environment"))).withColumn(
        "forced", P.listener_preset(F.col("environment"), F.when(F.col("cluster") % 2 == 0, "none")))


UNITS = ("", "m", "k", "M", "G", "Ki", "Mi", "Gi", "e3", "x")


def quantities(spark, sf):
    key = F.col("p_partkey")
    units = F.array(*[F.lit(u) for u in UNITS])
    text = F.concat((key % 1000).cast("string"), F.get(units, (F.col("p_size") % 10).cast("int")))
    return table(spark, sf, "part").select(
        key.alias("id"), text.alias("text"), cpu_millis(text).cast("bigint").alias("cpu_millis"),
        (memory_bytes(text) * 1000).cast("bigint").alias("memory_milli"))


# Long quantities: digits around the sizes that cluster exports print, and far beyond.
WIDE = (("", 0, 27), ("m", 0, 28), ("u", 0, 30), ("n", 0, 30), ("Pi", 0, 16), ("Ki", 3, 20), ("", 3, 16))


def quantities_wide(spark, sf):
    """Quantities of 16 to 30 digits, with fractions, in every small form and with exponents, exactly; too large and malformed ones."""
    key = F.col("p_partkey")
    digits = lambda n: F.concat((key % 9 + 1).cast("string"), F.lpad((key * 7919).cast("string"), n - 1, "0"))
    texts = F.array(*[
        F.concat(digits(n), F.lit("." if places else ""), F.lpad((key % 1000).cast("string"), places, "0")
                 if places else F.lit(""), F.lit(unit)) for unit, places, n in WIDE])
    digit = (key % 9 + 1).cast("string")
    odd = F.array(F.concat(digit, F.lit("e30")), F.concat(digit, F.lit("5e-1")),
                  *[F.concat(F.repeat(digit, F.lit(20)), F.lit(unit)) for unit in ("E", "Ei", "e17", "Xi")])
    rows = table(spark, sf, "part").select(key.alias("id"), F.explode(F.concat(texts, odd)).alias("text"))
    value = memory_bytes(F.col("text"))
    return rows.select("id", "text", value.cast("string").alias("value"), quantity_error(F.col("text"), value).alias("error"))


FLEET = """
    SELECT c_custkey AS cluster, c_custkey * 37 % 997 * 100 AS cpu_millis, c_custkey * 91 % 1009 * 67108864 AS memory_bytes
    FROM {customer}"""


def fitting_clusters(spark, sf):
    """Where each request would fit, among clusters as many as customers."""
    fleet = query(spark, sf, FLEET).withColumns({c: F.col(c).cast("decimal(38,3)") for c in ("cpu_millis", "memory_bytes")})
    requests = view(spark, sf, "v_request").select("spec", "cpu", "memory")
    return P.fitting_clusters(requests, fleet, SCOPE).select(
        "spec", "clusters", F.col("smallest.cluster").alias("smallest"), F.col("smallest_cpu").cast("bigint").alias("smallest_cpu"),
        F.col("smallest_memory").cast("bigint").alias("smallest_memory"), "error")


QUERIES = {
    "fitting_clusters": fitting_clusters,
    "quantities_wide": quantities_wide, "capacity": capacity, "capacity_check": capacity_check, "environment": environment,
    "quantities": quantities,
}

_CAPACITY = """
    SELECT cluster, count(*) AS nodes, count(*) FILTER (coalesce(taint_count, 0) = 0) AS untainted_nodes,
           CAST(coalesce(sum(CASE cpu WHEN '2' THEN 2000 WHEN '1500m' THEN 1500 ELSE 500 END)
                FILTER (coalesce(taint_count, 0) = 0), 0) AS BIGINT) AS cpu_millis,
           CAST(coalesce(sum(CASE memory WHEN '4Gi' THEN 4294967296 WHEN '512Mi' THEN 536870912
                ELSE 1024000000 END) FILTER (coalesce(taint_count, 0) = 0), 0) AS BIGINT) AS memory_bytes
    FROM {v_node} GROUP BY cluster
    HAVING count(*) FILTER (cpu = 'two' AND coalesce(taint_count, 0) = 0) = 0"""
_FACTORS = "CASE p_size % 10 WHEN 1 THEN 1 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 WHEN 4 THEN 1000000000000 " \
           "WHEN 5 THEN 1024000 WHEN 6 THEN 1048576000 WHEN 7 THEN 1073741824000 WHEN 8 THEN 1000000 WHEN 0 THEN 1000 END"

def _wide_sql():
    """Whole numbers of thousandths; quantities below a thousandth are rounded half up."""
    thousandths = {"": "v * 1000", "m": "v", "u": "(v + 500) // 1000", "n": "(v + 500000) // 1000000",
                   "Pi": "v * 1125899906842624000", "Ki": "v * 1024000"}
    parts = []
    for unit, places, n in WIDE:
        whole = f"CAST(p_partkey % 9 + 1 AS STRING) || left(lpad(CAST(p_partkey * 7919 AS STRING), {n - 1}, '0'), {n - 1})"
        after = f"lpad(CAST(p_partkey % 1000 AS STRING), {places}, '0')"
        value = {"Ki": "v * 1024", "": "v"}[unit] if places else thousandths[unit]
        parts.append(f"""
            SELECT id, text || '{unit}' AS text, {value} AS t FROM (
              SELECT p_partkey AS id, {whole} || {f"'.' || {after}" if places else "''"} AS text,
                     CAST({whole} || {after if places else "''"} AS HUGEINT) AS v FROM {{part}})""")
    return " UNION ALL ".join(parts)


ORACLE = {
    "fitting_clusters": f"""
        WITH f AS ({FLEET}),
        r AS (SELECT spec, CASE WHEN cpu <> 'lots' THEN CAST(replace(cpu, 'm', '') AS BIGINT) END AS cpu,
                     CAST(replace(memory, 'Gi', '') AS BIGINT) * 1073741824 AS mem FROM {{v_request}}),
        fits AS (SELECT spec, count(*) AS clusters, min(row(cpu_millis, memory_bytes, cluster)) AS least FROM r JOIN f
                 ON cpu_millis >= cpu AND memory_bytes >= mem GROUP BY spec)
        SELECT spec, CASE WHEN cpu IS NOT NULL THEN coalesce(clusters, 0) END AS clusters, least[3] AS smallest, least[1] AS smallest_cpu,
               least[2] AS smallest_memory, CASE WHEN cpu IS NULL THEN 'ParseCpuResourceRequirements' END AS error
        FROM r LEFT JOIN fits USING (spec)""",
    "quantities_wide": f"""
        SELECT id, text, CAST(t // 1000 AS STRING) || '.' || lpad(CAST(t % 1000 AS STRING), 3, '0') AS value, CAST(NULL AS VARCHAR) AS error
        FROM ({_wide_sql()})
        UNION ALL SELECT p_partkey, CAST(p_partkey % 9 + 1 AS STRING) || 'e30', CAST(p_partkey % 9 + 1 AS STRING) || repeat('0', 30) || '.000', NULL FROM {{part}}
        UNION ALL SELECT p_partkey, CAST(p_partkey % 9 + 1 AS STRING) || '5e-1', CAST(p_partkey % 9 + 1 AS STRING) || '.500', NULL FROM {{part}}
        UNION ALL SELECT p_partkey, repeat(CAST(p_partkey % 9 + 1 AS STRING), 20) || unit, NULL, error
        FROM {{part}}, (VALUES ('E', 'Overflow'), ('Ei', 'Overflow'), ('e17', 'Overflow'), ('Xi', 'Malformed')) u(unit, error)""",
    "capacity": f"""
        SELECT *, NULL AS name, NULL AS error FROM ({_CAPACITY})
        UNION ALL SELECT cluster, NULL, NULL, NULL, NULL, name, 'ParseNodeCpuQuantity' FROM {{v_node}}
        WHERE cpu = 'two' AND coalesce(taint_count, 0) = 0""",
    "capacity_check": f"""
        WITH r AS (SELECT spec, cluster, CASE WHEN cpu <> 'lots' THEN CAST(replace(cpu, 'm', '') AS BIGINT) END AS cpu,
                          CAST(replace(memory, 'Gi', '') AS BIGINT) * 1073741824 AS mem FROM {{v_request}}),
        c AS ({_CAPACITY})
        SELECT spec, cluster, 'InsufficientCpu' AS violation, cpu AS required, cpu_millis AS available
        FROM r JOIN c USING (cluster) WHERE cpu > cpu_millis
        UNION ALL
        SELECT spec, cluster, 'InsufficientMemory', mem, memory_bytes
        FROM r JOIN c USING (cluster) WHERE cpu IS NOT NULL AND mem > memory_bytes
        UNION ALL SELECT spec, cluster, 'ParseCpuResourceRequirements', NULL, NULL FROM r WHERE cpu IS NULL
        UNION ALL SELECT spec, cluster, 'UnknownCapacity', NULL, NULL FROM r ANTI JOIN c USING (cluster)
        WHERE cpu IS NOT NULL""",
    "environment": """
        WITH e AS (
          SELECT cluster, coalesce(arg_min(env, pos) FILTER (env IS NOT NULL), 'Unknown') AS environment FROM (
            SELECT cluster, pos, CASE WHEN starts_with(provider_id, 'kind://') THEN 'Kind'
                     WHEN starts_with(provider_id, 'k3s://') THEN 'K3s'
                     WHEN starts_with(provider_id, 'ionos://') THEN 'Ionos'
                     WHEN minikube IS NOT NULL THEN 'Minikube' END AS env FROM {v_node}) GROUP BY cluster),
        p AS (SELECT *, CASE WHEN environment IN ('Kind', 'Minikube', 'K3s') THEN 'stable-nodes'
                             ELSE 'ephemeral-nodes' END AS preset FROM e)
        SELECT *, CASE WHEN cluster % 2 = 0 THEN 'none' ELSE preset END AS forced FROM p""",
    "quantities": f"""
        SELECT p_partkey AS id,
               CAST(p_partkey % 1000 AS STRING)
               || ['', 'm', 'k', 'M', 'G', 'Ki', 'Mi', 'Gi', 'e3', 'x'][p_size % 10 + 1] AS text,
               p_partkey % 1000 * {_FACTORS} AS cpu_millis, p_partkey % 1000 * {_FACTORS} AS memory_milli
        FROM {{part}}""",
}
