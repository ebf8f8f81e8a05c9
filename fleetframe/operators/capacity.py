"""Cluster capacity, capacity checks and environment classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Split, split
from ..functions.maps import label
from ..functions.quantity import cpu_millis, memory_bytes, quantity_error
from ..schemas import SCOPE
from ..sizing import shared_table
from .asof import count_of, following, least_of
from .ordering import enumerate_rows

# --- fixed values ----------------------------------------------------------------------
PROVIDER_PREFIXES = (("kind://", "Kind"), ("k3s://", "K3s"), ("ionos://", "Ionos"))
MINIKUBE_LABEL = "minikube.k8s.io/version"
STABLE_ENVIRONMENTS = ("Kind", "Minikube", "K3s")
ROWS_PER_CHUNK = 250_000
# ---------------------------------------------------------------------------------------


def cluster_capacity(
    nodes: DataFrame, scope: Sequence[str] = SCOPE, on_error: str = "quarantine"
) -> Split:
    """Node counts and the allocatable CPU and memory of untainted nodes, per cluster.

    A missing quantity adds nothing. A malformed one is rejected as a node row and its
    cluster gets no total (``quarantine``), or fails the job (``fail``).
    """
    free = F.coalesce(F.size("taints") == 0, F.lit(True))
    cpu, memory = label(F.col("allocatable"), "cpu"), label(F.col("allocatable"), "memory")
    parsed = nodes.withColumns({
        "_free": F.when(F.col("taints").isNull(), F.lit(True)).otherwise(free),
        "_cpu": cpu_millis(cpu), "_mem": memory_bytes(memory),
    }).withColumn(
        "error",
        F.when(F.col("_free") & (quantity_error(cpu, F.col("_cpu")) == "Malformed"), "ParseNodeCpuQuantity")
        .when(F.col("_free") & (quantity_error(memory, F.col("_mem")) == "Malformed"),
              "ParseNodeMemoryQuantity")
        .when(F.col("_free") & (quantity_error(cpu, F.col("_cpu")) == "Overflow"), "NodeCpuOverflow")
        .when(F.col("_free") & (quantity_error(memory, F.col("_mem")) == "Overflow"), "NodeMemoryOverflow"),
    )
    if on_error == "fail":
        parsed = split(parsed.withColumn("_e", F.col("error")), "_e", "fail").good
    zero = F.lit(0).cast("decimal(38,3)")
    totals = parsed.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("_free").alias("untainted_nodes"),
        F.coalesce(F.sum(F.when(F.col("_free"), F.col("_cpu"))), zero).alias("cpu_millis"),
        F.coalesce(F.sum(F.when(F.col("_free"), F.col("_mem"))), zero).alias("memory_bytes"),
        F.count("error").alias("_bad"),
    )
    return Split(
        totals.filter(F.col("_bad") == 0).drop("_bad"),
        parsed.filter(F.col("error").isNotNull()).drop("_free", "_cpu", "_mem"),
    )


def check_capacity(
    requests: DataFrame, capacity: DataFrame, scope: Sequence[str] = SCOPE,
    on_error: str = "quarantine",
) -> Split:
    """All violations of requests (scope, spec, cpu, memory) against their cluster's capacity.

    A request violates only by needing strictly more. Storage is never checked. A cluster
    without a total (no nodes, or a bad one) rejects its requests as ``UnknownCapacity``.
    """
    return split(checked_capacity(requests, capacity, scope), "error", on_error)


def checked_capacity(
    requests: DataFrame, capacity: DataFrame, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """Violations and rejected requests in one pass; ``error`` tells them apart."""
    parsed = requests.withColumns(
        {"_cpu": cpu_millis(F.col("cpu")), "_mem": memory_bytes(F.col("memory"))}
    )
    totals = capacity.select(*scope, "cpu_millis", "memory_bytes")

    def violation(name, required, available):
        return F.when(
            F.col(required) > F.col(available),
            F.struct(F.lit(name).alias("violation"), F.col(required).alias("required"),
                     F.col(available).alias("available")),
        )

    found = F.filter(
        F.array(violation("InsufficientCpu", "_cpu", "cpu_millis"),
                violation("InsufficientMemory", "_mem", "memory_bytes")),
        lambda v: v.isNotNull(),
    )
    error = (
        F.when(F.col("_cpu").isNull(), "ParseCpuResourceRequirements")
        .when(F.col("_mem").isNull(), "ParseMemoryResourceRequirements")
        .when(F.col("cpu_millis").isNull(), "UnknownCapacity")
    )
    rows = parsed.join(totals, list(scope), "left").withColumn("error", error)
    # A rejected request keeps one row without a violation.
    kept = F.when(F.col("error").isNull(), found).otherwise(F.array(F.lit(None).cast(
        "struct<violation: string, required: decimal(38,3), available: decimal(38,3)>")))
    return rows.withColumn("_v", F.explode(kept)).select(*requests.columns, "_v.*", "error")


def fitting_clusters(
    requests: DataFrame, capacity: DataFrame, scope: Sequence[str] = SCOPE, rows_per_task: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """For each request (cpu, memory) the number and the smallest of the clusters that hold both.

    capacity has one row for each cluster: scope, cpu_millis, memory_bytes. The smallest is that of
    least CPU, then memory, then scope. A request that cannot be read keeps an ``error`` and no
    count. Clusters are numbered by CPU; those with enough of it are a suffix of the numbers, and a suffix
    is a few blocks of powers of two. A cluster lies in one block of each size, so in each block
    requests and clusters meet in order of memory: rows grow with the logarithm of the clusters,
    and no request is paired with a cluster.
    """
    scope = list(scope)
    known = capacity.filter(F.col("cpu_millis").isNotNull() & F.col("memory_bytes").isNotNull())
    # Numbered in the order in which the smallest is chosen, so that a number stands for its cluster below.
    sizes = shared_table(enumerate_rows(known.select(*scope, "cpu_millis", "memory_bytes"), ["cpu_millis", "memory_bytes", *scope], [], "_no"))
    levels = max(1, sizes.count().bit_length())
    size = F.struct(F.col("cpu_millis").alias("cpu"), F.col("memory_bytes").alias("memory"), F.struct(*scope).alias("cluster"))
    held = sizes.select((F.col("_no") - 1).alias("_no"), F.col("cpu_millis").alias("_cpu"), F.col("memory_bytes").alias("_mem"))
    parsed = shared_table(requests.withColumns({"_need_cpu": cpu_millis(F.col("cpu")), "_need_mem": memory_bytes(F.col("memory"))}).withColumn(
        "error", F.when(F.col("_need_cpu").isNull(), "ParseCpuResourceRequirements").when(F.col("_need_mem").isNull(), "ParseMemoryResourceRequirements")
    ).withColumn("_id", F.monotonically_increasing_id()))
    asked = parsed.filter(F.col("error").isNull()).select("_id", F.col("_need_cpu").alias("_cpu"), F.col("_need_mem").alias("_mem"))
    one = F.lit(0).alias("_one")
    by_cpu = held.select(one, "_cpu", "_no").unionByName(asked.select(one, "_cpu", "_id", "_mem"), allowMissingColumns=True)
    # Read several times below.
    first = shared_table(following(by_cpu, ["_one"], "_cpu", F.col("_no").isNotNull(), {"_first": least_of(F.col("_no"))}, rows_per_task).filter(
        F.col("_id").isNotNull() & F.col("_first").isNotNull()).select("_id", "_mem", "_first"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    # Each row becomes one for each level at most; a task that made too many would hold them all as it writes them.
    spread = lambda df, by: df.repartition(max(1, -(-df.count() * levels // ROWS_PER_CHUNK)), by)
    in_blocks = spread(held, "_no").select("_no", "_mem", level).withColumn("_block", F.expr("shiftright(_no, _level)"))
    # The blocks that make up all numbers from the first on: its own, and one beside each 0 among its digits.
    start = F.array(F.struct(F.lit(0).alias("_level"), F.col("_first").alias("_block")))
    beside = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.call_function("shiftright", F.col("_first"), l) % 2 == 0),
        lambda l: F.struct(l.alias("_level"), (F.call_function("shiftright", F.col("_first"), l) + 1).alias("_block")))
    wanted = spread(first, "_id").select("_id", "_mem", F.inline(F.concat(start, beside)))
    both = in_blocks.select("_level", "_block", "_mem", "_no").unionByName(wanted, allowMissingColumns=True)
    met = following(both, ["_level", "_block"], "_mem", F.col("_no").isNotNull(),
                    {"_n": count_of(F.col("_no")), "_best": least_of(F.col("_no"))}, rows_per_task).filter(F.col("_id").isNotNull())
    found = met.groupBy("_id").agg(F.sum("_n").alias("clusters"), F.min("_best").alias("_best")).join(
        sizes.select((F.col("_no") - 1).alias("_best"), size.alias("smallest")), "_best").select("_id", "clusters", "smallest")
    return parsed.join(found, "_id", "left").select(
        *requests.columns, F.when(F.col("error").isNull(), F.coalesce("clusters", F.lit(0))).alias("clusters"),
        F.col("smallest.cluster").alias("smallest"), F.col("smallest.cpu").alias("smallest_cpu"),
        F.col("smallest.memory").alias("smallest_memory"), "error",
    )


def node_environment(provider_id: Column, labels: Column) -> Column:
    """Environment one node reveals, or null."""
    env = F.when(F.lit(False), "")
    for prefix, name in PROVIDER_PREFIXES:
        env = env.when(provider_id.startswith(prefix), name)
    return env.when(F.map_contains_key(labels, F.lit(MINIKUBE_LABEL)), "Minikube")


def guess_environment(
    nodes: DataFrame, scope: Sequence[str] = SCOPE, order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Environment of each cluster: the first node in order that reveals one."""
    env = node_environment(F.col("provider_id"), F.col("labels"))
    first = F.min_by("_env", F.when(F.col("_env").isNotNull(), F.struct(*order)))
    return nodes.withColumn("_env", env).groupBy(*scope).agg(
        F.coalesce(first, F.lit("Unknown")).alias("environment")
    )


def listener_preset(environment: Column, override: Column | None = None) -> Column:
    guessed = F.when(environment.isin(*STABLE_ENVIRONMENTS), "stable-nodes").otherwise(
        "ephemeral-nodes"
    )
    return guessed if override is None else F.coalesce(override, guessed)
