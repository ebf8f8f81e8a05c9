from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetframe.functions.quantity import cpu_millis, memory_bytes, quantity_error
from fleetframe.operators import capacity as P

NODES = ("cluster STRING, name STRING, pos INT, taints ARRAY<STRING>, provider_id STRING, "
         "labels MAP<STRING, STRING>, allocatable MAP<STRING, STRING>")


@pytest.mark.parametrize("text, millis", [
    ("2", 2000), ("500m", 500), ("0.5", 500), ("1500u", "1.5"), ("1e3", 1000000), ("100n", "0"), ("1k", 1000000),
    (".5", 500), ("5.", 5000), ("-1", -1000), ("", None), ("m", None), ("1x", None), ("1 ", None), ("1mm", None), (None, None),
])
def test_cpu(spark, text, millis):
    got = spark.createDataFrame([(text,)], "t STRING").select(cpu_millis(F.col("t"))).first()[0]
    assert got == (None if millis is None else Decimal(millis))


@pytest.mark.parametrize("text, size", [
    ("4Gi", 4 * 2**30), ("512Mi", 512 * 2**20), ("1000000Ki", 1024000000), ("1G", 10**9), ("1E", 10**18), ("1Ei", 2**60),
    ("2E3", 2000), ("1.5Ki", 1536), ("128974848", 128974848), ("129e6", 129000000), ("123Mib", None),
])
def test_memory(spark, text, size):
    got = spark.createDataFrame([(text,)], "t STRING").select(memory_bytes(F.col("t"))).first()[0]
    assert got == (None if size is None else Decimal(size))


def test_capacity(spark):
    nodes = spark.createDataFrame([
        ("c", "a", 0, None, None, None, {"cpu": "2", "memory": "1Gi"}), ("c", "b", 1, [], None, None, {"cpu": "500m"}),
        ("c", "t", 2, ["t"], None, None, {"cpu": "8", "memory": "x"}), ("d", "n", 0, None, None, None, None),
        ("e", "bad", 0, None, None, None, {"cpu": "lots"}), ("e", "ok", 1, None, None, None, {"cpu": "1"})], NODES)
    good, rejects = P.cluster_capacity(nodes, ["cluster"])
    rows = {r.cluster: tuple(r)[1:] for r in good.collect()}
    assert rows == {"c": (3, 2, Decimal(2500), Decimal(2**30)), "d": (1, 1, Decimal(0), Decimal(0))}
    assert [(r.name, r.error) for r in rejects.collect()] == [("bad", "ParseNodeCpuQuantity")]
    with pytest.raises(Exception, match="ParseNodeCpuQuantity"):
        P.cluster_capacity(nodes, ["cluster"], "fail").good.collect()


def test_check(spark):
    capacity = spark.createDataFrame([("c", Decimal(2000), Decimal(2**30))], "cluster STRING, cpu_millis DECIMAL(38,3), memory_bytes DECIMAL(38,3)")
    asked = spark.createDataFrame(
        [("c", "equal", "2", "1Gi", "1Ti"), ("c", "more", "2001m", "1025Mi", "1Gi"), ("c", "mem", "1", "2Gi", "1"), ("c", "bad", "x", "1", "1")],
        "cluster STRING, spec STRING, cpu STRING, memory STRING, pvc STRING")
    found, rejects = P.check_capacity(asked, capacity, ["cluster"])
    assert sorted((r.spec, r.violation) for r in found.collect()) == [
        ("mem", "InsufficientMemory"), ("more", "InsufficientCpu"), ("more", "InsufficientMemory")]
    assert [r.error for r in rejects.collect()] == ["ParseCpuResourceRequirements"]


def test_environment(spark):
    rows = [("k", "1", 0, None, "aws://x", {}, None), ("k", "2", 1, None, "k3s://x", None, None), ("k", "3", 2, None, "kind://y", None, None),
            ("m", "1", 0, None, None, {"minikube.k8s.io/version": "v"}, None), ("m", "2", 1, None, "ionos://x", None, None),
            ("u", "1", 0, None, None, None, None), ("i", "1", 0, None, "ionos://x", {"minikube.k8s.io/version": "v"}, None)]
    env = P.guess_environment(spark.createDataFrame(rows, NODES).repartition(5), ["cluster"])
    assert {r.cluster: r.environment for r in env.collect()} == {"k": "K3s", "m": "Minikube", "u": "Unknown", "i": "Ionos"}
    preset = env.select("cluster", P.listener_preset(F.col("environment")).alias("p"), P.listener_preset(F.col("environment"), F.lit("none")).alias("o"))
    assert {r.cluster: r.p for r in preset.collect()} == {
        "k": "stable-nodes", "m": "stable-nodes", "u": "ephemeral-nodes", "i": "ephemeral-nodes"}
    assert {r.o for r in preset.collect()} == {"none"}


@pytest.mark.parametrize("text, size", [
    ("1000000000000000", "1000000000000000.000"), ("1125899906842624", "1125899906842624.000"),
    ("1099511627776000m", "1099511627776.000"), ("123456789012345678901234567890", "123456789012345678901234567890.000"),
    ("123456789012345678901234567890u", "123456789012345678901234.568"), ("1n", "0.000"), ("500000n", "0.001"),
    ("-1500m", "-1.500"), ("0.5Ki", "512.000"), (".5m", "0.001"), ("9007199254740993Ki", "9223372036854776832.000"),
])
def test_long_quantities_are_exact(spark, text, size):
    frame = spark.createDataFrame([(text,)], "q STRING").select(memory_bytes(F.col("q")).alias("v"))
    assert frame.first().v == Decimal(size)


def test_overflow_is_not_malformed(spark):
    frame = spark.createDataFrame([("9" * 34 + "Ei",), ("4GiB",), ("1",), (None,)], "q STRING")
    errors = [r.e for r in frame.select(quantity_error(F.col("q"), memory_bytes(F.col("q"))).alias("e")).collect()]
    assert errors == ["Overflow", "Malformed", None, None]


def test_request_without_total_is_rejected(spark):
    requests = spark.createDataFrame([(1, "s", "1", "1Gi"), (2, "s", "1", "1Gi")], "c INT, spec STRING, cpu STRING, memory STRING")
    total = spark.createDataFrame([(1, Decimal(5000), Decimal(1 << 40))], "c INT, cpu_millis DECIMAL(38,3), memory_bytes DECIMAL(38,3)")
    good, rejects = P.check_capacity(requests, total, ["c"])
    assert good.count() == 0 and [(r.c, r.error) for r in rejects.collect()] == [(2, "UnknownCapacity")]


@pytest.mark.parametrize("text, millis, size", [
    ("1e30", 10**33, 10**30), ("5e-1", 500, "0.5"), ("1.5e-4", "0.15", "0"), ("0e999999999999", 0, 0), ("1e999999999999", None, None),
    ("1e-999999999999", 0, 0), ("-.25Mi", -262144000, -262144), ("99999999999999999999E", None, None), ("+7", 7000, 7), (".", None, None),
    ("12345678901234567890123456789.125", "12345678901234567890123456789125", "12345678901234567890123456789.125"),
])
def test_exponents_and_limits(spark, text, millis, size):
    got = spark.createDataFrame([(text,)], "t STRING").select(cpu_millis(F.col("t")), memory_bytes(F.col("t"))).first()
    assert tuple(got) == tuple(None if v is None else Decimal(v) for v in (millis, size))


def test_overflow_is_not_malformed(spark):
    df = spark.createDataFrame([("1e99",), ("1x",), ("1",), (None,)], "t STRING")
    got = [r[0] for r in df.select(quantity_error(F.col("t"), memory_bytes(F.col("t")))).collect()]
    assert got == ["Overflow", "Malformed", None, None]


@pytest.mark.parametrize("limit", [7, 10**6])
def test_fitting_clusters(spark, limit):
    """Against all pairs: ties in both sizes, requests nothing holds, unread ones, clusters without a total."""
    import random

    rng = random.Random(5)
    fleet = [(i, Decimal(rng.choice([0, 500, 1000, 1500, 4000])), Decimal(rng.randrange(8) * 2**30)) for i in range(45)] + [(99, None, None)]
    asked = [(i, rng.choice(["0", "500m", "1", "1200m", "4", "4001m", "x"]), rng.choice(["0", "1Gi", "3Gi", "7Gi", "8Gi", "?"])) for i in range(120)]
    capacity = spark.createDataFrame(fleet, "cluster INT, cpu_millis DECIMAL(38,3), memory_bytes DECIMAL(38,3)")
    got = {r.spec: r for r in P.fitting_clusters(spark.createDataFrame(asked, "spec INT, cpu STRING, memory STRING"), capacity, ["cluster"], limit).collect()}
    millis = {"0": 0, "500m": 500, "1": 1000, "1200m": 1200, "4": 4000, "4001m": 4001}
    for spec, cpu, memory in asked:
        r = got[spec]
        if cpu == "x" or memory == "?":
            assert r.error == ("ParseCpuResourceRequirements" if cpu == "x" else "ParseMemoryResourceRequirements") and r.clusters is None
            continue
        holds = [(c, m, i) for i, c, m in fleet if c is not None and c >= millis[cpu] and m >= int(memory.replace("Gi", "")) * 2**30]
        assert r.clusters == len(holds) and r.error is None
        assert (None if r.smallest is None else (r.smallest_cpu, r.smallest_memory, r.smallest.cluster)) == min(holds, default=None)
    empty = P.fitting_clusters(spark.createDataFrame(asked[:9], "spec INT, cpu STRING, memory STRING"), capacity.limit(0), ["cluster"], limit)
    assert {r.clusters for r in empty.collect()} <= {0, None}


def test_following_in_small_tasks(spark, monkeypatch):
    """Tasks are as many as the rows ask for, whatever they shrink to; a hot key and small ones give the same as all pairs."""
    import random

    from fleetframe.operators import asof

    monkeypatch.setattr(asof, "ROWS_PER_PARTITION", 100, raising=False)
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else i % 2000 // 60 if i % 3 else 0, rng.randrange(300), i if rng.random() < 0.5 else None) for i in range(6000)]
    out = asof.following(
        spark.createDataFrame(rows, "id INT, key INT, at INT, value INT"), ["key"], "at", F.col("value").isNotNull(),
        {"n": asof.count_of(F.col("value")), "least": asof.least_of(F.col("value"))}, 100)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    held = {}
    for _, key, at, value in rows:
        if value is not None:
            held.setdefault(key, []).append((at, value))
    asking = [r for r in got if r.value is None]
    assert len(got) == len(rows) and len(asking) > 2500
    for r in asking:
        later = [v for at, v in held.get(r.key, []) if at >= r.at]
        assert (r.n, r.least) == (len(later), min(later, default=None))
    tasks = {}
    for r in got:
        tasks[r.task] = tasks.get(r.task, 0) + 1
    assert len(tasks) > 20 and max(tasks.values()) < 1000
