import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetframe.operators import ttl as T
from fleetframe.streaming import ttl as streaming

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def log_frame(spark, rows):
    return spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(rows)], "key STRING, ts TIMESTAMP, id LONG")


def brute(rows, span, strict=True):
    out, keys = {}, {}
    for i, (k, s) in enumerate(rows):
        keys.setdefault(k, []).append((s, i))
    for seen in keys.values():
        anchor = None
        for s, i in sorted(seen):
            over = anchor is not None and (s - anchor > span if strict else s - anchor >= span)
            out[i] = "Miss" if anchor is None else "Expired" if over else "Hit"
            if out[i] != "Hit":
                anchor = s
    return out


def test_replay_case(spark):
    rows = [("k", s) for s in (0, 10, 50, 61, 100, 122, 123)]
    got = T.ttl_replay(log_frame(spark, rows), ["key"], "ts", 60, ["id"]).orderBy("id").collect()
    assert [r.status for r in got] == ["Miss", "Hit", "Hit", "Expired", "Hit", "Expired", "Hit"]


def test_gate_case(spark):
    rows = [("k", s) for s in (0, 899, 900, 1799, 1800)]
    got = T.interval_gate(log_frame(spark, rows), ["key"], "ts", 900, ["id"]).orderBy("id").collect()
    assert [r.passed for r in got] == [True, False, True, False, True]


def skewed_log(seed, spread):
    rnd = random.Random(seed)
    hot = [("hot", rnd.randrange(spread)) for _ in range(1500)]
    burst = [("hot", spread + rnd.randrange(20)) for _ in range(500)]
    cold = [(rnd.choice(["a", "b", None]), rnd.randrange(spread)) for _ in range(600)]
    rows = hot + burst + cold
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [1, 30, 5000])
@pytest.mark.parametrize("limit", [100, 10**6])
def test_replay_of_hot_keys(spark, span, limit):
    rows = skewed_log(span, 40000)
    df = log_frame(spark, rows).repartition(13)
    got = {r.id: r.status for r in T.ttl_replay(df, ["key"], "ts", span, ["id"], limit).collect()}
    assert got == brute(rows, span)
    passed = {r.id: r.passed for r in T.interval_gate(df, ["key"], "ts", span, ["id"], limit).collect()}
    assert passed == {i: s != "Hit" for i, s in brute(rows, span, strict=False).items()}


@pytest.mark.parametrize("span, spread, gaps", [(50, 600, False), (200, 900, True), (97, 4000, True), (1, 8, False)])
def test_replay_of_dense_keys(spark, span, spread, gaps):
    """Many rows per anchor: slices across the period, with outages that make offsets wrap."""
    rnd = random.Random(span)
    times = [s for s in (rnd.randrange(spread) for _ in range(3000)) if not gaps or s % 300 < 170]
    rows = [("dense", s) for s in times] + [(None, s) for s in times[:900]] + [("cold", s * 7) for s in times[:50]]
    rows += [("sparse", s * 50) for s in times[:300]]
    rnd.shuffle(rows)
    df = log_frame(spark, rows).repartition(11)
    got = {r.id: r.status for r in T.ttl_replay(df, ["key"], "ts", span, ["id"], 100).collect()}
    assert got == brute(rows, span)
    passed = {r.id: r.passed for r in T.interval_gate(df, ["key"], "ts", span, ["id"], 100).collect()}
    assert passed == {i: s != "Hit" for i, s in brute(rows, span, strict=False).items()}


def test_hot_key_is_split(spark):
    from fleetframe.sizing import hot_keys, time_chunks

    df = log_frame(spark, skewed_log(1, 40000)).withColumn("_t", F.unix_micros("ts"))
    hot = hot_keys(df, ["key"], "_t", 100)
    chunked = time_chunks(df, ["key"], "_t", 100, hot)
    sizes = {(r.key, r._chunk): r["count"] for r in chunked.groupBy("key", "_chunk").count().collect()}
    assert sorted(r.key or "" for r in hot.collect()) == ["", "a", "b", "hot"]
    assert max(sizes.values()) <= 320 and chunked.count() == df.count()


@pytest.mark.parametrize("limit", [500, 1000])
def test_an_outlier_does_not_undo_the_split(spark, limit):
    from fleetframe.sizing import hot_keys, time_chunks

    rows = [("k", 0)] + [("k", 10**8 + i) for i in range(20000)]
    df = log_frame(spark, rows).withColumn("_t", F.unix_micros("ts"))
    chunked = time_chunks(df, ["key"], "_t", limit, hot_keys(df, ["key"], "_t", limit))
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert sum(sizes) == 20001 and max(sizes) <= 1.5 * limit


def test_one_instant_is_one_chunk(spark):
    from fleetframe.sizing import hot_keys, time_chunks

    df = log_frame(spark, [("k", 5)] * 3000).withColumn("_t", F.unix_micros("ts"))
    chunked = time_chunks(df, ["key"], "_t", 100, hot_keys(df, ["key"], "_t", 100))
    assert chunked.select("_chunk").distinct().count() == 1
    got = [r.status for r in T.ttl_replay(df.drop("_t"), ["key"], "ts", 10, ["id"], 100).collect()]
    assert sorted(got) == ["Hit"] * 2999 + ["Miss"]


def test_null_times(spark):
    df = spark.createDataFrame([("k", None, 0), ("k", at(5), 1), ("k", at(6), 2)], "key STRING, ts TIMESTAMP, id LONG")
    got = T.ttl_replay(df, ["key"], "ts", 60, ["id"]).orderBy("id").collect()
    assert [r.status for r in got] == [None, "Miss", "Hit"]


def test_status_lookup(spark):
    requests = spark.createDataFrame([("a", at(3600)), ("a", at(3601)), ("b", at(0)), ("c", at(0))], "key STRING, ts TIMESTAMP")
    entries = spark.createDataFrame([("a", at(0)), ("c", at(9))], "key STRING, modified TIMESTAMP")
    good, rejects = T.ttl_status(requests, entries, 3600)
    assert sorted((r.key, r.status) for r in good.collect()) == [("a", "Expired"), ("a", "Hit"), ("b", "Miss")]
    assert [(r.key, r.error) for r in rejects.collect()] == [("c", "FutureTimestamp")]


@pytest.mark.parametrize("limit", [50, 10**6])
def test_status_asof(spark, limit):
    rnd = random.Random(4)
    asked = [(rnd.choice(["hot", "hot", "hot", "x"]), rnd.randrange(3000)) for _ in range(800)]
    stored = [(rnd.choice(["hot", "x", "y"]), rnd.randrange(3000)) for _ in range(90)]
    entries = spark.createDataFrame([(k, at(s)) for k, s in stored], "key STRING, modified TIMESTAMP")
    got = {r.id: r.status for r in T.ttl_status_asof(log_frame(spark, asked), entries, 20, rows_per_task=limit).collect()}
    want = {}
    for i, (k, s) in enumerate(asked):
        last = max((m for e, m in stored if e == k and m <= s), default=None)
        want[i] = "Miss" if last is None else "Expired" if s - last > 20 else "Hit"
    assert got == want


def test_expiry_and_ages(spark):
    entries = spark.createDataFrame([(".cache-last-purge", at(0)), ("old", at(0)), ("edge", at(6400)), ("new", at(9000)), ("ahead", at(20000))],
                                    "name STRING, modified TIMESTAMP")
    now = F.unix_micros(F.lit(at(10000)).cast("timestamp"))
    assert [r.name for r in T.select_expired(entries, now, 3600).collect()] == ["old"]
    assert {r.name for r in T.select_expired(entries, now, 3600, "all").collect()} == {"old", "edge", "new", "ahead"}
    assert {r.name: r.age_seconds for r in T.entry_ages(entries, now).collect()} == {"old": 10000, "edge": 3600, "new": 1000, "ahead": 0}


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streaming.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_state_store_is_demanded(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS key", "timestamp AS ts")
    with pytest.raises(ValueError, match="stateStore.providerClass"):
        streaming.ttl_replay_stream(stream, ["key"], "ts", 30)


def run_stream(spark, make, schema, batches, tmp_path):
    """Feed one file per micro-batch and return the collected output rows."""
    source = tmp_path / "in"
    source.mkdir()
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = (make(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect()))
             .option("checkpointLocation", str(tmp_path / "check")).start())
    try:
        for i, batch in enumerate(batches):
            batch.coalesce(1).write.json(str(tmp_path / f"stage{i}"))
            part = next((tmp_path / f"stage{i}").glob("part-*"))
            (source / f"{i}.json").write_bytes(part.read_bytes())
            query.processAllAvailable()
    finally:
        query.stop()
    return out


def test_stream_equals_batch(spark, rocksdb, tmp_path):
    rows = [(k, s) for k, s in skewed_log(9, 4000) if k is not None][:400]
    rows.sort(key=lambda r: r[1])
    df = log_frame(spark, rows)
    parts = [df.filter((F.col("id") >= i * 100) & (F.col("id") < (i + 1) * 100)) for i in range(4)]
    got = run_stream(spark, lambda s: streaming.ttl_replay_stream(s, ["key"], "ts", 30, ["id"]), df.schema, parts, tmp_path)
    assert {r.id: r.status for r in got} == brute(rows, 30)


def test_stream_gate_and_late_rows(spark, rocksdb, tmp_path):
    df = log_frame(spark, [("k", 0), ("k", 900), ("k", 500), ("k", 1799), ("k", 1800)])
    parts = [df.filter("id < 2"), df.filter("id >= 2")]
    got = run_stream(spark, lambda s: streaming.interval_gate_stream(s, ["key"], "ts", 900, ["id"]), df.schema, parts, tmp_path)
    assert {r.id: r.passed for r in got} == {0: True, 1: True, 2: None, 3: False, 4: True}


def test_overlay_stream(spark, tmp_path):
    from fleetframe.operators.catalog import overlay_last_wins
    from fleetframe.streaming.overlay import compact, read_overlay, start_overlay

    rows = [(f"n{i % 7}", i, i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "name STRING, value INT, source_ord INT, pos INT")
    source, table = tmp_path / "in", str(tmp_path / "table")
    for i in range(3):
        df.filter(F.col("value") % 3 == i).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    start_overlay(stream, table, str(tmp_path / "check"), availableNow=True).awaitTermination()
    want = sorted(map(tuple, overlay_last_wins(df, ["name"]).select("name", "source_ord", "pos", "value").collect()))
    assert sorted(map(tuple, read_overlay(spark, table).collect())) == want
    compact(spark, table, str(tmp_path / "small"))
    assert sorted(map(tuple, read_overlay(spark, str(tmp_path / "small")).collect())) == want


def test_one_instant_in_many_chunks(spark):
    """All rows of a hot key at two instants: no chunk holds them all, and only the first row of each can store."""
    rows = [("k", 5)] * 2000 + [("k", 40)] * 1500 + [("k", 41)] * 30
    df = log_frame(spark, rows).repartition(7)
    timed = df.withColumn("_t", F.unix_micros("ts"))
    from fleetframe.sizing import hot_keys

    chunked = T._order_chunks(timed, ["key"], ["id"], 100, hot_keys(timed, ["key"], "_t", 100))
    sizes = [r["count"] for r in chunked.groupBy("key", "_chunk").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    got = {r.id: r.status for r in T.ttl_replay(df, ["key"], "ts", 35, ["id"], 100).collect()}
    assert got == brute(rows, 35) and sorted(set(got.values())) == ["Expired", "Hit", "Miss"] and got[3500] == "Expired"
    got = {r.id: r.status for r in T.ttl_replay(df, ["key"], "ts", 10, ["id"], 100).collect()}
    assert got == brute(rows, 10)


@pytest.mark.parametrize("span, spread", [(3, 9000), (700, 9000), (4500, 9000), (10**6, 9000), (40, 300)])
def test_reports_compose(spark, span, spread):
    """Periods from much shorter than a chunk to longer than the whole log; groups stay near the limit."""
    rnd = random.Random(span)
    rows = [("hot", rnd.randrange(spread)) for _ in range(4000)] + [(None, rnd.randrange(spread)) for _ in range(1500)]
    df = log_frame(spark, rows).repartition(5)
    compose = T._composed
    got = {r.id: r.status for r in T.ttl_replay(df, ["key"], "ts", span, ["id"], 60).collect()}
    assert got == brute(rows, span)
    # Composition is associative and follows every anchor as the single reports do.
    import numpy as np

    times = np.unique(np.array([s for k, s in rows if k == "hot"]) * T.SECOND)
    parts = [T._exits(p, span * T.SECOND) for p in np.array_split(times, 8)]
    left = parts[0]
    for p in parts[1:]:
        left = compose(*left, *p, span * T.SECOND)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = compose(*p, *right, span * T.SECOND)
    for start in (times[0] - 1, times[0] - span * T.SECOND // 2, times[0] - span * T.SECOND):
        one = np.array([start])
        for u, l in parts:
            one = T._outcomes(u, l, one + span * T.SECOND, one)
        for u, l in (left, right):
            assert T._outcomes(u, l, np.array([start + span * T.SECOND]), np.array([start]))[0] == one[0]


@pytest.mark.parametrize("limit", [40, 10**6])
def test_purge_replay(spark, limit):
    rnd = random.Random(limit)
    visits = [(rnd.choice("aab"), rnd.randrange(2000)) for _ in range(500)]
    stored = [(rnd.choice("aabc"), f"n{rnd.randrange(40)}", rnd.randrange(2000)) for _ in range(400)] + [("a", ".cache-last-purge", 0), ("a", "n1", None)]
    events = spark.createDataFrame([(c, at(s)) for c, s in visits], "cluster STRING, ts TIMESTAMP")
    entries = spark.createDataFrame([(i, c, n, None if s is None else at(s)) for i, (c, n, s) in enumerate(stored)],
                                    "id INT, cluster STRING, name STRING, modified TIMESTAMP")
    got = {r.id: r for r in T.purge_replay(events, entries, 50, 100, entry_order=["id"], rows_per_task=limit).collect()}
    passes = {}
    for c in "abc":
        last = None
        for s in sorted(s for k, s in visits if k == c):
            if last is None or s - last >= 50:
                passes.setdefault(c, []).append(s)
                last = s
    for i, (c, n, s) in enumerate(stored):
        later = [(t, j) for j, (c2, n2, t) in enumerate(stored) if (c2, n2) == (c, n) and s is not None and t is not None and (t, j) > (s, i)]
        again = min(later)[0] if later else None
        due = next((p for p in passes.get(c, []) if s is not None and p - s > 100), None)
        removed = n != ".cache-last-purge" and due is not None and (again is None or due <= again)
        assert got[i].removed_at == (at(due) if removed else None), (i, stored[i])
        if s is not None:
            assert got[i].fate == ("removed" if removed else "replaced" if again is not None else "kept")
