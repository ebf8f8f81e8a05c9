"""Time-to-live rules over fetch logs.

A cached entry answers requests until it is older than ``max_age``; then the next request
stores it anew. Which requests store depends on the previous store, so the batch replay is
a sequential scan per key. Keys are spread by hash; a hot key is cut along (time, order) into
chunks that are scanned in parallel, even inside one instant: each chunk first reports which
anchor it would leave behind for any anchor it may receive. Reports are step functions and
compose, so neighbouring ones are merged in rounds until one task can follow what is left, and
the anchors found are handed back down until every chunk starts from its true one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..errors import Split, split
from ..schemas import PROTECTED_ENTRIES
from ..sizing import (
    ROWS_PER_TASK, hot_keys, join_null_safe, micros, shared_table, time_chunks,
)
from .asof import following, least_of
from .ordering import range_number

SECOND = 1_000_000


# --- lookups ---------------------------------------------------------------------------


def _status(time: Column, elapsed: Column, stored: Column, max_age: float) -> Column:
    """A request without a time has no status, as in the replay."""
    return (
        F.when(time.isNull(), F.lit(None).cast("string"))
        .when(stored.isNull(), "Miss")
        .when(elapsed > int(max_age * SECOND), "Expired")
        .otherwise("Hit")
    )


def ttl_status(
    requests: DataFrame, entries: DataFrame, max_age: float, key: Sequence[str] = ("key",),
    ts: str = "ts", modified: str = "modified", on_error: str = "quarantine",
) -> Split:
    """Status of each request against the one entry of its key; an equal age is still a hit.

    An entry from the future is an error.
    """
    joined = requests.withColumn("_t", micros(requests, ts)).join(
        entries.select(*key, modified, micros(entries, modified).alias("_m")), list(key), "left"
    )
    elapsed = F.col("_t") - F.col("_m")
    return split(
        joined.withColumns({
            "status": _status(F.col("_t"), elapsed, F.col("_m"), max_age),
            "error": F.when(elapsed < 0, "FutureTimestamp"),
        }).drop("_t", "_m"),
        "error", on_error,
    )


def ttl_status_asof(
    requests: DataFrame, entries: DataFrame, max_age: float, key: Sequence[str] = ("key",),
    ts: str = "ts", modified: str = "modified", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Status against the last entry stored at or before each request.

    One sorted pass over requests and entries together, never a join of all pairs. Chunks
    of hot keys start from the newest entry of the chunks before them.
    """
    key = list(key)
    both = requests.withColumns({"_t": micros(requests, ts), "_m": F.lit(None).cast("long")}
    ).unionByName(
        entries.select(*key, micros(entries, modified).alias("_t"),
                       micros(entries, modified).alias("_m"), F.lit(True).alias("_entry")),
        allowMissingColumns=True,
    )
    hot = hot_keys(both, key, "_t", rows_per_task)
    chunked = time_chunks(both, key, "_t", rows_per_task, hot)
    # Entries sort before requests of the same time, and the stored time is its own maximum.
    so_far = Window.partitionBy(*key, "_chunk").orderBy("_t", F.col("_m").isNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    newest = F.max("_m").over(so_far)
    if hot is not None:
        earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            join_null_safe(chunked, hot, key, "left_semi").groupBy(*key, "_chunk").agg(F.max("_m").alias("_top"))
            .select(*key, "_chunk", F.max("_top").over(earlier).alias("_carry"))
        )
        chunked = join_null_safe(chunked, carried, [*key, "_chunk"], "left")
        newest = F.coalesce(newest, F.col("_carry"))
    seen = chunked.withColumn("_m", newest).filter(F.col("_entry").isNull())
    return seen.withColumn("status", _status(F.col("_t"), F.col("_t") - F.col("_m"), F.col("_m"), max_age)).select(
        *requests.columns, F.timestamp_micros("_m").alias("stored_at"), "status"
    )


def select_expired(
    entries: DataFrame, now: Column, max_age: float, mode: str = "expired",
    protected: Sequence[str] = PROTECTED_ENTRIES, name: str = "name", modified: str = "modified",
) -> DataFrame:
    """Entries a purge removes: all, or those strictly older than ``max_age``."""
    if mode not in ("all", "expired"):
        raise ValueError(f"mode must be 'all' or 'expired', not {mode!r}")
    open_entries = entries.filter(~F.col(name).isin(*protected)) if protected else entries
    if mode == "all":
        return open_entries
    return open_entries.filter(is_expired(micros(entries, modified), now, max_age))


def is_expired(modified: Column, now: Column, max_age: float) -> Column:
    """Whether an entry stored at ``modified`` (microseconds) is strictly older than ``max_age``."""
    return now - modified > int(max_age * SECOND)


def entry_ages(
    entries: DataFrame, now: Column, protected: Sequence[str] = PROTECTED_ENTRIES,
    name: str = "name", modified: str = "modified",
) -> DataFrame:
    """Whole seconds since each entry was stored; future entries are of age 0.

    ``now`` is in microseconds, for example ``F.unix_micros(F.current_timestamp())``.
    """
    age = F.greatest(F.lit(0).cast("long"), F.floor((now - micros(entries, modified)) / SECOND))
    open_entries = entries.filter(~F.col(name).isin(*protected)) if protected else entries
    return open_entries.withColumn("age_seconds", age.cast("long"))


def purge_replay(
    events: DataFrame, entries: DataFrame, interval: float, max_age: float, scope: Sequence[str] = ("cluster",),
    name: str = "name", ts: str = "ts", modified: str = "modified", order: Sequence[str] = (),
    entry_order: Sequence[str] = (), protected: Sequence[str] = PROTECTED_ENTRIES, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What becomes of each stored entry when the gate's passing events purge what is expired.

    An event passes as in :func:`interval_gate`, and then removes the entries of its scope stored more
    than ``max_age`` before it, but for protected names. Storing a name again replaces its entry;
    a purge at the very time of the next store still finds the old one. Adds ``removed_at`` and
    ``fate``: removed, replaced or kept. Entries without a time are kept.
    """
    scope = list(scope)
    passed = interval_gate(events.select(*scope, ts, *order), scope, ts, interval, order, rows_per_task).filter("passed")
    marks = passed.select(*scope, micros(passed, ts).alias("_t"), micros(passed, ts).alias("_mark"))
    stored = entries.withColumn("_m", micros(entries, modified))
    again = Window.partitionBy(*scope, name).orderBy("_m", *entry_order)
    stored = stored.withColumns({"_next": F.lead("_m").over(again), "_t": F.col("_m") + int(max_age * SECOND)})
    both = stored.withColumns({"_mark": F.lit(None).cast("long"), "_entry": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    # An event at the very end of the age does not see the entry as expired: it comes first, so it counts for none.
    found = following(both, scope, "_t", F.col("_entry").isNotNull(), {"_due": least_of(F.col("_mark"))}, rows_per_task).filter("_entry")
    open_entry = ~F.col(name).isin(*protected) if protected else F.lit(True)
    removed = F.coalesce(open_entry, F.lit(True)) & F.col("_due").isNotNull() & (F.col("_next").isNull() | (F.col("_due") <= F.col("_next")))
    return found.select(
        *entries.columns, F.when(removed, F.timestamp_micros("_due")).alias("removed_at"),
        F.when(removed, "removed").when(F.col("_next").isNotNull(), "replaced").otherwise("kept").alias("fate"),
    )


# --- sequential replay -----------------------------------------------------------------


def ttl_replay(
    log: DataFrame, key: Sequence[str], ts: str, max_age: float, order: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Replay a request log against a cache: adds ``status`` Miss, Expired or Hit.

    Miss and Expired store the entry; a Hit does not refresh it. ``order`` breaks ties
    between requests of one key at the same time. A null time gets a null status.
    """
    marked = _mark_anchors(log, list(key), ts, int(max_age * SECOND), list(order), rows_per_task)
    status = (
        F.when(F.col("_anchor").isNull(), F.lit(None).cast("string"))
        .when(~F.col("_anchor"), "Hit")
        .when(F.col("_first"), "Miss")
        .otherwise("Expired")
    )
    return marked.select(*log.columns, status.alias("status"))


def interval_gate(
    events: DataFrame, key: Sequence[str], ts: str, interval: float, order: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Let an event pass when ``interval`` has elapsed since the last one that passed.

    Exactly the interval is enough here, unlike in :func:`ttl_replay`.
    """
    span = int(interval * SECOND) - 1
    marked = _mark_anchors(events, list(key), ts, span, list(order), rows_per_task)
    return marked.select(*events.columns, F.col("_anchor").alias("passed"))


def _mark_anchors(df, key, ts, span, order, rows_per_task):
    """Add ``_anchor`` (row is later than the previous anchor + span) and ``_first``."""
    timed = df.withColumn("_t", micros(df, ts))
    hot = hot_keys(timed, key, "_t", rows_per_task)
    chunked = _order_chunks(timed, key, order, rows_per_task, hot)
    if hot is None:
        chunked = chunked.withColumn("_carry", F.lit(None).cast("long"))
    else:
        carried = _carried_anchors(join_null_safe(chunked, hot, key, "left_semi"), key, span, rows_per_task)
        chunked = join_null_safe(chunked, carried, [*key, "_chunk"], "left")
    return _mark_by_chunks(chunked, key, span, order)


def _order_chunks(timed, key, order, rows_per_task, hot):
    """Add ``_chunk``: 0, but the number of a range of (time, order) for hot keys and -1 without a time.

    Rows of one instant may lie in several chunks; only the first of them can be an anchor, and the
    chunks after it receive that anchor. Rows equal in time and order share a chunk.
    """
    untimed = F.when(F.col("_t").isNull(), F.lit(-1))
    ranges = None
    if hot is not None:
        placed = [F.col("_t"), *order]
        busy = join_null_safe(timed, hot, key, "left_semi").filter(F.col("_t").isNotNull())
        ranges = range_number(busy, placed, hot.agg(F.sum("_n")).first()[0], rows_per_task)
    if ranges is None:
        return timed.withColumn("_chunk", F.coalesce(untimed, F.lit(0)))
    marked = join_null_safe(timed, hot.select(*key, F.lit(True).alias("_hot")), key, "left")
    return marked.withColumn("_chunk", F.coalesce(untimed, F.when(F.col("_hot"), ranges), F.lit(0))).drop("_hot")


def _mark_by_chunks(chunked, key, span, order):
    """Scan every chunk in time order, from the anchor it receives."""
    placed = chunked.repartition(*key, "_chunk").sortWithinPartitions(*key, "_chunk", "_t", *order)
    schema = StructType(
        placed.schema.fields
        + [StructField("_anchor", BooleanType()), StructField("_first", BooleanType())]
    )
    groups = [*key, "_chunk"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, due = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = _group_starts(batch, groups, last)
            known = ~pc.is_null(batch.column("_t")).to_numpy(zero_copy_only=False)
            t = pc.fill_null(batch.column("_t"), 0).to_numpy(zero_copy_only=False)
            carry = batch.column("_carry")
            anchor, due = _walk(t, starts, carry, due, span)
            first = starts & pc.is_null(carry).to_numpy(zero_copy_only=False)
            last = batch.slice(batch.num_rows - 1).select(groups)
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(anchor, pa.bool_(), mask=~known), pa.array(first, pa.bool_())],
                names=batch.schema.names + ["_anchor", "_first"],
            )

    return placed.mapInArrow(scan, schema)


def _walk(t, starts, carry, due, span):
    """Anchors among sorted times of several groups, and the due time after the last row.

    A row more than ``span`` after the row before it is an anchor whatever came earlier,
    and a stretch that ends within ``span`` of its first anchor holds no other. Only longer
    stretches are walked, from anchor to anchor. ``due`` continues the batch before.
    """
    n = len(t)
    anchor = starts.copy()
    anchor[1:] |= t[1:] - t[:-1] > span
    edges = np.flatnonzero(anchor)
    open_first = n if len(edges) == 0 else int(edges[0])
    ends = np.append(edges[1:], n)
    carried = starts[edges] & pc.is_valid(carry).to_numpy(zero_copy_only=False)[edges]
    walked = np.flatnonzero(carried | (t[ends - 1] > t[edges] + span)).tolist()
    times = t.tolist() if walked or open_first else None

    def hop(due, lo, hi):
        while True:
            lo = bisect_right(times, due, lo, hi)
            if lo == hi:
                return due
            anchor[lo] = True
            due = times[lo] + span

    if open_first:
        due = hop(due, 0, open_first)
    for k in walked:
        lo, hi = int(edges[k]), int(ends[k])
        if carried[k]:
            anchor[lo] = False
            due = hop(carry[lo].as_py() + span, lo, hi)
        else:
            due = hop(times[lo] + span, lo + 1, hi)
    if len(edges) and (not walked or walked[-1] != len(edges) - 1):
        due = int(t[edges[-1]]) + span
    return anchor, due


def _group_starts(batch: pa.RecordBatch, groups: list[str], last) -> np.ndarray:
    """True where a row's group differs from the row before (``last`` ends the batch before)."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    starts[0] = last is None
    for name in groups:
        column = batch.column(name)
        before = column.slice(0, n - 1)
        if last is not None:
            before = pa.concat_arrays([last.column(name), before])
        else:
            before = pa.concat_arrays([column.slice(0, 1), before])
        both_null = pc.and_(pc.is_null(column), pc.is_null(before))
        same = pc.or_(both_null, pc.fill_null(pc.equal(column, before), False))
        starts |= ~same.to_numpy(zero_copy_only=False)
    return starts


def _carried_anchors(hot_rows, key, span, rows_per_task):
    """(key, _chunk, _carry): the last anchor before each chunk of a hot key."""
    groups = [*key, "_chunk"]
    # Only the first of equal times can be an anchor, so a chunk needs each time once.
    times = hot_rows.filter(F.col("_t").isNotNull()).select(*groups, "_t").distinct()
    placed = times.repartition(*groups).sortWithinPartitions(*groups, "_t")
    fields = [f for f in times.schema.fields if f.name in groups]

    def transfer(batches):
        """Per chunk: for any due time before ``_until``, the chunk leaves anchor ``_leaves``."""
        for head, t in _whole_groups(batches, groups, ["_t"]):
            yield _spread(head, groups, ["_until", "_leaves"], _exits(t, span))

    report = StructType(fields + [StructField("_until", LongType()), StructField("_leaves", LongType())])
    reports = shared_table(placed.mapInArrow(transfer, report))
    return shared_table(_incoming(reports, key, span, rows_per_task))


def _incoming(reports, key, span, limit):
    """Anchor that each chunk of a key receives, from the chunks' reports.

    Neighbouring chunks with at most ``limit`` steps together (or two) form a block, whose reports compose to
    one. The blocks' anchors are found in the same way, and each block then hands its own on to
    its chunks. Where composing does not halve the steps, because anchors are farther apart than
    chunks are long, the reports are followed as a stream, a chunk at a time.
    """
    groups = [*key, "_chunk"]
    sizes = reports.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shared_table(sizes.select(*groups, "_n", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / limit).alias("_block")))
    steps, blocked, chunks = blocks.agg(F.sum("_n"), F.countDistinct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key], "_block"),
                                        F.count(F.lit(1))).first()
    carry = StructType([f for f in reports.schema.fields if f.name in groups] + [StructField("_carry", LongType())])

    def followed(rows):
        """Reports of each (key, block) in order, started from the block's own anchor."""
        by = [*key, "_block"]
        placed = rows.repartition(*by).sortWithinPartitions(*by, "_chunk", "_until")

        def follow(batches):
            anchor, last = None, None
            for head, until, leaves, start in _whole_groups(batches, [*by, "_chunk"], ["_until", "_leaves", "_start"]):
                at = head.select(by)
                if last is None or not at.equals(last):
                    anchor, last = (None if np.isnan(start[0]) else int(head.column("_start")[0].as_py())), at
                yield pa.RecordBatch.from_arrays(
                    [*head.select(groups).columns, pa.array([anchor], pa.int64())], names=[*groups, "_carry"])
                anchor = int(_outcomes(until, leaves, np.array([anchor + span]), np.array([anchor]))[0]) if anchor is not None else int(leaves[0])

        return placed.mapInArrow(follow, carry)

    alone = reports.withColumns({"_block": F.lit(0).cast("long"), "_start": F.lit(None).cast("long")})
    if not steps or blocked >= chunks or steps <= limit:
        return followed(alone)
    rows = join_null_safe(reports, blocks.drop("_n"), groups, "inner")
    schema = StructType([f for f in rows.schema.fields if f.name in [*key, "_block", "_until", "_leaves"]])

    def compose(group, table):
        table = table.sort_by([("_chunk", "ascending"), ("_until", "ascending")])
        chunk, until, leaves = (table.column(c).to_numpy() for c in ("_chunk", "_until", "_leaves"))
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        u, l = until[:cuts[1]], leaves[:cuts[1]]
        for lo, hi in zip(cuts[1:-1], cuts[2:]):
            u, l = _composed(u, l, until[lo:hi], leaves[lo:hi], span)
        out = {name: pa.array([group[i].as_py()] * len(u), table.schema.field(name).type) for i, name in enumerate([*key, "_block"])}
        return pa.table({f.name: out.get(f.name, pa.array(u if f.name == "_until" else l)) for f in schema.fields})

    composed = shared_table(rows.groupBy(*key, "_block").applyInArrow(compose, schema).withColumnRenamed("_block", "_chunk"))
    if 2 * composed.count() > steps:
        return followed(alone)
    starts = shared_table(_incoming(composed, key, span, limit)).select(*key, F.col("_chunk").alias("_block"), F.col("_carry").alias("_start"))
    return followed(join_null_safe(rows, starts, [*key, "_block"], "left"))


def _outcomes(until, leaves, due, anchors):
    """Anchors that a report leaves for incoming ``anchors`` with their ``due`` times."""
    at = np.searchsorted(until, due, side="right")
    return np.where(at < len(until), leaves[np.minimum(at, len(until) - 1)], anchors)


def _composed(until, leaves, until2, leaves2, span):
    """Report of a stretch and the one after it as one report."""
    out = _outcomes(until2, leaves2, leaves + span, leaves)
    # Due times that the first stretch has no row after meet the second as they are.
    tail = until2 > until[-1]
    u, l = np.concatenate([until, until2[tail]]), np.concatenate([out, leaves2[tail]])
    keep = np.append(l[1:] != l[:-1], True)
    return u[keep], l[keep]


def _whole_groups(batches, groups, columns):
    """Each group of a sorted stream as its first row and its columns as arrays."""
    held, last = [], None

    def flush():
        arrays = [
            np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns
        ]
        return held[0].slice(0, 1), *arrays

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cuts = np.flatnonzero(_group_starts(batch, groups, last)).tolist()
        if held and cuts and cuts[0] == 0:
            yield flush()
            held = []
        edges = sorted({0, *cuts, batch.num_rows})
        for lo, hi in zip(edges, edges[1:]):
            if lo > 0:
                yield flush()
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = batch.slice(batch.num_rows - 1).select(groups)
    if held:
        yield flush()


def _spread(head, groups, names, arrays):
    """A batch of ``arrays`` with the group's columns repeated in front."""
    n = len(arrays[0])
    repeated = [head.column(g).take(pa.array(np.zeros(n, dtype=np.int64))) for g in groups]
    return pa.RecordBatch.from_arrays(
        repeated + [pa.array(a) for a in arrays], names=list(groups) + list(names)
    )


def _exits(t: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function from an incoming due time to the last anchor within sorted times ``t``.

    The first time after the due time becomes an anchor, then the first one more than
    ``span`` after it, and so on. Only due times up to ``t[0] + span`` can arrive, and
    equal outcomes are folded, so the function is short when chains merge.
    """
    n = len(t)
    after = np.searchsorted(t, t + span, side="right")
    end = np.where(after < n, after, np.arange(n))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    entries = min(n, int(np.searchsorted(t, t[0] + span, side="right")) + 1)
    leaves = t[end[:entries]]
    keep = np.append(leaves[1:] != leaves[:-1], True)
    return t[:entries][keep], leaves[keep]
