"""Exchange of packed arrays by hash range, and what operators on whole texts share around it.

A text sends rows of packed hashes, one row for each hash range and batch; one task resolves a
range and returns packed findings for each text; texts are joined with their findings by a
key of their own. ``touched`` keeps texts without findings out of that join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta

SKETCH_BITS = 20
SLICES = 64
HIT = "key long, hits binary"
PACKED = pa.schema([("texts", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("hits", pa.binary())])
ARROW_HIT = pa.schema([("key", pa.int64()), ("hits", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def keyed(docs: DataFrame) -> DataFrame:
    """Key of each different (id, text), order of the ids, text."""
    return docs.select(
        ta.text_key("doc_id", "text").alias("key"), ta.order_id("doc_id").alias("ord"), F.col("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def per_document(rows: np.ndarray, values: np.ndarray, keys: np.ndarray):
    """(key, packed values) of each document among ``rows``."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    starts = groups(rows) if len(rows) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        yield int(keys[rows[a]]), values[a:b].tobytes()


def direct_rows(rows, values, keys, parts: int):
    """What a batch has decided, sent along in hash ranges of its own behind the others."""
    for key, packed in per_document(rows, values, keys):
        yield {"part": parts + key % parts, "keys": np.int64(key).tobytes(), "hash": packed}


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_ids(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed 8-byte values of all rows in one array, and where each row's begin."""
    values, sizes = ta.unpack(table.column(name), "<i8")
    return values, np.cumsum(sizes) - sizes


def hit_table(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    schema=ARROW_HIT)


def exchanged(sent: DataFrame, resolve, parts: int) -> DataFrame:
    """Packed rows to one task for each hash range, and what it finds for each document."""

    def run(key, table):
        out = resolve(key[0].as_py(), table, parts)
        ta.give_back()
        return out

    return sent.groupBy("part").applyInArrow(run, HIT)


def exchanged_by_text(sent: DataFrame, resolve, parts: int) -> DataFrame:
    """:func:`exchanged` with one row for each document that has findings, whatever the number of hash ranges.

    A range answers each of ``parts`` groups of documents with one packed row; a group's rows then meet
    and are merged by document.
    """

    def run(key, table):
        found = resolve(key[0].as_py(), table, parts)
        keys, hits = found.column("key").to_numpy(), found.column("hits").to_pylist()
        group = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(group, kind="stable")
        starts = groups(group[order]) if len(keys) else np.zeros(0, np.int64)
        out = [
            (int(group[own[0]]), keys[own].tobytes(), np.array([len(hits[i]) for i in own], "<i4").tobytes(), b"".join(hits[i] for i in own))
            for own in np.split(order, starts[1:]) if len(own)
        ]
        ta.give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, PACKED)], schema=PACKED)

    def merge(key, table):
        keys, _ = ta.unpack(table.column("keys"), "<i8")
        sizes = ta.unpack(table.column("sizes"), "<i4")[0].astype(np.int64)
        body = b"".join(c.as_buffer() for c in table.column("hits"))
        ends = np.cumsum(sizes)
        order = np.argsort(keys, kind="stable")
        starts = groups(keys[order])
        out = hit_table(
            (int(keys[own[0]]), b"".join(body[ends[i] - sizes[i]:ends[i]] for i in own)) for own in np.split(order, starts[1:])
        )
        ta.give_back()
        return out

    return sent.groupBy("part").applyInArrow(run, ddl(PACKED)).groupBy("texts").applyInArrow(merge, HIT)


def gathered(hits: DataFrame) -> DataFrame:
    return hits.groupBy("key").agg(F.collect_list("hits").alias("hits"))


def sketch_of(values: DataFrame, hashes_of) -> np.ndarray:
    """Counts in ``2**SKETCH_BITS`` slots of the hashes that ``hashes_of`` yields for a batch.

    Tasks count into sketches of fixed size, which are added up slice by slice in two steps.
    """
    size = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for hashes in hashes_of(batch):
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        step = size // SLICES
        yield pa.RecordBatch.from_pylist([
            {"slice": i, "shard": TaskContext.get().partitionId() % 64, "counts": total[i * step:(i + 1) * step].tobytes()}
            for i in range(SLICES)
        ], schema=pa.schema([("slice", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary())]))

    def add(key, data):
        total = sum(np.frombuffer(c.as_buffer(), "<i8") for c in data.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = values.mapInArrow(count, "slice int, shard int, counts binary")
    summed = parts.groupBy("slice", "shard").applyInArrow(add, "slice int, counts binary").groupBy("slice").applyInArrow(
        add, "slice int, counts binary"
    )
    out = np.zeros(size, np.int64)
    for row in summed.collect():  # SLICES rows of fixed size
        out[row["slice"] * size // SLICES:(row["slice"] + 1) * size // SLICES] = np.frombuffer(row["counts"], "<i8")
    return out


def seen_keys(hits: DataFrame) -> np.ndarray:
    """Which slots of a table of fixed size the keys of ``hits`` fall into."""
    return sketch_of(hits.select("key"), lambda b: [longs(b, "key").astype(np.uint64)]) > 0


def touched(texts: DataFrame, seen: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows of ``texts`` whose key's slot is (or is not) in use, so that the rest never is shuffled.

    The table has a fixed size; a slot in use by another key only lets a row through.
    """
    slots = texts.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches):
        used = np.unpackbits(slots.value).astype(bool)
        for batch in batches:
            own = used[(longs(batch, "key").astype(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            yield batch.filter(pa.array(own == inside))

    return texts.mapInArrow(run, texts.schema)
