"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every place of a text belongs to an initial bucket, the name of the q bytes that start there,
and is refined by the names of later places: the name of 2q bytes at a place is made of the
names of q bytes there and q bytes on, and so on up to the 100 bytes that count. Names that
one round makes are used by the next.

Across documents, strings of 100 bytes meet through an anchor: the smallest 32-byte bucket
inside the string, which equal strings share at the same offset. Anchors with their context
(all strings of 100 bytes that they anchor) move in packed arrays by hash range. A context
that occurs before removes all its strings at once. Only where one anchor has several
contexts do the bytes of the first occurrence of each context move; there suffixes are sorted
in buckets that are refined on the bucket numbers of later offsets, on the bytes themselves,
and buckets of one suffix drop out. An anchor whose contexts may be more than ``REFINE_BYTES``
is divided: each of its strings moves by itself, under a 128-bit name, to a range chosen by
that name. So no task holds the bytes of all texts around one passage.

As each batch sends the first occurrence of a context only, a passage in a third of all
documents makes one entry for each batch.

Cases: null and empty texts have no bytes; rows that repeat share all results, as neither is
earlier; different texts under one doc_id are ordered by their key; a null doc_id sorts before
all others; texts of fewer than 100 bytes keep all; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_table
from . import textarrays as ta
from .exchange import ddl, exchanged, gathered, groups, hit_table, joined_ids, keyed, longs, per_document, seen_keys, touched

LENGTH = 100
ANCHOR = 32
STARTS = LENGTH - ANCHOR + 1
PLACE_BITS = 31
ANCHORS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("anchor", pa.binary()),
                     ("context", pa.binary()), ("row", pa.binary()), ("first", pa.binary()), ("count", pa.binary())])
CONTEXTS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("anchor", pa.binary()),
                      ("row", pa.binary()), ("first", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
RUN = np.dtype([("first", "<u4"), ("count", "<u4")])
NAME = np.dtype([("name", "<u8"), ("other", "<u8")])
REFINE_BYTES = 1 << 20
STRINGS = 1 << 19
CHUNK = 1 << 20
REFINE = 1 << 31
"""Set in ``count`` of a hit that asks for the bytes of its context."""
SPLIT = 1 << 30
"""Set besides ``REFINE`` where the anchor is divided: asks for the names of its strings."""
OTHER = 0x8CB92BA72F3D8DD7


def names(data: np.ndarray, lengths: tuple[int, ...], salt: int = 0) -> list[np.ndarray]:
    """64-bit names of the bytes at each place, for rising ``lengths``, each refined from the last."""
    name, covers, out = (ta.byte_values() ^ np.uint64(salt))[data], 1, []
    for length in lengths:
        while covers < length:
            step = min(covers, length - covers)  # the second half overlaps the first at the end
            n = max(0, len(name) - step)
            name = ta.mix(name[:n] * np.uint64(0xD6E8FEB86659FD93) + name[step:step + n])
            covers += step
        out.append(name)
    return out


def anchors(chunk: ta.Chunk) -> tuple[np.ndarray, ...] | None:
    """Anchor name, context name, text, first string and number of strings of every anchor."""
    sizes = np.diff(chunk.offsets)
    if not len(chunk.data) or sizes.max(initial=0) < LENGTH:
        return None
    short, whole = names(chunk.data, (ANCHOR, LENGTH))
    # Smallest name in each string, the leftmost of equal ones: names and places in one number.
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (short & ~low) | np.arange(len(short), dtype=np.uint64)
    span = 1
    while 2 * span <= STARTS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < STARTS:
        least = np.minimum(least[:len(least) - (STARTS - span)], least[STARTS - span:])
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    per = np.maximum(sizes - LENGTH + 1, 0)
    start = np.arange(len(text)) + np.repeat(chunk.offsets[:-1] - (np.cumsum(per) - per), per)
    anchor = (least[start] & low).astype(np.int64)
    first = groups(anchor, text)
    count = np.diff(np.append(first, len(anchor)))
    at, place = anchor[first], start[first]
    context = ta.mix(
        whole[place] * np.uint64(0xA24BAED4963EE407) + whole[place + count - 1] * np.uint64(0x9FB21C651E98DF25)
        + (count * 256 + (at - place)).astype(np.uint64)
    )
    # The smallest names are small numbers: spread them again before they choose a hash range.
    return ta.mix(short[at] + np.uint64(0x2545F4914F6CDD1D)), context, text[first], place - chunk.offsets[text[first]], count


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), RUN)
    out["first"], out["count"] = first, count
    return out


def anchor_rows(batch: pa.RecordBatch, parts: int):
    """First occurrence in the batch of each context; later ones are decided here."""
    keys, ids, found = longs(batch, "key"), longs(batch, "ord"), []
    for chunk in ta.chunks(batch.column("text"), CHUNK):
        if (got := anchors(chunk)) is not None:
            found.append((got[0], got[1], (chunk.first + got[2]).astype(np.uint32), got[3].astype(np.uint32), got[4].astype(np.uint8)))
    if not found:
        return
    anchor, context, row, first, count = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, keys[row], ids[row], context))
    anchor, context, row, first, count = (x[order] for x in (anchor, context, row, first, count))
    later = behind_first(ids[row], keys[row], first, context)
    for key, packed in per_document(row[later], runs(first[later], count[later]), keys):
        yield {"part": parts + key % parts, "keys": np.int64(key).tobytes(), "context": packed}
    lead = np.flatnonzero(~later)
    lead = lead[np.argsort(row[lead], kind="stable")]
    yield from ta.pieces(
        ta.part_of(anchor[lead], parts),
        {"anchor": anchor[lead].astype(np.uint32), "context": context[lead], "row": row[lead], "first": first[lead], "count": count[lead]},
        {"keys": keys.tobytes(), "ids": ids.tobytes()},
    )


def behind_first(ids, keys, first, *columns) -> np.ndarray:
    """Sorted by ``columns``, ids, keys and places: rows that are not the first of their group."""
    starts = groups(*columns) if len(ids) else np.zeros(0, np.int64)
    again = np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return (ids != ids[again]) | (keys != keys[again]) | (first != first[again])


def resolve_anchors(part: int, table: pa.Table, parts: int) -> pa.Table:
    if part >= parts:
        return hit_table(
            (int(np.frombuffer(k.as_buffer(), "<i8")[0]), c.as_py()) for k, c in zip(table.column("keys"), table.column("context"))
        )
    keys, base = joined_ids(table, "keys")
    ids, _ = joined_ids(table, "ids")
    anchor, sizes = ta.unpack(table.column("anchor"), "<u4")
    context = ta.unpack(table.column("context"), "<u8")[0]
    row = ta.unpack(table.column("row"), "<u4")[0] + np.repeat(base, sizes)
    first = ta.unpack(table.column("first"), "<u4")[0]
    count = ta.unpack(table.column("count"), "u1")[0].astype(np.uint32)
    order = np.lexsort((first, keys[row], ids[row], context, anchor))
    anchor, context, row, first, count = (x[order] for x in (anchor, context, row, first, count))
    later = behind_first(ids[row], keys[row], first, context, anchor)
    # The first of each context is compared further if its anchor has other contexts.
    new_context = np.zeros(len(anchor), bool)
    new_context[groups(context, anchor)] = True
    starts = groups(anchor)
    contexts = np.add.reduceat(new_context.astype(np.int64), starts) if len(anchor) else np.zeros(0, np.int64)
    contexts = np.repeat(contexts, np.diff(np.append(starts, len(anchor))))
    several = contexts > 1
    count[several & ~later] |= REFINE
    count[(contexts * (LENGTH + STARTS - 1) > REFINE_BYTES) & several & ~later] |= SPLIT
    out = later | several
    return hit_table(per_document(row[out], runs(first[out], count[out]), keys))


def context_rows(batch: pa.RecordBatch, parts: int):
    """Bytes of the contexts that resolve_anchors asked for, or names of their strings."""
    keys, ids = longs(batch, "key"), longs(batch, "ord")
    asked, strings = batch.column("hits"), []
    for chunk in ta.chunks(batch.column("text"), CHUNK):
        got = anchors(chunk)
        if got is None:
            continue
        anchor, _, text, first, count = got
        cuts = np.searchsorted(text, np.arange(len(chunk.offsets)))
        found, divided = [], []
        for t in range(len(chunk.offsets) - 1):
            hits = np.unique(ta.unpack(asked[chunk.first + t], RUN)[0])
            a, b = cuts[t], cuts[t + 1]
            own = a + np.flatnonzero(np.isin(first[a:b], hits["first"][hits["count"] >= REFINE]))
            alone = np.isin(first[own], hits["first"][hits["count"] >= REFINE | SPLIT])
            found.append(own[~alone])
            divided.append(own[alone])
        own = np.concatenate(divided) if divided else np.zeros(0, np.int64)
        if len(own):
            strings.append(string_names(chunk, text[own], first[own], count[own]))
            if sum(len(x[0]) for x in strings) >= STRINGS:
                yield from string_rows(strings, keys, ids, parts)
                strings = []
        own = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(own):
            continue
        part = ta.part_of(anchor[own], parts)
        own = own[np.argsort(part, kind="stable")]
        part = ta.part_of(anchor[own], parts)
        begin = chunk.offsets[text[own]] + first[own]
        size = count[own] + LENGTH - 1
        spread = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        body, ends = chunk.data[spread], np.concatenate(([0], np.cumsum(size)))
        starts = groups(part)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
            mine = own[a:b]
            rows = np.unique(text[mine])
            yield {
                "part": int(part[a]), "keys": keys[chunk.first + rows].tobytes(), "ids": ids[chunk.first + rows].tobytes(),
                "anchor": anchor[mine].astype(np.uint32).tobytes(),
                "row": np.searchsorted(rows, text[mine]).astype(np.uint32).tobytes(),
                "first": first[mine].astype(np.uint32).tobytes(), "size": size[a:b].astype(np.uint32).tobytes(),
                "bytes": body[ends[a]:ends[b]].tobytes(),
            }
    if strings:
        yield from string_rows(strings, keys, ids, parts)


def string_names(chunk: ta.Chunk, text, first, count) -> tuple[np.ndarray, ...]:
    """Name, row of the batch and place of every string of the contexts."""
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    body = chunk.data[np.arange(size.sum()) + np.repeat(chunk.offsets[text] + first - begin, size)]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = inside + np.repeat(begin, count)
    name = np.zeros(len(at), NAME)
    name["name"], name["other"] = names(body, (LENGTH,))[0][at], names(body, (LENGTH,), OTHER)[0][at]
    return name, np.repeat(chunk.first + text, count), np.repeat(first, count) + inside


def string_rows(strings: list[tuple], keys: np.ndarray, ids: np.ndarray, parts: int):
    """First occurrence of each string among these; later ones are decided here."""
    name, row, first = (np.concatenate(x) for x in zip(*strings))
    order = np.lexsort((first, keys[row], ids[row], name["other"], name["name"]))
    name, row, first = name[order], row[order], first[order]
    later = behind_first(ids[row], keys[row], first, name["name"], name["other"])
    for key, packed in per_document(row[later], runs(first[later], np.ones(int(later.sum()))), keys):
        yield {"part": 2 * parts + key % parts, "keys": np.int64(key).tobytes(), "bytes": packed}
    # Sorted by name, and so by range.
    name, row, first = name[~later], row[~later], first[~later]
    part = ta.part_of(name["name"], parts)
    starts = groups(part)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        rows = np.unique(row[a:b])
        yield {
            "part": parts + int(part[a]), "keys": keys[rows].tobytes(), "ids": ids[rows].tobytes(),
            "row": np.searchsorted(rows, row[a:b]).astype(np.uint32).tobytes(),
            "first": first[a:b].astype(np.uint32).tobytes(), "bytes": name[a:b].tobytes(),
        }


def refined(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket number of the ``length`` bytes at each of ``starts``: equal strings, equal number.

    The first buckets are the eight-byte strings at every place, in order. Each round sorts
    suffixes on their own bucket and the bucket at the offset already covered, which doubles
    what a bucket covers; the last round overlaps. Suffixes alone in their bucket stay there.
    """
    loads = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)) if len(data) >= 8 else np.zeros(0, np.uint64)
    bucket = np.unique(loads, return_inverse=True)[1].astype(np.uint64)
    covers = 8
    while covers < length:
        step = min(covers, length - covers)
        n = max(0, len(bucket) - step)
        pair = (bucket[:n] << np.uint64(32)) | bucket[step:step + n]
        alone = np.bincount(bucket[:n].astype(np.int64), minlength=1)[bucket[:n].astype(np.int64)] == 1
        fresh = np.empty(n, np.uint64)
        values, inverse = np.unique(pair[~alone], return_inverse=True)
        fresh[~alone] = inverse
        fresh[alone] = len(values) + np.arange(int(alone.sum()))
        bucket, covers = fresh, covers + step
    return bucket[starts]


def resolve_contexts(part: int, table: pa.Table, parts: int) -> pa.Table:
    """Strings of differing contexts under one anchor that occur before."""
    if part >= 2 * parts:
        return hit_table(
            (int(np.frombuffer(k.as_buffer(), "<i8")[0]), c.as_py()) for k, c in zip(table.column("keys"), table.column("bytes"))
        )
    keys, base = joined_ids(table, "keys")
    ids, _ = joined_ids(table, "ids")
    row, sizes = ta.unpack(table.column("row"), "<u4")
    row = row + np.repeat(base, sizes)
    first = ta.unpack(table.column("first"), "<u4")[0].astype(np.int64)
    if part >= parts:
        return resolve_strings(ta.unpack(table.column("bytes"), NAME)[0], row, first, keys, ids)
    anchor = ta.unpack(table.column("anchor"), "<u4")[0]
    size = ta.unpack(table.column("size"), "<u4")[0].astype(np.int64)
    data = ta.unpack(table.column("bytes"), "u1")[0]
    begin = np.cumsum(size) - size
    # Anchors of one range in slices of bounded bytes; those that would not fit are divided before.
    order = np.argsort(anchor, kind="stable")
    total = np.cumsum(size[order])
    slice_of = total // REFINE_BYTES
    head = groups(anchor[order])
    slice_of = np.repeat(slice_of[head], np.diff(np.append(head, len(order))))
    out = []
    cuts = groups(slice_of)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = order[a:b]
        lengths = size[own]
        spread = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[own], lengths)
        strings = lengths - LENGTH + 1
        inside = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        starts = inside + np.repeat(np.cumsum(lengths) - lengths, strings)
        bucket = refined(data[spread], starts)
        owner = np.repeat(row[own], strings)
        place = np.repeat(first[own], strings) + inside
        sort = np.lexsort((place, keys[owner], ids[owner], bucket))
        owner, place, bucket = owner[sort], place[sort], bucket[sort]
        later = behind_first(ids[owner], keys[owner], place, bucket)
        out.append((owner[later], place[later]))
    owner, place = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return hit_table(per_document(owner, runs(place, np.ones(len(place))), keys))


def resolve_strings(name: np.ndarray, row, first, keys, ids) -> pa.Table:
    """Strings of divided anchors that occur before, in slices of whole names."""
    order = np.argsort(name["name"])
    head = groups(name["name"][order]) if len(order) else np.zeros(0, np.int64)
    cuts = head[groups(head // STRINGS)] if len(head) else head
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = order[a:b]
        own = own[np.lexsort((first[own], keys[row[own]], ids[row[own]], name["other"][own], name["name"][own]))]
        owner, place = row[own], first[own]
        later = behind_first(ids[owner], keys[owner], place, name["name"][own], name["other"][own])
        out.append((owner[later], place[later]))
    owner, place = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return hit_table(per_document(owner, runs(place, np.ones(len(place))), keys))


def removed_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of removed strings (first start, number of starts) by text: of whole contexts, of parts."""
    texts = keyed(docs).select("key", "ord", "text")
    parts = ta.range_count(texts, limit=ta.RANGE_BYTES // 2)

    def send_anchors(batches):
        for batch in batches:
            yield from ta.batches_of(anchor_rows(batch, parts), ANCHORS)

    def send_contexts(batches):
        for batch in batches:
            yield from ta.batches_of(context_rows(batch, parts), CONTEXTS)

    met = shared_table(exchanged(texts.mapInArrow(send_anchors, ddl(ANCHORS)), resolve_anchors, parts))
    near = touched(texts, seen_keys(met)).join(gathered(met), "key")
    return met, shared_table(exchanged(near.mapInArrow(send_contexts, ddl(CONTEXTS)), resolve_contexts, parts))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every document with its removed bytes: counts, maximal removed spans, remaining bytes."""
    def apply(batches):
        for batch in batches:
            docs_, sizes, removed, spans, kept = [], [], [], [], []
            for doc, text, hits in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("hits")):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                edge = np.zeros((0, 2), np.int64)
                gone = np.zeros(len(data), bool)
                if hits.is_valid:
                    found = ta.unpack(hits, RUN)[0]
                    found = found[found["count"] < REFINE]
                    gone = ta.covered(
                        found["first"].astype(np.int64), found["count"].astype(np.int64) + LENGTH - 1, len(data)
                    )
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                docs_.append(doc)
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(edge.tolist())
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()),
            ], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    met, parts = removed_bytes(docs)
    found = met.unionByName(parts)
    texts = keyed(docs).select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    seen = seen_keys(found)
    joined = touched(texts, seen).join(gathered(found), "key", "left").select("doc_id", "text", "hits")
    rest = touched(texts, seen, False).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("hits"))
    done = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary"
    return joined.mapInArrow(apply, done).unionByName(rest.mapInArrow(apply, done))


def op9_bucket_pointer_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
