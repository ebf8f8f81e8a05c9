"""Removal of repeated word runs by fixed-block anchors.

A run of thirteen words repeats if an earlier document holds the same run. Each text is an
index of non-overlapping reference blocks of seven words, and every rolling window of seven
words probes that index: a repeat of thirteen words, however it lies, holds one whole block
of the earlier text. Hits are extended to maximal exact repeats: around each hit all runs of
thirteen words that hold it are compared exactly (by 96-bit hashes), and runs that repeat
join to maximal repeats. A run is kept in the document with the smallest id.

Hashes move in packed arrays by hash range, never one row each. Before they move, each batch
of about 4 MB of text is reduced: of a hash that several of its documents share only one entry goes out, and what
the batch can decide by itself goes straight back to its documents. So a passage in a third
of all documents makes one entry for each batch, not for each document. Texts are joined
with their hits by a key of their own, which is never hot.

Cases: null and empty texts have no words; equal doc_ids never count as earlier, so repeated
rows get equal results; a null doc_id sorts before all others; texts of fewer than thirteen
words keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_table
from . import textarrays as ta
from .exchange import (
    ddl, direct_rows, exchanged, exchanged_by_text, gathered, groups, hit_table, joined_ids, keyed, longs, per_document, seen_keys, touched,
)

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
PART = 3
CHECK_SEED = 0x9FB21C651E98DF25
PROBES = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("hash", pa.binary()), ("row", pa.binary())])
RUNS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("hash", pa.binary()),
                  ("check", pa.binary()), ("row", pa.binary()), ("place", pa.binary())])


def codes(words: np.ndarray, parts: int) -> np.ndarray:
    """Code of each run of seven words: hash range and lower half of the hash but its last bit, which the first
    exchange compares.

    The range is that of the least hash among the run's three-word parts. Neighbouring runs often share
    it, so a passage goes to few ranges and is answered with few rows, however many ranges there are.
    """
    hashes, parts_of_run = ta.rolling(words, BLOCK), ta.rolling(words, PART)
    if not len(hashes):
        return hashes
    least = parts_of_run[:len(hashes)].copy()
    for j in range(1, BLOCK - PART + 1):
        np.minimum(least, parts_of_run[j:j + len(hashes)], out=least)
    return (ta.part_of(ta.mix(least), parts).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFE))


def probe_rows(batch: pa.RecordBatch, parts: int):
    """Seven-word hashes of a batch: reference blocks and rolling windows, once for each hash."""
    keys, found = longs(batch, "key"), []
    for chunk in ta.chunks(batch.column("text")):
        words = ta.split_words(chunk)
        rolled = codes(ta.word_hashes(chunk.data, words), parts)
        first = np.searchsorted(words.text, words.text, "left")
        place = (np.arange(len(words.text)) - first)[:len(rolled)]
        ok = ta.within(words.text, BLOCK)
        found.append((rolled[ok], (chunk.first + words.text[:len(rolled)])[ok].astype(np.uint32), place[ok] % BLOCK == 0))
    if not found:
        return
    hashes, rows, aligned = (np.concatenate(x) for x in zip(*found))
    if not len(hashes):
        return
    order = np.argsort(hashes)
    hashes, rows, aligned = hashes[order], rows[order], aligned[order]
    starts = groups(hashes)
    low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
    several = low != high
    flags = np.maximum.reduceat(aligned.astype(np.uint8), starts) | several
    sizes = np.diff(np.append(starts, len(hashes)))
    local = np.repeat(several, sizes)
    yield from direct_rows(rows[local], hashes[local], keys, parts)
    one = hashes[starts].astype(np.uint32) | flags.astype(np.uint32)
    # In the order of rows, which then take next to no room.
    order = np.argsort(low, kind="stable")
    yield from ta.pieces(
        (hashes[starts] >> np.uint64(32)).astype(np.uint32)[order], {"hash": one[order], "row": low[order]},
        {"keys": keys.tobytes()},
    )


def passed_on(table: pa.Table) -> pa.Table:
    return hit_table(
        (int(np.frombuffer(k.as_buffer(), "<i8")[0]), h.as_py()) for k, h in zip(table.column("keys"), table.column("hash"))
    )


def resolve_probes(part: int, table: pa.Table, parts: int) -> pa.Table:
    """Hits of one hash range: hashes of several documents of which one has a block there."""
    if part >= parts:
        return passed_on(table)
    keys, base = joined_ids(table, "keys")
    hashes, sizes = ta.unpack(table.column("hash"), "<u4")
    rows = ta.unpack(table.column("row"), "<u4")[0] + np.repeat(base.astype(np.uint32), sizes)
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] >> np.uint32(1) == ordered[:-1] >> np.uint32(1)
    # A batch sends a hash once: what stands alone is of no other batch.
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    flags, hashes, rows = ordered[again] & np.uint32(1), ordered[again] & np.uint32(0xFFFFFFFE), rows[order[again]]
    if not len(hashes):
        return hit_table(())
    starts = groups(hashes)
    count = np.diff(np.append(starts, len(hashes)))
    shared = (count > 1) & (np.maximum.reduceat(flags, starts) > 0)
    own = np.repeat(shared, count)
    code = hashes[own].astype(np.uint64) | np.uint64(part << 32)
    return hit_table(per_document(rows[own], code, keys))


def run_rows(batch: pa.RecordBatch, parts: int, ranges: int, window: int = WINDOW):
    """Runs of thirteen words around hits, for ``ranges`` hash ranges; runs that repeat within the
    batch are decided here."""
    keys, ids, found = longs(batch, "key"), longs(batch, "ord"), []
    hits = batch.column("hits")
    for chunk in ta.chunks(batch.column("text")):
        words = ta.split_words(chunk)
        hashes = ta.word_hashes(chunk.data, words)
        code = codes(hashes, parts)
        runs, check = ta.rolling(hashes, window), ta.rolling(hashes, window, CHECK_SEED)
        cuts = np.searchsorted(words.text, np.arange(len(chunk.offsets)))
        for t in range(len(chunk.offsets) - 1):
            a, n = cuts[t], cuts[t + 1] - cuts[t]
            if n < window:
                continue
            row = chunk.first + t
            near = np.flatnonzero(np.isin(code[a:a + n - BLOCK + 1], ta.unpack(hits[row], "<u8")[0]))
            holds = ta.covered(near, BLOCK, n + BLOCK)[BLOCK - 1:n + BLOCK - window]
            place = np.flatnonzero(holds)
            found.append((runs[a + place], check[a + place].astype(np.uint32), np.full(len(place), row, np.uint32),
                          place.astype(np.uint32)))
    if not found:
        return
    runs, check, rows, places = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids[rows], check, runs))
    runs, check, rows, places = runs[order], check[order], rows[order], places[order]
    later = after_first(ids[rows], runs, check)
    yield from direct_rows(rows[later], places[later], keys, ranges)
    keep = ~later
    yield from ta.pieces(
        ta.part_of(runs[keep], ranges),
        {"hash": runs[keep], "check": check[keep], "row": rows[keep], "place": places[keep]},
        {"keys": keys.tobytes(), "ids": ids.tobytes()},
    )


def after_first(ids: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Rows, sorted by ``columns`` and then ``ids``, whose id is above the least of their group."""
    if not len(ids):
        return np.zeros(0, bool)
    starts = groups(*columns)
    return ids > np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))


def resolve_runs(part: int, table: pa.Table, parts: int) -> pa.Table:
    if part >= parts:
        return passed_on(table)
    keys, base = joined_ids(table, "keys")
    ids, _ = joined_ids(table, "ids")
    runs, sizes = ta.unpack(table.column("hash"), "<u8")
    check = ta.unpack(table.column("check"), "<u4")[0]
    rows = ta.unpack(table.column("row"), "<u4")[0] + np.repeat(base, sizes)
    places = ta.unpack(table.column("place"), "<u4")[0]
    order = np.lexsort((ids[rows], check, runs))
    runs, check, rows, places = runs[order], check[order], rows[order], places[order]
    later = after_first(ids[rows], runs, check)
    return hit_table(per_document(rows[later], places[later], keys))


def removed_words(docs: DataFrame) -> DataFrame:
    """``key``, and packed first words of runs to be removed from that text."""
    texts = keyed(docs).select("key", "ord", "text")
    parts = ta.range_count(texts, limit=ta.RANGE_BYTES // 2)
    ranges = max(8, parts // 4)  # runs around hits are fewer, and each range answers a text with a row

    def probe(batches):
        for batch in batches:
            for part in ta.slices(batch, "text"):
                yield from ta.batches_of(probe_rows(part, parts), PROBES)

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, "text"):
                yield from ta.batches_of(run_rows(part, parts, ranges), RUNS)

    hits = shared_table(exchanged_by_text(texts.select("key", "text").mapInArrow(probe, ddl(PROBES)), resolve_probes, parts))
    near = touched(texts, seen_keys(hits)).join(gathered(hits), "key")
    return shared_table(exchanged(near.mapInArrow(run, ddl(RUNS)), resolve_runs, ranges))


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with its removed runs: counts, maximal removed word spans, kept words."""

    def apply(batches):
        for batch in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "kept": []}
            for doc, text, hits in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("hits")):
                words = (text or "").encode().split()
                n = len(words)
                gone = np.zeros(n, bool)
                if hits.is_valid:
                    gone = ta.covered(ta.unpack(hits, "<u4")[0].astype(np.int64), window, n + window)[:n]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                out["doc_id"].append(doc)
                out["n_words"].append(n)
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append(edge.reshape(-1, 2))
                out["kept"].append(b" ".join(compress(words, ~gone) if len(edge) else words))
            yield pa.RecordBatch.from_arrays([
                pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array([[list(map(int, p)) for p in s] for s in out["spans"]], pa.list_(pa.list_(pa.int64()))),
                pa.array(out["kept"], pa.binary()),
            ], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    removed = removed_words(docs)
    texts, seen = keyed(docs).select("key", F.col("doc_id").cast("long").alias("doc_id"), "text"), seen_keys(removed)
    joined = touched(texts, seen).join(gathered(removed), "key", "left").select("doc_id", "text", "hits")
    rest = touched(texts, seen, False).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("hits"))
    done = "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept binary"
    return joined.mapInArrow(apply, done).unionByName(rest.mapInArrow(apply, done)).withColumn(
        "kept", F.col("kept").cast("string")
    )


def op6_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE doc_id > first),
c AS (SELECT DISTINCT r, i + j AS i FROM f, range({WINDOW}) t(j)),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""
