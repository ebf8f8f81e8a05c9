"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are windows of ten consecutive words of the benchmark items. Texts and patterns are
normalised alike: A-Z lowered, every run of bytes that are no word bytes one space. A shift
table over blocks of up to eight bytes tells how far the search may skip; where it may not,
the block's suffix-hash bucket selects test strings, their first bytes are compared, and
direct comparison of the whole pattern and of the word bounds confirms an occurrence. The
search runs over many places of a chunk at once, each lane skipping by its own shifts.

Patterns are grouped by length, so that a short item does not shorten all shifts. The
benchmark is read in blocks of items of about ``BLOCK_BYTES``; each block's tables are
broadcast (their size is bounded by the block) and meet all documents in one pass without a
shuffle. With one block, documents are read once.

Cases: null and empty texts have no words; an item without words never occurs; an item with
a null id marks words but is not named; repeated rows get equal results; an empty benchmark
hits nothing; a column named like the result is replaced, all others pass through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sizing import shared_table
from . import textarrays as ta

WINDOW = 10
BLOCK_BYTES = 4 << 20
TABLE_BITS = 18
LANE_BYTES = 2048
RESULT = "contamination"
RESULT_TYPE = "struct<n_words: bigint, hit_words: array<bigint>, items: array<bigint>>"
SEPARATOR = 1

#: Word bytes: 0-9, a-z (after lowering) and every byte of a non-ASCII character.
NORMAL = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    NORMAL[_b] = _b
for _b in range(0x41, 0x5B):
    NORMAL[_b] = _b + 32


class Class(NamedTuple):
    """Search tables of the patterns of one length class."""

    m: int
    block: int
    shift: np.ndarray
    bucket_start: np.ndarray
    bucket_size: np.ndarray
    order: np.ndarray
    heads: np.ndarray
    head_bytes: int


class Patterns(NamedTuple):
    texts: list[bytes]
    words: np.ndarray
    items: list[list[int]]
    classes: list[tuple[np.ndarray, Class]]


def normal_words(text: str | None) -> list[bytes]:
    return NORMAL[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def windows(items: list[tuple[int | None, str | None]]) -> dict[bytes, tuple[int, list[int]]]:
    """Distinct windows with their word count and the ids of the items that hold them."""
    out: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            part = words[i:i + WINDOW]
            held = out.setdefault(b" ".join(part), (len(part), set()))[1]
            if item is not None:
                held.add(item)
    return {k: (n, sorted(ids)) for k, (n, ids) in out.items()}


def plain(patterns: Patterns) -> tuple:
    """Without classes of this package, which executors need not have."""
    return (patterns.texts, patterns.words, patterns.items, [(own, tuple(c)) for own, c in patterns.classes])


def from_plain(value: tuple) -> Patterns:
    return Patterns(*value[:3], [(own, Class(*c)) for own, c in value[3]])


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


def _hash(blocks: np.ndarray) -> np.ndarray:
    return ta.mix(blocks.copy()) >> np.uint64(64 - TABLE_BITS)


def _loads(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place, little-endian, over a buffer padded by eight bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def build(found: dict[bytes, tuple[int, list[int]]]) -> Patterns:
    texts = sorted(found)
    lengths = np.array([len(t) for t in texts], np.int64)
    classes = []
    tiers = np.minimum(np.log2(np.maximum(lengths, 1)).astype(np.int64), 5)
    for tier in np.unique(tiers):
        own = np.flatnonzero(tiers == tier)
        m = int(lengths[own].min())
        block = 8 if m >= 16 else max(1, m // 2)
        heads = np.array([np.frombuffer(texts[i][:m].ljust(m + 8, b"\0"), np.uint8) for i in own])
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint16)
        for end in range(block - 1, m):
            at = end - block + 1
            values = np.ascontiguousarray(heads[:, at:at + 8]).view("<u8")[:, 0] & _mask(block)
            hashed = _hash(values)
            np.minimum.at(shift, hashed, np.uint16(m - 1 - end))
        order = np.argsort(hashed, kind="stable")  # hashed: the block at the end of each head
        size = np.bincount(hashed, minlength=1 << TABLE_BITS)
        head_bytes = min(8, m)
        first = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0] & _mask(head_bytes)
        classes.append((own, Class(m, block, shift, np.cumsum(size) - size, size, order, first, head_bytes)))
    return Patterns(
        texts, np.array([found[t][0] for t in texts], np.int64), [found[t][1] for t in texts], classes
    )


def search(data: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(place, pattern) of every occurrence in normalised bytes, word bounds checked."""
    loads, n = _loads(data), len(data)
    body = data.tobytes()
    places, which = [], []
    for own, c in patterns.classes:
        at = np.arange(0, n, LANE_BYTES, dtype=np.int64)
        stop = np.minimum(at + LANE_BYTES, n) + c.m - 1
        stop[stop > n] = n
        at += c.m - 1
        zero = []
        while True:
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
            if not len(at):
                break
            step = c.shift[_hash(loads[at - c.block + 1] & _mask(c.block))].astype(np.int64)
            hit = step == 0
            if hit.any():
                zero.append(at[hit])
            at = at + np.maximum(step, 1)
        if not zero:
            continue
        ends = np.concatenate(zero)
        hashed = _hash(loads[ends - c.block + 1] & _mask(c.block))
        sizes = c.bucket_size[hashed]
        begin = np.repeat(ends - c.m + 1, sizes)
        skip = np.arange(len(begin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        test = c.order[np.repeat(c.bucket_start[hashed], sizes) + skip]
        same = (loads[begin] & _mask(c.head_bytes)) == c.heads[test]
        for place, k in zip(begin[same].tolist(), own[test[same]].tolist()):
            text = patterns.texts[k]
            after = place + len(text)
            if (body.startswith(text, place) and (place == 0 or body[place - 1] in (0x20, SEPARATOR))
                    and (after >= n or body[after] in (0x20, SEPARATOR))):
                places.append(place)
                which.append(k)
    return np.array(places, np.int64), np.array(which, np.int64)


def scan(column: pa.Array, patterns: Patterns) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
    """Per text: words, numbers of the hit words, ids of the occurring items."""
    counts, hits, items = [], [], []
    for chunk in ta.chunks(column):
        normal = NORMAL[chunk.data]
        texts = len(chunk.offsets) - 1
        normal = np.insert(normal, chunk.offsets[1:], SEPARATOR)
        blank = normal == 0x20
        keep = np.ones(len(normal), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        normal = normal[keep]
        edge = (normal == 0x20) | (normal == SEPARATOR)
        first = ~edge
        first[1:] &= edge[:-1]
        starts = np.flatnonzero(first)
        bounds = np.flatnonzero(normal == SEPARATOR)
        upto = np.searchsorted(starts, bounds)
        n_words = np.diff(upto, prepend=0)
        counts.append(n_words)
        places, which = search(normal, patterns)
        word = np.searchsorted(starts, places)
        text_of = np.searchsorted(bounds, places)
        hit = ta.covered(word, patterns.words[which], len(starts))
        hit_words, before = np.flatnonzero(hit), upto - n_words
        cut = np.searchsorted(hit_words, upto)
        by_text: dict[int, set] = {}
        for t, k in zip(text_of.tolist(), which.tolist()):
            by_text.setdefault(t, set()).update(patterns.items[k])
        for t in range(texts):
            hits.append(hit_words[cut[t - 1] if t else 0:cut[t]] - before[t])
            items.append(sorted(by_text.get(t, ())))
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), hits, items


def _item_blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks of about ``block_bytes`` (one item may be larger), one after the other."""
    lean = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // block_bytes))
    for b in range(count):
        mine = lean if count == 1 else lean.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield count, [(r["item_id"], r["text"]) for r in mine.collect()]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``contamination``: words, numbers of the hit words and ids of the occurring items."""
    out = docs.drop(RESULT)
    schema = StructType.fromDDL(f"{RESULT} {RESULT_TYPE}")
    out = out.withColumn(RESULT, F.lit(None).cast(RESULT_TYPE))
    whole = StructType([*docs.drop(RESULT).schema.fields, *schema.fields])
    kind = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])
    for count, items in _item_blocks(benchmark, block_bytes):
        patterns = docs.sparkSession.sparkContext.broadcast(plain(build(windows(items))))

        def run(batches, patterns=patterns):
            tables = from_plain(patterns.value)
            for batch in batches:
                n_words, hits, found = scan(batch.column(text), tables)
                earlier = batch.column(RESULT).to_pylist()
                cells = [
                    {
                        "n_words": int(n), "hit_words": np.union1d(h, e["hit_words"]) if e else h,
                        "items": sorted({*i, *e["items"]}) if e else i,
                    } for n, h, i, e in zip(n_words, hits, found, earlier)
                ]
                place = batch.schema.get_field_index(RESULT)
                yield batch.set_column(place, RESULT, pa.array(cells, kind))

        out = out.mapInArrow(run, whole)
        if count > 1:
            out = shared_table(out)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns."""
    return mark(docs, benchmark).filter(F.size(f"{RESULT}.hit_words") == 0).select(*docs.columns)


def op1_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark windows in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.col(f"{RESULT}.items")
    hits = F.size(f"{RESULT}.hit_words").cast("long")
    return found.select(
        "doc_id", F.col(f"{RESULT}.n_words").alias("n_words"), hits.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def _words_sql(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
g AS (SELECT item_id, len(w[i:i + {WINDOW - 1}]) AS k, w[i:i + {WINDOW - 1}] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT DISTINCT r, i, k, item_id FROM (SELECT r, i, k.k AS n, w[i:i + k.k - 1] AS x FROM p, (SELECT DISTINCT k FROM g) k
  WHERE i + k.k - 1 <= len(w)) q JOIN g ON q.n = g.k AND q.x = g.g),
h AS (SELECT r, count(DISTINCT i + j) AS n FROM m, range({WINDOW}) t(j) WHERE j < k GROUP BY r),
s AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
