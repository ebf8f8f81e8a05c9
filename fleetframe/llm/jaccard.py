"""Near-duplicate join: token-combination prefixes on sets of five-word shingles.

Two documents link when 100 * |A & B| >= 75 * |A | B|. A set of n shingles that links shares
at least ceil(3n/4) of them, so in any common order the first n - ceil(3n/4) + 1 + m
shingles (an extended prefix) of two linked sets share at least m + 1.

1. Sets are collapsed to one representative of equal sets. In hash order, a set links with
   nothing and is done if too few shingles of its extended prefix occur in other prefixes.
2. A sketch of fixed size estimates how frequent each shingle is; the rest is ordered rare
   first. The hundredth that most sets hold is frequent. Rare shingles of the extended prefix are indexed alone. Frequent ones fall into m
   classes, and the 2-combinations within a class are indexed: m + 1 shared frequent
   shingles have two in one class. m grows with the set, so a set has O(n) combinations.
3. In each bucket a histogram of each set bounds the intersection from above. A search
   from pivots finds families of sets that may link, and emits a spanning edge for each set,
   never all pairs. Buckets above ``BUCKET_ROWS`` are cut into tiles that still let every two
   members meet.
4. Families (components of those edges) bring their whole sets together once and the same
   search verifies with exact intersections; large families are cut into tiles too. Verified
   links give the final components.

No step compares approximately for the result: sketches and histograms only choose what is
compared. Shingles and sets are known by 64-bit hashes. Components are found by alternating
large-star and small-star steps on tables in the shared folder.

Cases: null and empty texts have no shingles and are their own component; texts of one to
four words are one shingle; repeated rows and equal texts share a component; a null doc_id
counts as the smallest id and shows as null; an empty table gives no rows; other columns are
ignored by ``link`` and kept by ``first_of_each``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_table
from . import textarrays as ta
from .exchange import SKETCH_BITS, ddl, groups, joined_ids, keyed, longs, seen_keys, sketch_of, touched

SHINGLE = 5
FREQUENT_SHARE = 0.01
"""Share of the shingles that count as frequent, those that most sets hold; the others are indexed alone."""
RARE = 3
"""Sets that a shingle is in at least to be frequent, whatever its share."""
BUCKET_ROWS = 4096
FAMILY_ROWS = 2000
PREFIXES = pa.schema([("doc_id", pa.int64()), ("ord", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()),
                      ("part", pa.int32()), ("keys", pa.binary()), ("hash", pa.binary()), ("row", pa.binary())])
BUCKETS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("size", pa.binary()), ("width", pa.binary()),
                     ("hist", pa.binary()), ("hash", pa.binary()), ("row", pa.binary())])


def overlap_needed(n):
    """Shared shingles that a linked set of ``n`` has at least."""
    return (3 * n + 3) // 4


def linked(shared, n, m):
    """100 * shared >= 75 * (n + m - shared), in whole numbers."""
    return 7 * shared >= 3 * (n + m)


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of each text."""
    for chunk in ta.chunks(column):
        words = ta.split_words(chunk)
        hashes = ta.word_hashes(ta.lower(chunk.data), words)
        rolled = {k: ta.rolling(hashes, k, 0x2545F4914F6CDD1D + 2 * k) for k in range(1, SHINGLE + 1)}
        cuts = np.searchsorted(words.text, np.arange(len(chunk.offsets)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = min(SHINGLE, b - a)
            yield np.unique(rolled[k][a:b - k + 1]) if k else np.zeros(0, np.uint64)


def signature(values: np.ndarray) -> int:
    spread = ta.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    total = np.array([np.add.reduce(spread) ^ (np.bitwise_xor.reduce(spread) << np.uint64(1)) ^ np.uint64(len(values))])
    return int(ta.mix(total).astype(np.int64)[0])


def extension(n):
    """Shingles that extend the hash-order prefix of a set of ``n``."""
    return n // 8


def prefix_table(docs: DataFrame, parts: int) -> DataFrame:
    """One row for each document (``part`` is null): size and signature of its set. Beside them the
    extended hash-order prefixes of each batch, packed by hash range; a shingle that several sets
    of a batch share goes out once, and what the batch knows is counted here (``hash`` is null)."""

    def run(batches):
        for batch in (part for whole in batches for part in ta.slices(whole, "text")):
            sizes, sigs, prefixes = [], [], []
            for values in shingle_sets(batch.column("text")):
                n = len(values)
                sizes.append(n)
                sigs.append(signature(values) if n else None)
                prefixes.append(values[:n - overlap_needed(n) + 1 + extension(n)].copy())
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("doc_id", "ord", "key")), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()),
                *(pa.nulls(n, f.type) for f in list(PREFIXES)[5:]),
            ], schema=PREFIXES)
            lengths = np.array([len(p) for p in prefixes], np.int64)
            if not lengths.sum():
                continue
            own = np.array([0 if v is None else v for v in sigs], np.int64)
            rows = np.repeat(np.arange(n, dtype=np.uint32), lengths)
            for out in ta.batches_of(packed(np.concatenate(prefixes), rows, own), PREFIXES):
                yield out

    def packed(hashes, rows, sigs):
        order = np.argsort(hashes)
        hashes, rows = hashes[order], rows[order]
        starts, many = several(hashes, sigs[rows])
        local = np.repeat(many, np.diff(np.append(starts, len(hashes))))
        shared = np.bincount(rows[local], minlength=len(sigs))
        known = np.flatnonzero(shared)
        yield {"part": -1, "keys": sigs[known].tobytes(), "row": shared[known].astype(np.uint32).tobytes()}
        one, first = hashes[starts], rows[starts]
        order = np.argsort(first, kind="stable")
        yield from ta.pieces(
            ta.part_of(one[order], parts), {"hash": one[order].astype(np.uint32), "row": first[order]}, {"keys": sigs.tobytes()},
        )

    lean = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "ord", "key", "text")
    return shared_table(lean.mapInArrow(run, ddl(PREFIXES)))


def several(hashes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal (sorted) hashes, and which of them hold more than one signature."""
    starts = groups(hashes)
    return starts, np.minimum.reduceat(sigs, starts) != np.maximum.reduceat(sigs, starts)


def candidate_sets(table: DataFrame, parts: int) -> DataFrame:
    """Signatures of the sets that may link with another.

    Of the extended prefixes of two linked sets, the smaller of which has at least ceil(3n/4)
    shingles, as many are common as the smaller prefix is extended by, and one more. A set with
    fewer prefix shingles that any other prefix holds has no link.
    """

    def resolve(key, data):
        sigs, base = joined_ids(data, "keys")
        if key[0].as_py() < 0:
            return pa.table({"sig": sigs, "shared": ta.unpack(data.column("row"), "<u4")[0].astype(np.int64)})
        hashes, sizes = ta.unpack(data.column("hash"), "<u4")
        rows = ta.unpack(data.column("row"), "<u4")[0] + np.repeat(base.astype(np.uint32), sizes)
        order = np.argsort(hashes)
        same = np.diff(hashes[order]) == 0
        # A batch sends a shingle once, so a second entry is another batch's.
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        shared = np.bincount(rows[order[again]], minlength=len(sigs))
        found = np.flatnonzero(shared)
        return pa.table({"sig": sigs[found], "shared": shared[found]})

    sent = table.filter("part is not null").select(
        F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("keys"), F.lit(parts)).cast("int")).otherwise(F.col("part")).alias("part"),
        "keys", "hash", "row",
    )
    counts = sent.groupBy("part").applyInArrow(resolve, "sig long, shared long").groupBy("sig").agg(F.sum("shared").alias("shared"))
    sizes = table.filter("sig is not null").groupBy("sig").agg(F.first("n_shingles").alias("n"))
    least = F.expr("floor(floor((3 * n + 3) / 4) / 8) + 1")
    return counts.join(sizes, "sig").filter(F.col("shared") >= least).select("sig")


def band(n: int) -> int:
    """Linked sets are in one band or in neighbours."""
    return int(np.log(n) / np.log(4 / 3) + 1e-9)


def classes_of(band_number: int) -> int:
    return max(1, int((4 / 3) ** band_number / 8))


def bucket_keys(values: np.ndarray, sketch: np.ndarray, frequent: int) -> np.ndarray:
    """Index entries of one set: rare shingles alone, combinations of frequent ones by class."""
    n = len(values)
    p = n - overlap_needed(n) + 1
    b = band(n)
    count = sketch[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((values, count))
    out = []
    for own in (b, b + 1):
        m = classes_of(own)
        prefix = order[:p + m]
        is_rare = count[prefix] < frequent
        out.append(values[prefix[is_rare]])
        common = values[prefix[~is_rare]]
        if len(common) < 2:
            continue
        kind = common % np.uint64(m)
        sort = np.lexsort((common, kind))
        common, kind = common[sort], kind[sort]
        starts = groups(kind)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(common)]):
            if z - a > 1:
                i, j = np.triu_indices(z - a, 1)
                seed = np.uint64((own * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                out.append(ta.mix((common[a + i] * np.uint64(0xD6E8FEB86659FD93) ^ common[a + j]) + seed))
    return np.unique(np.concatenate(out))


def histogram(values: np.ndarray) -> np.ndarray:
    """Shingles by low hash bits, about two in each place; a power of two long."""
    width = max(16, 1 << max(0, int(len(values) // 2)).bit_length())
    return np.minimum(np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


class Histograms:
    """Upper bounds of intersections between sets of one task."""

    def __init__(self, sizes, widths, packed):
        self.sizes, self.widths, self.packed = sizes.astype(np.int64), widths.astype(np.int64), packed
        self.starts = np.cumsum(self.widths) - self.widths

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(rows), width), np.uint16)
        for w in np.unique(self.widths[rows]):
            own = np.flatnonzero(self.widths[rows] == w)
            whole = self.packed[self.starts[rows[own]][:, None] + np.arange(w)]
            out[own] = whole.reshape(len(own), w // width, width).sum(1, dtype=np.uint16)
        return out

    def may_link(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        n, sizes = self.sizes[pivot], self.sizes[rows]
        ok = linked(np.minimum(n, sizes), n, sizes)
        if ok.any():
            own = rows[ok]
            width = int(min(self.widths[pivot], self.widths[own].min()))
            bound = np.minimum(self.matrix(own, width), self.matrix(np.array([pivot]), width)).sum(1, dtype=np.int64)
            ok[ok] = linked(bound, n, sizes[ok])
        return ok


def families(rows: np.ndarray, test) -> list[tuple[int, int]]:
    """Spanning edges of the components of ``test`` over ``rows``.

    Every reached row is compared with all rows not yet reached, so no pair that could join
    two components is left out, and pairs within a found component are never made.
    """
    edges, waiting = [], rows
    while len(waiting) > 1:
        queue = deque([int(waiting[0])])
        waiting = waiting[1:]
        while queue and len(waiting):
            pivot = queue.popleft()
            near = test(pivot, waiting)
            found = waiting[near]
            edges += [(pivot, int(r)) for r in found]
            queue.extend(found.tolist())
            waiting = waiting[~near]
    return edges


def tiles(key: np.uint64, sig: int, count: int) -> list[int]:
    """A bucket's own key, or for a hot one the keys of all tiles in which ``sig`` must be."""
    if count <= BUCKET_ROWS:
        return [int(key)]
    side = -(-2 * count // BUCKET_ROWS)
    mine = sig % side
    pairs = np.array([min(mine, t) * side + max(mine, t) + 1 for t in range(side)], np.uint64)
    return ta.mix(pairs * np.uint64(0x9E3779B97F4A7C15) ^ key).tolist()


def frequent_from(sketch: np.ndarray, share: float = FREQUENT_SHARE) -> int:
    """Sets that a shingle is in at least to be frequent, from the corpus's own counts."""
    used = sketch[sketch > 0]
    return max(RARE, int(np.quantile(used, 1 - share)) + 1) if len(used) else RARE


def candidate_edges(sets: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) between signatures whose families may link."""
    context = sets.sparkSession.sparkContext
    by_shingle = sketch_of(sets.select("set"), lambda b: [ta.unpack(b.column("set"), "<u8")[0]])
    frequent = frequent_from(by_shingle)
    shingles = context.broadcast(by_shingle)

    def keys_of(batch):
        for cell in batch.column("set"):
            yield bucket_keys(ta.unpack([cell], "<u8")[0], shingles.value, frequent)

    by_key = context.broadcast(sketch_of(sets.select("set"), keys_of))

    def send(batches):
        for batch in batches:
            sigs = longs(batch, "sig")
            for at in range(0, len(sigs), 1024):
                yield from ta.batches_of(rows_of(batch.slice(at, 1024), sigs[at:at + 1024]), BUCKETS)

    def rows_of(batch, sigs):
        keys, rows, hists = [], [], []
        for row, (cell, mine) in enumerate(zip(batch.column("set"), keys_of(batch))):
            hists.append(histogram(ta.unpack([cell], "<u8")[0]))
            count = by_key.value[(mine >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            hot = count > BUCKET_ROWS
            own = mine[~hot].tolist()
            for key, c in zip(mine[hot], count[hot].tolist()):
                own += tiles(key, int(sigs[row]), c)
            keys.append(np.array(own, np.uint64))
            rows.append(np.full(len(own), row, np.uint32))
        if not keys:
            return
        sizes = np.array([len(c.as_buffer()) // 8 for c in batch.column("set")], np.uint32)
        widths = np.array([len(h) for h in hists], np.uint32)
        offset = np.cumsum(widths) - widths
        packed = np.concatenate(hists)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        for piece in ta.pieces(ta.part_of(keys, parts), {"hash": keys, "row": rows}, {}):
            used, again = np.unique(np.frombuffer(piece["row"], "<u4"), return_inverse=True)
            piece |= {
                "keys": sigs[used].tobytes(), "size": sizes[used].tobytes(), "width": widths[used].tobytes(),
                "hist": b"".join(packed[offset[u]:offset[u] + widths[u]].tobytes() for u in used),
                "row": again.astype(np.uint32).tobytes(),
            }
            yield piece

    def resolve(key, data):
        sigs, base = joined_ids(data, "keys")
        hashes, sizes = ta.unpack(data.column("hash"), "<u8")
        rows = ta.unpack(data.column("row"), "<u4")[0] + np.repeat(base, sizes)
        bounds = Histograms(
            ta.unpack(data.column("size"), "<u4")[0], ta.unpack(data.column("width"), "<u4")[0],
            ta.unpack(data.column("hist"), "u1")[0],
        )
        # One row for each signature, whichever fragment it came with.
        _, first, same = np.unique(sigs, return_index=True, return_inverse=True)
        rows = first[same[rows]]
        order = np.lexsort((rows, hashes))
        hashes, rows = hashes[order], rows[order]
        fresh = groups(hashes, rows) if len(rows) else np.zeros(0, np.int64)
        hashes, rows = hashes[fresh], rows[fresh]
        starts = groups(hashes) if len(rows) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(rows)))
        pairs = starts[count == 2]
        two = np.unique(np.stack([rows[pairs], rows[pairs + 1]], 1), axis=0) if len(pairs) else np.zeros((0, 2), np.int64)
        edges, seen = set(), set()
        for a, b in two.tolist():
            if bounds.may_link(a, np.array([b]))[0]:
                edges.add((a, b))
        for s, c in zip(starts[count > 2].tolist(), count[count > 2].tolist()):
            own = rows[s:s + c]
            if (token := own.tobytes()) not in seen:
                seen.add(token)
                edges.update(families(own, bounds.may_link))
        at = np.array(sorted(edges), np.int64).reshape(-1, 2)
        ta.give_back()
        return pa.table({"a": sigs[at[:, 0]], "b": sigs[at[:, 1]]})

    sent = sets.select("sig", "set").mapInArrow(send, ddl(BUCKETS))
    return sent.groupBy("part").applyInArrow(resolve, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps; every step is a partial minimum and an
    equi-join, and its edges are written to the shared folder.
    """
    edges = shared_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = shared_table(small.filter("a <> b").distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def verified_edges(sets: DataFrame, family: DataFrame) -> DataFrame:
    """Spanning edges of the true links inside each family (node, root)."""
    inside = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct())
    sizes = inside.groupBy("root").agg((F.floor((F.count(F.lit(1)) - 1) / (FAMILY_ROWS // 2)) + 1).cast("int").alias("side"))
    placed = inside.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("side")).cast("int"))
    other = F.when(F.col("side") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("side") - 1))
    placed = placed.withColumn("other", F.explode(other)).select(
        F.col("node").alias("sig"), "root",
        F.when(F.col("side") <= 2, 0).otherwise(F.least("mine", "other")).alias("low"),
        F.when(F.col("side") <= 2, 0).otherwise(F.greatest("mine", "other")).alias("high"),
    )

    def verify(key, data):
        # A repeated row repeats its set.
        sigs, first = np.unique(data.column("sig").to_numpy(), return_index=True)
        data = data.take(pa.array(first))
        values, counts = ta.unpack(data.column("set"), "<u8")
        starts = np.cumsum(counts) - counts

        def test(pivot, rows):
            n, sizes = counts[pivot], counts[rows]
            ok = linked(np.minimum(n, sizes), n, sizes)
            if ok.any():
                own = rows[ok]
                many = counts[own]
                heads = np.cumsum(many) - many
                spread = np.arange(many.sum()) - np.repeat(heads - starts[own], many)
                pivot_set = values[starts[pivot]:starts[pivot] + n]
                at = np.searchsorted(pivot_set, values[spread])
                at[at == n] = 0
                shared = np.add.reduceat((pivot_set[at] == values[spread]).astype(np.int64), heads)
                ok[ok] = linked(shared, n, many)
            return ok

        at = np.array(families(np.arange(len(sigs)), test), np.int64).reshape(-1, 2)
        ta.give_back()
        return pa.table({"a": sigs[at[:, 0]], "b": sigs[at[:, 1]]})

    return sets.join(placed.hint("merge"), "sig").groupBy("root", "low", "high").applyInArrow(verify, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """Every document with ``n_shingles``, its component and ``root``, which differs between components
    even where different texts carry one id; null for documents without shingles."""
    parts = ta.range_count(docs)
    table = prefix_table(docs, parts)
    rows = table.filter("part is null").select("doc_id", "ord", "key", "n_shingles", "sig")
    # The representative of equal sets is the text with the smallest id.
    members = rows.filter("sig is not null").groupBy("sig").agg(F.min(F.struct("ord", "key")).alias("_m")).select(
        "sig", F.col("_m.ord").alias("least"), F.col("_m.key").alias("key")
    )
    alive = shared_table(members.join(candidate_sets(table, parts), "sig").select("sig", "key"))

    def sets_of(batches):
        for batch in (part for whole in batches for part in ta.slices(whole, "text")):
            cells = [v.tobytes() for v in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(cells, pa.binary())], ["sig", "set"])

    # Neither side is bounded, so neither is ever broadcast: the plan is one at every size.
    texts = touched(keyed(docs).select("key", "text"), seen_keys(alive)).join(alive.hint("merge"), "key").select("sig", "text")
    sets = shared_table(texts.mapInArrow(sets_of, "sig long, set binary"))
    family = components(candidate_edges(sets, ta.range_count(sets, "set")))
    found = components(verified_edges(sets, family))
    inside = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    labelled = members.join(inside.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "root", F.coalesce("root", "sig")
    )
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    known = labelled.join(least, "root").select("sig", "root", "component")
    out = rows.join(known, "sig", "left")
    component = F.coalesce("component", "ord")
    return out.select(
        "doc_id", "key", "ord", "n_shingles", "root",
        F.when(component != ta.NULL_ID, component).alias("component_id"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    Documents without shingles all stay; repeated rows of one id and text are one document.
    """
    found = link(docs)
    leads = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("ord", "key")).alias("_m")).select(
        F.col("_m.key").alias("_lead")
    ).unionByName(found.filter("root is null").select(F.col("key").alias("_lead"))).distinct()
    own = docs.select(ta.text_key("doc_id", "text").alias("_lead"), F.struct("*").alias("_doc"))
    return own.join(leads, "_lead").dropDuplicates(["_lead"]).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def op4_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link(docs).select("doc_id", "n_shingles", "component_id")
