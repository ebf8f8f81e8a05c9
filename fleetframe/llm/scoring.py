"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary choices. A choice is made in a context: the last d bytes,
for every depth d from 0 to ``DEPTH``, and the bits of the byte so far. A node holds how often
either bit followed in training; its Krichevsky-Trofimov estimate and the weighted estimate of
its children are mixed half and half, from the deepest level up. After training the posterior
weights are fixed, and the probability of a bit is the mixture along its path. The code length
of a text is the sum over its bytes and an end symbol; texts begin in a context of end symbols.

Documents are dealt into blocks by a hash of their text. A block sends each distinct string
of ``DEPTH + 1`` bytes once, with its training count, and each distinct word. Counts are
summed by key, and the list of blocks that ask for a key travels along, so the model returns
to each block as the rows it needs: nothing is broadcast that grows with the corpus, and no
hot key exceeds one entry for each block. Trees are built in numpy for groups of contexts by their
last two bytes; the two levels above them have at most 65,536 nodes and go over the driver.

The text is scored with A-Z lowered, as the base score is. The base is an add-one unigram
model of words; its counts are exact (words by 64-bit hash).

Cases: null and empty texts are the end symbol; repeated rows are scored and learnt each; a
null doc_id is not in the held-out class; with no training rows all bits have probability one
half and the base has only unknown tokens; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_table
from . import textarrays as ta

DEPTH = 5
BLOCK_BYTES = 16 << 20
HELD_KEYS = 1 << 20
CHUNK = 1 << 20
TREE_GROUPS = 128
END = 0xFF
"""End of text; no UTF-8 byte."""
GRAM, WORD = 0, 1
END_WORD = -1
FOLDS, HELD_OUT = 7, 2
#: Lanczos coefficients (g = 7) of the gamma function (fixed values).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of gamma for x of at least one half."""
    x = x - 1.0
    total = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total += c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a block with ``a`` zeros and ``b`` ones under Krichevsky-Trofimov."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def stop_weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's."""
    return 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700)))


def summed(index: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(index, weights, size)


def prefix_of(x: np.ndarray, bit: int) -> np.ndarray:
    """The first ``bit`` bits of a byte after a leading one."""
    return (1 << bit) | (x >> (8 - bit))


def subtrees(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2):
    """Levels ``depth`` to ``top`` of the trees of some contexts.

    For each gram the probability of each of its bits below level ``top`` (n by 8), and the
    level-``top`` nodes: context and prefix, zeros, ones, log weighted probability. All grams
    that share their last ``top`` context bytes must be here.
    """
    x = (grams & 0xFF).astype(np.int64)
    context = grams >> 8
    levels = {d: np.unique(context & ((1 << (8 * d)) - 1), return_inverse=True) for d in range(top, depth + 1)}
    probability = np.empty((len(grams), 8))
    nodes = []
    for bit in range(8):
        prefix, one = prefix_of(x, bit), (x >> (7 - bit)) & 1
        below_weighted = below_parent = None
        p = None
        for d in range(depth, top - 1, -1):
            names, number = np.unique(levels[d][1] * 256 + prefix, return_inverse=True)
            zeros = summed(number, counts * (1 - one), len(names))
            ones = summed(number, counts * one, len(names))
            own = log_kt(zeros, ones)
            estimate = (np.where(one == 1, ones[number], zeros[number]) + 0.5) / ((zeros + ones)[number] + 1.0)
            if d == depth:
                weighted, p = own, estimate
            else:
                # A child's parent is the node of any gram below it.
                parent = np.empty(len(below_weighted), np.int64)
                parent[below_parent] = number
                below = summed(parent, below_weighted, len(names))
                weighted = np.logaddexp(own, below) - np.log(2.0)
                w = stop_weight(own, below)[number]
                p = w * estimate + (1.0 - w) * p
            below_weighted, below_parent = weighted, number
        probability[:, bit] = p
        nodes.append((levels[top][0][names >> 8] * 256 + (names & 255), zeros, ones, weighted))
    return probability, tuple(np.concatenate(c) for c in zip(*nodes))


class Top:
    """Levels 0 and 1: at most 256 and 65,536 nodes, by (last byte and) prefix."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        size = 1 << 16
        a, b, below = (np.bincount(node, v, size) for v in (zeros, ones, weighted))
        own = log_kt(a, b)
        self.w1, self.one1 = stop_weight(own, below), (b + 0.5) / (a + b + 1.0)
        level = np.logaddexp(own, below) - np.log(2.0)
        a, b, below = (v.reshape(256, 256).sum(0) for v in (a, b, level))
        own = log_kt(a, b)
        self.w0, self.one0 = stop_weight(own, below), (b + 0.5) / (a + b + 1.0)

    def log10(self, grams: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte, given its bits' probabilities from level 2 down."""
        x, last = (grams & 0xFF).astype(np.int64), ((grams >> 8) & 0xFF).astype(np.int64)
        out = np.zeros(len(grams))
        for bit in range(8):
            prefix, one = prefix_of(x, bit), ((x >> (7 - bit)) & 1) == 1
            node = last * 256 + prefix
            first = np.where(one, self.one1[node], 1.0 - self.one1[node])
            root = np.where(one, self.one0[prefix], 1.0 - self.one0[prefix])
            p = self.w1[node] * first + (1.0 - self.w1[node]) * deeper[:, bit]
            out += np.log10(self.w0[prefix] * root + (1.0 - self.w0[prefix]) * p)
        return out


def grams_of(chunk: ta.Chunk, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The last ``depth`` bytes and the next, at every byte and end of text; where each text begins."""
    texts = len(chunk.offsets) - 1
    pad = depth + 1
    # Each text follows ``depth`` end symbols and is followed by one.
    data = np.full(len(chunk.data) + texts * pad, END, np.uint8)
    at = np.arange(len(chunk.data)) + np.repeat(np.arange(texts) * pad + depth, np.diff(chunk.offsets))
    data[at] = ta.lower(chunk.data)
    n = len(data) - depth
    grams = np.zeros(n, np.int64)
    for j in range(depth + 1):
        grams <<= 8
        grams |= data[j:n + j]
    keep = np.ones(n, bool)
    starts = chunk.offsets[:-1] + np.arange(texts) * pad
    for j in range(1, depth + 1):
        gone = starts[1:] - j
        keep[gone] = False
    return grams[keep], chunk.offsets[:-1] + np.arange(texts)


def word_keys(chunk: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
    words = ta.split_words(chunk)
    return ta.word_hashes(ta.lower(chunk.data), words).astype(np.int64), words.text


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, number = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(number, np.concatenate(counts), len(values)).astype(np.int64)


def counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their number of learnt occurrences."""
    order = np.argsort(keys)
    keys, learnt = keys[order], learnt[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(learnt.astype(np.int64), starts)


def block_keys(key, table):
    """Distinct grams and words of one block, with training counts."""
    out = {GRAM: ([], []), WORD: ([], [])}
    for batch in table.to_batches():
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        for chunk in ta.chunks(batch.column("text"), CHUNK):
            own = learn[chunk.first:chunk.first + len(chunk.offsets) - 1]
            grams, _ = grams_of(chunk)
            words, text = word_keys(chunk)
            ends = np.full(len(own), END_WORD)
            for kind, keys, learnt in (
                (GRAM, grams, np.repeat(own, np.diff(chunk.offsets) + 1)), (WORD, words, own[text]), (WORD, ends, own),
            ):
                found = counted(keys, learnt)
                out[kind][0].append(found[0])
                out[kind][1].append(found[1])
                # Never much more than the distinct keys, whatever the size of the block.
                if sum(map(len, out[kind][0][1:])) > HELD_KEYS:
                    out[kind] = tuple([x] for x in merged(*out[kind]))
    both = {kind: merged(*parts) for kind, parts in out.items()}
    del out
    ta.give_back()
    return pa.table({
        "block": pa.array(np.full(sum(len(v[0]) for v in both.values()), key[0].as_py(), np.int32)),
        "kind": pa.array(np.concatenate([np.full(len(v[0]), k, np.int8) for k, v in both.items()])),
        "key": np.concatenate([v[0] for v in both.values()]), "n": np.concatenate([v[1] for v in both.values()]),
    })


class Lookup:
    """Values by key; every key asked for is there. Linear probing, vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int32)
        waiting, at = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) % len(self.slots)
            found[wrong] = self.slots[at]
            still = self.keys[found[wrong]] != keys[wrong]
            wrong, at = wrong[still], at[still]
        return self.values[found]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
TREE = "kind int, key long, blocks array<int>, p binary, zeros double, ones double, weighted double"


def tree_rows(key, table):
    """Bit probabilities of the grams of some contexts, and their nodes summed by last byte."""
    grams = table.column("key").to_numpy()
    probability, (node, zeros, ones, weighted) = subtrees(grams, table.column("n").to_numpy().astype(np.float64))
    # Level-2 nodes go up to level 1: last byte and prefix.
    above, number = np.unique(node & 0xFFFF, return_inverse=True)
    a, b, w = (np.bincount(number, v, len(above)) for v in (zeros, ones, weighted))
    n, m = len(grams), len(above)
    blank = np.zeros(n)
    blocks = table.column("blocks").combine_chunks()
    del node, zeros, ones, weighted, number
    ta.give_back()
    packed = np.ascontiguousarray(probability.astype("<f4"))
    kind = pa.list_(pa.int32())
    return pa.table({
        "kind": pa.array(np.concatenate([np.zeros(n, np.int32), np.ones(m, np.int32)])),
        "key": np.concatenate([grams, above]),
        "blocks": pa.chunked_array([blocks.cast(kind), pa.nulls(m, kind)]),
        "p": pa.array([r.tobytes() for r in packed] + [b""] * m, pa.binary()),
        "zeros": np.concatenate([blank, a]), "ones": np.concatenate([blank, b]), "weighted": np.concatenate([blank, w]),
    })


def score(docs: DataFrame) -> tuple[DataFrame, int]:
    """Scores of all documents, learnt from those that are not held out; training tokens."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (
        F.coalesce(fold != HELD_OUT, F.lit(True))).alias("learn"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-int(total) // BLOCK_BYTES))
    # Blocks are dealt by text, id and a third hash, so copies of one text spread evenly too.
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(block_keys, "block int, kind byte, key long, n long")
    counts = shared_table(asked.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))

    words = counts.filter(F.col("kind") == WORD)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    train_tokens, distinct = int(size[0]), int(size[1])

    grams = counts.filter(F.col("kind") == GRAM).withColumn(
        "group", F.pmod(F.xxhash64(F.col("key").bitwiseAND(F.lit(0xFFFF00))), F.lit(max(TREE_GROUPS, 2 * blocks)))
    )
    tree = shared_table(grams.groupBy("group").applyInArrow(tree_rows, TREE))
    nodes = tree.filter("kind = 1").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toArrow()
    top = Top(*(nodes.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted")))
    levels = spark.sparkContext.broadcast([top.w1, top.one1, top.w0, top.one0])

    def log_grams(batches):
        own = Top.__new__(Top)
        own.w1, own.one1, own.w0, own.one0 = levels.value
        for batch in batches:
            deeper = ta.unpack(batch.column("p"), "<f4")[0].astype(np.float64).reshape(-1, 8)
            value = own.log10(batch.column("key").to_numpy(), deeper)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("blocks"), pa.array(value)], ["key", "blocks", "value"]
            )

    gram_values = tree.filter("kind = 0").select("key", "blocks", "p").mapInArrow(
        log_grams, "key long, blocks array<int>, value double"
    )
    word_values = words.select("key", "blocks", F.col("n").cast("double").alias("value"))
    model = gram_values.withColumn("kind", F.lit(GRAM).cast("byte")).unionByName(
        word_values.withColumn("kind", F.lit(WORD).cast("byte"))
    ).select(F.explode("blocks").alias("block"), "kind", "key", "value")

    def score_block(texts, values):
        kind = values.column("kind").to_numpy()
        keys, numbers = values.column("key").to_numpy(), values.column("value").to_numpy()
        gram = Lookup(keys[kind == GRAM], numbers[kind == GRAM])
        word = Lookup(keys[kind == WORD], numbers[kind == WORD])
        out = []
        for batch in texts.to_batches():
            for chunk in ta.chunks(batch.column("text"), CHUNK):
                n = len(chunk.offsets) - 1
                grams_, starts = grams_of(chunk)
                value = np.add.reduceat(gram(grams_), starts)
                hashes, text_of = word_keys(chunk)
                each = np.concatenate([word(hashes), word(np.full(n, END_WORD))])
                owner = np.concatenate([text_of, np.arange(n)])
                part = batch.slice(chunk.first, n)
                out.append(pa.record_batch([
                    part.column("doc_id"), pa.array(~part.column("learn").to_numpy(zero_copy_only=False).astype(bool)),
                    pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, each > 0, n).astype(np.int64)),
                    pa.array(np.bincount(owner, np.log10((each + 1) / (train_tokens + distinct + 1)), n)),
                    pa.array(value), pa.array(np.diff(chunk.offsets)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]))
        out = pa.Table.from_batches(out, schema=RESULT)
        del gram, word
        ta.give_back()
        return out

    RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
    scored = dealt.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(score_block, SCORES)
    return scored, train_tokens


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents and their base scores."""
    scored, train_tokens = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = -F.col("score") / F.log10(F.lit(2.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score",
        "score", (bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
