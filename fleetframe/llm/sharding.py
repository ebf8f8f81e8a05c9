"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits, the cell's place on the Hilbert curve orders
the rows, and the order is cut into runs of equal row counts. Rows near each other on the
curve are near in every dimension, so the minimum and maximum of each dimension prune files:
every dimension keeps its order, source, language and id by rank among cuts of their values.

The order is made global without one task seeing all rows: quantiles of the curve index cut
it into ranges, rows are counted per range, numbered inside their range, and the counts of
the ranges before are added. The document's own id is a dimension, so a third of all rows
in one (source, language, size) cell still spreads over many curve cells.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from ..sizing import shared_table
from . import textarrays as ta

BITS = 10
ROWS_PER_RANGE = 1_000_000
MIN_RANGES = 64
MAX_RANGES = 100_000
VALUES_PER_CUT = 16
DIMENSIONS = ("source", "lang", "size", "doc_id")


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points with coordinates below ``2**bits``.

    Gray-code transform by exchanging and inverting lower bits from the top bit down, then
    interleaving; the axes times the bits must fit into 62 bits.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError("the curve index must fit into 62 bits")
    x = [np.array(a, np.int64) for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def hilbert_column(axes: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf(LongType())
    def place(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([frame[c].to_numpy() for c in frame.columns], bits))

    return place(F.struct(*[a.cast("long").alias(f"a{i}") for i, a in enumerate(axes)]))


def cuts_of(docs: DataFrame, value: Column, most: int) -> list:
    """At most ``most`` values in order that cut the different values evenly.

    Of many values the first in hash order are looked at, so the cuts do not depend on the run.
    """
    values = docs.select(value.alias("value")).distinct().orderBy(F.xxhash64("value"), "value").limit(VALUES_PER_CUT * most)
    found = sorted(r["value"] for r in values.collect())
    return found if len(found) <= most else [found[i * len(found) // most] for i in range(most)]


def rank_column(docs: DataFrame, value: Column, top: int) -> Column:
    """Place of a value among the cuts, spread over 0 to ``top - 1`` in order."""
    cuts = cuts_of(docs, value, top - 1)

    @F.pandas_udf(LongType())
    def place(values: pd.Series) -> pd.Series:
        places = {v: bisect_right(cuts, v) * top // (len(cuts) + 1) for v in values.unique().tolist()}
        return values.map(places).astype("int64")

    return place(value)


def quantised(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Source, language and id by rank (a null is the empty word or sorts first), size by its logarithm."""
    top = 1 << bits
    return [
        rank_column(docs, F.coalesce(F.col("source"), F.lit("")), top),
        rank_column(docs, F.coalesce(F.col("lang"), F.lit("")), top),
        F.least(F.floor(F.log2(F.col("size")) * (top / 40)), F.lit(top - 1)),
        rank_column(docs, ta.order_id("doc_id"), top),
    ]


def curve_rows(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One narrow row for each document: id, size, checksum, pruning dimensions, curve index."""
    text = F.col("text").cast("binary")
    lean = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    return lean.withColumn("curve", hilbert_column(quantised(lean, bits), bits))


def number_in_order(rows: DataFrame, keys: list[str], by: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """Add ``rank`` (from 0) in the order of ``by`` (a long) and then ``keys``; no single-task sort. Also the row count."""
    total = rows.count()
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-total // rows_per_range)))
    cuts = rows.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), values.to_numpy(), "right"))

    placed = rows.withColumn("_range", range_of(by))
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for r in range(len(cuts) + 1):
        starts.append(before)
        before += counts.get(r, 0)
    inside = Window.partitionBy("_range").orderBy(by, *[F.col(k).asc_nulls_first() for k in keys])
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)
    return placed.withColumn("rank", start + F.row_number().over(inside) - 1).drop("_range"), total


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """Documents with shard and slot: runs of the Hilbert order, row counts at most one apart.

    Ties on the curve are ordered by id, checksum and size; rows equal in all of these are
    interchangeable. Null texts have size 1 and the checksum of no bytes; null sources and
    languages are the empty word. An empty table gives no rows. Columns beside the named ones
    are ignored.
    """
    rows = shared_table(curve_rows(docs, bits))
    ranked, total = number_in_order(rows, ["doc_id", "text_crc32", "size"], "curve")
    first = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", F.expr(f"(rank * {shards}L) div {max(total, 1)}L").cast("int")).withColumn(
        "slot", F.col("rank") - first
    )


def shard_bounds(sharded: DataFrame) -> DataFrame:
    """What prunes files: rows, bytes and the range of each dimension in each shard."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"),
        *[f(c).alias(f"{name}_{c}") for c in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))],
        F.min("curve").alias("min_curve"), F.max("curve").alias("max_curve"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write whole documents in one folder for each shard, in curve order within it."""
    place = hilbert_shards(docs, shards).select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard", "curve"
    ).dropDuplicates(["_id", "_crc", "_size"])
    text = F.col("text").cast("binary")
    placed = docs.drop("shard", "curve").join(
        place,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(F.coalesce(text, F.lit(b""))) == F.col("_crc"))
        & (F.coalesce(F.octet_length(text), F.lit(0)) + 1 == F.col("_size")),
    ).drop("_id", "_crc", "_size")
    placed.repartitionByRange("shard", "curve").sortWithinPartitions("shard", "curve").drop("curve").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hilbert_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
