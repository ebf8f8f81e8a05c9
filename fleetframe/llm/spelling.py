"""Grouping of spelling variants by dense comparison of padded code-point matrices.

Two words are near if one inserted, deleted or replaced code point makes them equal, that is,
if their common prefix and suffix together reach the longer length minus one. Then one of the
two reaches half the longer length, so near words meet among the words with the same first or
the same last half. There the words are rows of padded matrices, one aligned left and one
aligned right, and blocks of rows are compared pair by pair of blocks: equal leading columns
are the prefix, equal trailing columns the suffix. A group with very many words is halved again
in the same way inside the part not yet known to be equal, which loses no pair and needs no
limit: in the end only one position is unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_table
from . import textarrays as ta
from .merkle import LOWER, UPPER, crc32_sql

MIN_LETTERS = 5
MIN_COUNT = 3
DELETE_MODULUS = 97
FORM_RATIO = 2
GROUP_ROWS = 8192
BLOCK_ROWS = 256
PIECE_BYTES = 2 << 20
ZLIB_BYTES = 64
LEAD = 0xC3
"""First UTF-8 byte of U+00C0 to U+00FF."""
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_OUTSIDE = np.array([True] + [False] * 255)

WORDS = "word string, n long"
NEAR = "word string, n_near long, form_n long, form string"
_ARROW_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_ARROW_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
GROUP = ["m", "a", "b", "cap", "key"]


# --- words -----------------------------------------------------------------------------


def crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, continued from the checksum ``before`` it."""
    table, order = crc_table(), np.argsort(starts - ends, kind="stable")
    first, length, state = starts[order], (ends - starts)[order], ~before[order]
    far = int(np.searchsorted(-length, -ZLIB_BYTES, "left"))
    for k in range(far):
        run = data[first[k]:first[k] + length[k]].tobytes()
        state[k] = zlib.crc32(run, int(~state[k])) ^ 0xFFFFFFFF
    step, live = 0, len(order)
    while live > far:
        part = state[far:live]
        state[far:live] = table[(part ^ data[first[far:live] + step]) & 255] ^ (part >> 8)
        step += 1
        live = int(np.searchsorted(-length, -step, "left"))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def pieces_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, offsets) of parts of about ``PIECE_BYTES``; a longer text is cut between runs only."""
    if len(offsets) > 2 or len(data) <= PIECE_BYTES:
        yield 0, len(data), offsets
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + PIECE_BYTES)
        while end < len(data) and inside[end] and inside[end - 1]:
            gap = np.flatnonzero(~inside[end:end + PIECE_BYTES])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + PIECE_BYTES)
        yield start, end, np.array([0, end - start])
        start = end


def counted(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, before: np.ndarray, known: np.ndarray) -> pa.Table:
    """Words of some texts, changed where their checksum says so, and how often each occurs."""
    words = ta.split_words(ta.Chunk(0, inside.view(np.uint8), offsets), _OUTSIDE)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data != LEAD, out=letters[1:])
    size = letters[words.ends] - letters[words.starts]
    crc = crc_of_runs(data, words.starts, words.ends, before[words.text])
    changed = (crc % DELETE_MODULUS == 0) & known[words.text]
    kept = np.flatnonzero(~changed & (size >= MIN_LETTERS))
    starts, length = words.starts[kept], (words.ends - words.starts)[kept]
    ends = np.cumsum(length)
    flat = data[np.repeat(starts - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    whole = pa.StringArray.from_buffers(
        len(kept), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)
    )
    cut = []
    for i in np.flatnonzero(changed & (size > MIN_LETTERS)).tolist():
        run = data[words.starts[i]:words.ends[i]].tobytes().decode()
        at = int(crc[i]) % len(run)
        cut.append(run[:at] + run[at + 1:])
    found = pa.chunked_array([whole, pa.array(cut, pa.string())]).value_counts()
    return pa.table([found.field("values"), found.field("counts")], schema=_ARROW_WORDS)


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = []
        for part in ta.slices(batch, "text"):
            ids = part.column("doc_id").to_pylist()
            states = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            known = np.array([i is not None for i in ids])
            for chunk in ta.chunks(part.column("text")):
                data = ta.lower(chunk.data)
                lead = data == LEAD
                inside = _LETTERS[data] | lead
                inside[1:] |= lead[:-1]
                rows = slice(chunk.first, chunk.first + len(chunk.offsets) - 1)
                for a, b, offsets in pieces_of(data, chunk.offsets, inside):
                    tables.append(counted(data[a:b], offsets, inside[a:b], states[rows], known[rows]))
        if tables:
            summed = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            yield from pa.table([summed["word"], summed["n_sum"]], schema=_ARROW_WORDS).to_batches(1 << 16)
    ta.give_back()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words of at least ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences, with their count ``n``."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(word_rows, WORDS).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# --- near words ------------------------------------------------------------------------


def _entry(m, a, b, cap):
    """A word in the group of those with the same first ``a`` and last ``b`` code points."""
    word = F.col("word")
    key = F.concat(F.substring(word, F.lit(1), a), F.when(b > 0, F.substring(word, F.char_length(word) - b + 1, b)).otherwise(""))
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"), cap.alias("cap"), key.alias("key"))


def entries(words: DataFrame) -> DataFrame:
    """Each word under its first and its last half, for pairs whose longer word has ``m`` code points.

    ``cap`` bounds the common prefix of the pairs a group answers for, so that a pair that meets
    in several groups is counted in one.
    """
    halves = []
    for longer in (0, 1):
        m = F.char_length("word") + longer
        half, none = F.floor(m / 2).cast("int"), F.lit(0)
        halves += [_entry(m, half, none, m), _entry(m, none, half, half)]
    return words.select("word", "n", F.inline(F.array(*halves)))


def divided(placed: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Entries with every group above ``group_rows`` halved again, until none is left."""
    while True:
        hot = placed.groupBy(*GROUP).count().filter(
            (F.col("count") > group_rows) & (F.col("m") - F.col("a") - F.col("b") > 1)
        ).select(*GROUP, F.lit(True).alias("hot"))
        hot = shared_table(hot)
        if hot.isEmpty():
            return placed
        m, a, b, cap = (F.col(c) for c in GROUP[:4])
        half = F.floor((m - a - b) / 2).cast("int")
        parts = F.array(_entry(m, a + half, b, cap), _entry(m, a, b + half, F.least(cap, a + half)))
        same = F.array(F.struct(*GROUP))
        placed = shared_table(
            placed.join(hot, GROUP, "left").select("word", "n", F.inline(F.when(F.col("hot"), parts).otherwise(same)))
        )


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def near_in_class(m: int, a: int, b: int, cap: int, group: np.ndarray, words: list[str], block_rows: int = BLOCK_ROWS):
    """Index pairs of near words among rows sorted by group; the words of a group share ``a`` first and ``b`` last letters."""
    middle, n = m - a - b, len(words)
    flat = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)
    length = np.array([len(w) for w in words])
    first = np.cumsum(length) - length
    kind = np.uint8 if middle < 256 else np.int32
    steps = np.arange(middle)

    def matrix(lo: int, hi: int, right: bool) -> np.ndarray:
        """Letters of a block's words between the known ends and beyond, one column for each row; 0 pads."""
        at, size = first[lo:hi], length[lo:hi]
        place = size - 1 - b - steps[:, None] if right else np.broadcast_to(a + steps[:, None], (middle, hi - lo))
        return np.where((place >= 0) & (place < size), flat[np.clip(at + place, 0, len(flat) - 1)], 0).astype(np.uint8)

    def run_lengths(x: np.ndarray, y: np.ndarray, open_pairs: np.ndarray) -> np.ndarray:
        alive, total = open_pairs.copy(), np.zeros(open_pairs.shape, kind)
        for s, t in zip(x, y):
            alive &= s[:, None] == t[None, :]
            if not alive.any():
                break
            total += alive
        return total

    left, right = [], []
    for lo in range(0, n, block_rows):
        hi = min(n, lo + block_rows)
        own = matrix(lo, hi, False), matrix(lo, hi, True)
        for lo2 in range(lo, n, block_rows):
            if group[lo2] > group[hi - 1]:
                break
            hi2 = min(n, lo2 + block_rows)
            other = own if lo2 == lo else (matrix(lo2, hi2, False), matrix(lo2, hi2, True))
            pairs = group[lo:hi, None] == group[None, lo2:hi2]
            pairs &= (length[lo:hi, None] == m) | (length[None, lo2:hi2] == m)
            if lo2 == lo:
                pairs = np.triu(pairs, 1)
            if not pairs.any():
                continue
            prefix = run_lengths(own[0], other[0], pairs)
            pairs &= prefix < cap - a
            suffix = run_lengths(own[1], other[1], pairs)
            i, j = np.nonzero(pairs & (prefix >= middle - 1 - np.minimum(suffix, middle - 1)))
            left.append(i + lo)
            right.append(j + lo2)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of near words and the best of them, for each word of each group in sorted rows."""

    def whole_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        columns = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in columns.items()}
        new_class = np.zeros(max(0, table.num_rows - 1), bool)
        for c in GROUP[:4]:
            new_class |= _changes(columns[c])
        new_group = new_class | _changes(columns["key"])
        group = np.concatenate([[0], np.cumsum(new_group)])
        edges = [0, *(np.flatnonzero(new_class) + 1).tolist(), table.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            m, a, b, cap = (columns[c][lo].as_py() for c in GROUP[:4])
            words, n = columns["word"].slice(lo, hi - lo), columns["n"].slice(lo, hi - lo).to_numpy()
            i, j = near_in_class(m, a, b, cap, group[lo:hi], words.to_pylist())
            if len(i) == 0:
                continue
            word, form = np.concatenate([i, j]), np.concatenate([j, i])
            # Rows of a group are in order of their words, so the smaller row is the smaller word.
            order = np.lexsort((form, -n[form], word))
            word, form = word[order], form[order]
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(at, len(word)))
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(word[at])), pa.array(count.astype(np.int64)), pa.array(n[form[at]]),
                 words.take(pa.array(form[at]))], schema=_ARROW_NEAR,
            )

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = np.ones(table.num_rows, bool)
        for c in GROUP:
            column = table.column(c).combine_chunks()
            last &= pc.equal(column, column[len(column) - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(last))
        if cut:
            yield from whole_groups(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None:
        yield from whole_groups(held)


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``n_near`` of each word that has a near word, and the near word ``form`` of largest count ``form_n``."""
    placed = divided(entries(words), group_rows).repartition(*GROUP).sortWithinPartitions(*GROUP, "word")
    return placed.mapInArrow(near_rows, NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")
    ).select("word", "n_near", (-F.col("best.order")).alias("form_n"), "best.form")


# --- forms and roots -------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words with a form, by doubling pointers.

    A form occurs at least ``FORM_RATIO`` times as often, so chains are short and have no cycle.
    """
    paths = shared_table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not paths.filter("moved").isEmpty():
        steps = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = shared_table(paths.join(steps, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ))
    return paths.drop("moved")


def spelling_variants(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every word with its near words counted, its more frequent form, and the root its forms lead to.

    Runs are taken from whole texts, a null text has none, and a text without an id keeps all its
    runs as they are. Repeated rows count as often as they occur. Runs of any length are compared
    whole. A table without such words gives no rows. Columns beside doc_id and text are ignored.
    """
    words = shared_table(vocabulary(docs))
    near = near_words(words, group_rows)
    enough = F.col("form_n") >= FORM_RATIO * F.col("n")
    judged = shared_table(words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n"),
    ))
    found = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_dense_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CODES = ("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: "
          "CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))")
SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, {crc32_sql(_CODES)} AS h FROM tokens GROUP BY doc_id, run),
words AS MATERIALIZED (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % {DELETE_MODULUS} = 0
      THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM runs GROUP BY 1 HAVING length(word) >= {MIN_LETTERS} AND sum(n) >= {MIN_COUNT}),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
replaced AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM places),
deleted AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM replaced a JOIN replaced b ON a.pattern = b.pattern AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT d.word, w.word, w.n FROM deleted d JOIN words w ON d.rest = w.word
  UNION ALL SELECT w.word, d.word, d.n FROM deleted d JOIN words w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN most >= {FORM_RATIO} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = most) END AS form,
    CASE WHEN most >= {FORM_RATIO} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, form AS further FROM judged
  UNION ALL SELECT w.word, j.word, j.form FROM walk w JOIN judged j ON w.further = j.word)
SELECT j.word, j.form, w.root, j.n, j.n_near, j.form_n FROM judged j JOIN walk w ON w.word = j.word AND w.further IS NULL
"""
