"""Hierarchical multi-length packing of documents into training sequences.

Every document becomes token ids with an end id. Whole windows of the longest tier are cut
off its front; what is left is routed to the shortest of several context tiers (1024, 512,
256, 128) that holds it. Each tier is packed by itself, longest first: the gap of a window is
filled with the largest pieces of shorter tiers that fit, and its rest by cutting a shorter
piece. So each sequence is exactly as long as its tier; the few ids left at the end of a task
become windows of powers of two. Sequences of a pool are dealt into step groups that hold
equally many windows of each tier.

Packing is local to an input partition and needs no shuffle: sequence ids carry the partition
number. Memory is bounded by ``POOL`` left-over pieces and one batch of texts. Rows must come
in a repeatable order within partitions (a table or file scan does), as a lost partition is
packed again from its input.

Cases: null and empty texts are the end id alone; repeated rows are packed each; very long
texts give many windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .textarrays import give_back

WINDOW = 1024
TIERS = (1024, 512, 256, 128)
POOL = 8192
STEP_TOKENS = 64 * 1024
CACHE_WORDS = 150_000
END_ID = 0
#: White space as the tokenizer's own splitting knows it (Unicode White_Space).
SPACES = "\t-\r \x85\xa0  -     　"
UNITS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Splitting rule of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


def special_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file with their ids: each is one id wherever its text stands."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes with their ids from a byte-level BPE file, whose ids follow the merge order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # Byte-level vocabularies write the printable bytes as themselves, the others from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    as_byte = {chr(b): b for b in printable}
    as_byte |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in as_byte.values())}
    special = special_tokens(path)
    return {bytes(as_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}


class WordTokenizer(dict):
    """A byte-level BPE that encodes each different unit once; maps unit to packed ids.

    The tokenizer's splitting never joins a word with what stands before its one leading
    space, so the ids of a text are those of its units one after the other. Strings of
    special tokens are ordinary text. The vocabulary is that of the tokenizer file, the merge
    loop is tiktoken's, whose single units are the faster; a test holds the ids equal.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        self.old = {}
        self.single = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}
        ).encode_ordinary
        special = special_tokens(path)
        self.special = {text: array("I", [i]).tobytes() for text, i in special.items()}
        # The longest first, where one begins with another.
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = array("I", self.single(unit)).tobytes()
        self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if len(self) > CACHE_WORDS:
            # Units in use come back from the generation before, the others go with it.
            self.old = dict(self)
            self.clear()
        if self.cuts is None or not any(map(text.__contains__, self.special)):
            return b"".join(map(self.__getitem__, UNITS.findall(text)))
        parts = self.cuts.split(text)
        return b"".join(self.special[p] if i % 2 else b"".join(map(self.__getitem__, UNITS.findall(p))) for i, p in enumerate(parts))


class Piece:
    """Ids of one document from ``start`` on, not yet placed."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc, self.start, self.ids[:4 * n], self.total),
                Piece(self.doc, self.start + n, self.ids[4 * n:], self.total))


class Shelf:
    """Unplaced pieces ordered by length."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=len)
        self.lengths = [len(p) for p in self.pieces]

    def add(self, piece: Piece) -> None:
        at = bisect.bisect_right(self.lengths, len(piece))
        self.lengths.insert(at, len(piece))
        self.pieces.insert(at, piece)

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` ids."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        self.lengths.pop(at)
        return self.pieces.pop(at)

    def __len__(self) -> int:
        return len(self.pieces)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (tier, pieces), and the pieces left (fewer ids than the shortest tier)."""
    shelf, windows = Shelf(pieces), []
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while (piece := shelf.take(tier)) is not None:
            if len(piece) <= below:
                shelf.add(piece)
                break
            window, gap = [piece], tier - len(piece)
            while gap and (piece := shelf.take(gap) or shelf.take(tier)) is not None:
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    shelf.add(rest)
                window.append(piece)
                gap -= len(piece)
            if gap and below:  # the last pieces: not enough for this tier
                for piece in window:
                    while len(piece) > below:
                        head, piece = piece.cut(below)
                        shelf.add(head)
                    shelf.add(piece)
                break
            if gap:
                return windows, window
            windows.append((tier, window))
    return windows, shelf.pieces


def finish(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The last ids of a task in windows that are powers of two, so none needs padding."""
    windows, left = [], sum(map(len, pieces))
    queue = list(pieces)
    while left:
        tier = 1 << (left.bit_length() - 1)
        window, gap = [], tier
        while gap:
            piece = queue.pop(0)
            if len(piece) > gap:
                piece, rest = piece.cut(gap)
                queue.insert(0, rest)
            window.append(piece)
            gap -= len(piece)
        windows.append((tier, window))
        left -= tier
    return windows


def step_groups(tiers: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: equally many of each tier, dealt to and fro."""
    groups = max(1, round(sum(tiers) / tokens))
    out, dealt = [0] * len(tiers), 0
    for at in sorted(range(len(tiers)), key=lambda i: -tiers[i]):
        turn, place = divmod(dealt, groups)
        out[at] = place if turn % 2 == 0 else groups - 1 - place
        dealt += 1
    return out


class Packer:
    """State of one task: numbers sequences and step groups, keeps what awaits its window."""

    def __init__(self, partition: int):
        self.next_sequence = self.next_group = partition << 32
        self.waiting: list[Piece] = []

    def add(self, doc, ids: bytes) -> list[tuple[int, list[Piece]]]:
        piece = Piece(doc, 0, ids, len(ids) // 4)
        whole = []
        while len(piece) >= WINDOW:
            head, piece = piece.cut(WINDOW)
            whole.append((WINDOW, [head]))
        if len(piece):
            self.waiting.append(piece)
        return whole

    def flush(self, last: bool) -> list[tuple[int, list[Piece]]]:
        windows, self.waiting = pack(self.waiting)
        if last:
            windows += finish(self.waiting)
            self.waiting = []
        return windows

    def rows(self, windows: list[tuple[int, list[Piece]]]) -> Iterator[tuple]:
        groups = step_groups([tier for tier, _ in windows])
        for (tier, window), group in zip(windows, groups):
            offset = 0
            for p in window:
                yield (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, self.next_sequence, offset, tier,
                       self.next_group + group)
                offset += len(p)
            self.next_sequence += 1
        self.next_group += max(groups, default=-1) + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document, with its sequence, tier and step group."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches):
        tokenizer, packer, ready = WordTokenizer(tokenizer_path), Packer(TaskContext.get().partitionId()), []
        end = np.array([END_ID], "<u4").tobytes()

        def batch_of(windows):
            columns = list(zip(*packer.rows(windows))) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for doc, body in zip(ids[at:at + 256], texts.slice(at, 256).to_pylist()):
                    ready += packer.add(doc, tokenizer.encode(body or "") + end)
                if len(packer.waiting) >= POOL:
                    yield batch_of(ready + packer.flush(False))
                    ready = []
        yield batch_of(ready + packer.flush(True))
        tokenizer.clear()
        tokenizer.old = {}
        give_back()

    lean = docs.select(docs[doc_id].cast("long"), docs[text].cast("string"))
    return lean.mapInArrow(run, SCHEMA)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
