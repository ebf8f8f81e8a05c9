"""Personal data by base patterns and a semi-Markov conditional random field.

Base patterns give e-mail, IP address, card and phone spans. The field scores whole
candidate segments: runs of at most ``MAX_TOKENS`` tokens (letters, digits, or one other
character) in a region around a digit or ``@``, by features of the whole span such as its
number of digits, its shape, its checksum, and what stands beside it. A dynamic programme over
the region chooses boundaries and types together; between candidates all is text. Regions are
independent, since no candidate crosses them, so the programme is exact for a whole text.

The field is trained here by maximum likelihood on ``SAMPLE_REGIONS`` different regions, in
hash order with the base spans as labels (the bound is a parameter). It adds spans where it
finds an entity that overlaps no base span; base spans always stay.

Cases: null and empty texts have no spans; repeated rows get equal results; without training
regions nothing is added; an empty table gives no rows; a column named like the result is
replaced, all others pass through.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
REACH = 64
SAMPLE_REGIONS = 600
ROUNDS = 40
RATE = 0.5
PENALTY = 0.02
RESULT = "pii"
RESULT_TYPE = "struct<base: array<struct<kind: string, start: int, stop: int>>, added: array<struct<kind: string, start: int, stop: int>>>"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|(?s:.)")


class Span(NamedTuple):
    kind: str
    start: int
    stop: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Around each ``@``, so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if found and start < at:
            last = found.end()
            out.append(Span("email", start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start and then kind; matches that fail a check are dropped."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
        if "+" in text:
            out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.stop))


def regions(text: str) -> list[tuple[int, int]]:
    """Words with a digit or ``@`` (as far as ``REACH`` from it), joined over single blanks."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() < out[-1][1]:
            a = out[-1][0]
        else:
            a, least = m.start(), max(0, m.start() - REACH)
            while a > least and not text[a - 1].isspace():
                a -= 1
        b, most = m.end(), min(len(text), m.end() + REACH)
        while b < most and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _side(char: str) -> str:
    if not char or char.isspace():
        return "blank"
    return "digit" if char.isdigit() else "letter" if char.isalpha() else "joint" if char in "._%+-@=/\"'" else "mark"


def segment_features(text: str, start: int, stop: int) -> tuple[str, ...]:
    """Features of a whole candidate span in its text."""
    span = text[start:stop]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    letters = any(c.isalpha() for c in span)
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", span))
    marks = "".join(sorted(set(shape) - {"a", "9"}))
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    count = n if n < 7 else 7 if n < 9 else 9 if n < 12 else 12 if n < 16 else 16 if n < 20 else 20
    at = span.count("@")
    domain = at == 1 and bool(DOMAIN.fullmatch(span.split("@")[1])) and all(c in LOCAL for c in span.split("@")[0]) and span[0] != "@"
    return (
        "bias", f"digits={count}", f"letters={letters}", f"marks={marks}" if len(marks) < 5 else "marks=many",
        f"shape={shape}" if len(shape) < 24 and not letters else "shape=long", f"octets={octets}", f"address={domain}",
        f"at={min(at, 2)}", f"check={12 <= n <= 19 and not letters and luhn(digits)}", f"plus={span[0] == '+'}",
        f"left={_side(text[start - 1:start])}", f"right={_side(text[stop:stop + 1])}", f"after={_side(text[stop + 1:stop + 2])}"
        if _side(text[stop:stop + 1]) == "joint" else "after=none",
    )


def lattice(text: str, start: int, stop: int):
    """Tokens of a region, and its candidates as (first token, end token, start, stop)."""
    bounds = [start + m.start() for m in TOKEN.finditer(text[start:stop])] + [stop]
    n = len(bounds) - 1
    digits = [0] * (n + 1)
    ats = [0] * (n + 1)
    for i in range(n):
        c = text[bounds[i]]
        digits[i + 1] = digits[i] + (bounds[i + 1] - bounds[i] if "0" <= c <= "9" else 0)
        ats[i + 1] = ats[i] + (c == "@")
    if ats[n] == 0 and digits[n] < 4:
        return n, []
    out = []
    for i in range(n):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            if not text[bounds[j] - 1].isalnum():
                continue
            amount = digits[j] - digits[i]
            if ats[j] - ats[i] == 1 or 4 <= amount <= 19 and (amount >= 7 or j - i == 7):
                out.append((i, j, bounds[i], bounds[j]))
    return n, out


class Field:
    """Weights of a semi-Markov field: one row of kinds for each feature; text tokens weigh nothing."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights = weights

    def scores(self, features: tuple[str, ...]) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in features:
            row = self.weights.get(f)
            if row is not None:
                total = [a + b for a, b in zip(total, row)]
        return total

    def best(self, text: str, start: int, stop: int) -> list[Span]:
        """The best segmentation of a region."""
        n, candidates = lattice(text, start, stop)
        if not candidates:
            return []
        ending: dict[int, list] = {}
        for i, j, a, b in candidates:
            scores = self.scores(segment_features(text, a, b))
            k = max(range(len(KINDS)), key=scores.__getitem__)
            if scores[k] > 0:
                ending.setdefault(j, []).append((i, scores[k], Span(KINDS[k], a, b)))
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, s, span in ending.get(j, ()):
                if value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, span)
        out, j = [], n
        while j:
            if back[j]:
                j, span = back[j]
                out.append(span)
            else:
                j -= 1
        return out[::-1]


def labelled(text: str) -> list[Span]:
    """Base spans without overlaps, the earlier and then the first listed kept."""
    out: list[Span] = []
    for s in base_spans(text):
        if not out or s.start >= out[-1].stop:
            out.append(s)
    return out


def fit_field(sample: list[str], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximum likelihood with base spans as labels, by forward and backward sums.

    Adaptive gradient steps over the whole sample; the likelihood's gradient is the difference
    of a feature's count in the labels and its expected count.
    """
    index: dict[str, int] = {}
    data = []
    for text in sample:
        gold = {(s.start, s.stop): KINDS.index(s.kind) for s in labelled(text)}
        n, candidates = lattice(text, 0, len(text))
        if candidates:
            features = [[index.setdefault(f, len(index)) for f in segment_features(text, a, b)] for _, _, a, b in candidates]
            width = len(features[0])
            data.append((n, np.array([c[:2] for c in candidates]), np.array(features).reshape(-1, width),
                         [(k, gold[c[2:]]) for k, c in enumerate(candidates) if c[2:] in gold]))
    if not data:
        return Field({})
    weights = np.zeros((len(index), len(KINDS)))
    squares = np.full_like(weights, 1e-3)
    for _ in range(rounds):
        gradient = -penalty * weights
        for n, ends, features, gold in data:
            scores = weights[features].sum(1)
            alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            alpha[0] = beta[n] = 0.0
            best = np.logaddexp.reduce(scores, axis=1)
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for k, (i, j) in enumerate(ends.tolist()):
                by_end.setdefault(j, []).append(k)
                by_start.setdefault(i, []).append(k)
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1]
                for k in by_end.get(j, ()):
                    alpha[j] = np.logaddexp(alpha[j], alpha[ends[k, 0]] + best[k])
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1]
                for k in by_start.get(i, ()):
                    beta[i] = np.logaddexp(beta[i], beta[ends[k, 1]] + best[k])
            expected = np.exp(scores + (alpha[ends[:, 0]] + beta[ends[:, 1]] - alpha[n])[:, None])
            for k, kind in gold:
                expected[k, kind] -= 1.0
            np.add.at(gradient, features, -expected[:, None, :])
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares)
    return Field({f: weights[i].tolist() for f, i in index.items()})


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and the field's spans that overlap none of them."""
    base = base_spans(text)
    added: list[Span] = []
    for a, b in regions(text):
        near = [s for s in base if s.start < b and s.stop > a] if base else ()
        added += [s for s in field.best(text, a, b) if all(s.stop <= x.start or s.start >= x.stop for x in near)]
    return base, added


def region_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Text of every region that has a candidate, with a little of what surrounds it."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                for a, b in regions(t or ""):
                    if lattice(t, a, b)[1]:
                        out.append(t[max(0, a - 2):b + 2])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["region"])

    return docs.select(docs[text].cast("string")).mapInArrow(run, "region string")


def fit(docs: DataFrame, sample_regions: int = SAMPLE_REGIONS) -> Field:
    """A field from at most ``sample_regions`` different regions, the first of all in hash order.

    Copies of a region count once, so copying alone does not decide what the field learns.
    """

    def first(batches):
        kept: set[tuple[int, str]] = set()
        for batch in batches:
            kept.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(kept) > sample_regions:
                kept = set(sorted(kept)[:sample_regions])
        yield pa.RecordBatch.from_pylist([{"hash": h, "region": r} for h, r in kept],
                                         schema=pa.schema([("hash", pa.int64()), ("region", pa.string())]))

    # What is first among all is first in its task: no more than that moves.
    hashed = region_rows(docs).select(F.xxhash64("region").alias("hash"), "region")
    sample = hashed.mapInArrow(first, "hash long, region string").distinct().orderBy("hash", "region").limit(sample_regions)
    return fit_field([r["region"] for r in sample.collect()])


def mark(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add ``pii``: base and added spans in code points."""
    weights = field.weights
    out = docs.drop(RESULT)
    schema = StructType([*out.schema.fields, *StructType.fromDDL(f"{RESULT} {RESULT_TYPE}").fields])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    kind = pa.struct([("base", span), ("added", span)])

    def run(batches):
        own = Field(weights)
        for batch in batches:
            cells = []
            for t in batch.column(text).to_pylist():
                base, added = find(t, own) if t else ((), ())
                cells.append({"base": [s._asdict() for s in base], "added": [s._asdict() for s in added]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, kind)], [*batch.schema.names, RESULT])

    return out.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind that begins it."""
    out, last = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, stop)
    return "".join([*out, text[last:]])


def clean_documents(docs: DataFrame) -> DataFrame:
    """All documents with their spans masked; ``n_chars`` follows the text."""
    columns, counts = docs.columns, "n_chars" in docs.columns
    field = fit(docs)
    weights = field.weights

    def run(batches):
        own = Field(weights)
        for batch in batches:
            texts, sizes = [], batch.column("n_chars").to_pylist() if counts else []
            for i, t in enumerate(batch.column("text").to_pylist()):
                base, added = find(t, own) if t else ((), ())
                if base or added:
                    t = masked(t, [*base, *added])
                    if counts:
                        sizes[i] = len(t)
                texts.append(t)
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, "text", pa.array(texts, batch.schema.field("text").type))
            if counts:
                place = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(place, "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
            yield batch

    return docs.mapInArrow(run, docs.schema).select(*columns)


def op5_semi_markov_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = mark(docs, fit(docs))
    base, added = F.col(f"{RESULT}.base"), F.col(f"{RESULT}.added")

    def listed(spans):
        rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
    )
