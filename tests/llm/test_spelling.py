"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from fleetframe.llm import registry, spelling
from tests.compare import compare, connect

from .test_operators import con_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits_one(x, y):
    """Whether exactly one insertion, deletion or replacement makes the words equal."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute_force(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits_one(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words), near


def listed(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()),
                  key=lambda r: r[0])


def odd_texts(seed=3):
    rng = random.Random(seed)
    alphabet = "abABeé×É"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(220):
        out = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1:]])
            out.append(w)
        rows.append((i * 7, rng.choice([" ", ", ", "1", "\n", "中", "Ā"]).join(out)))
    long_run = "ab" * 400
    rows += [(None, "abcde abcde abcdf abcde"), (5000, None), (5001, ""), (5002, f"{long_run} {long_run} {long_run} {long_run}x " * 3),
             (5003, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), (5004, "ÿÀ×÷ß " * 5)]
    return rows + rows[3:9]


@pytest.mark.parametrize("group_rows", [spelling.GROUP_ROWS, 4])
def test_same_as_brute_force(spark, group_rows):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS word", "'k' AS key", "2 AS n", "3 AS form").repartition(3)
    want, near = brute_force(rows)
    assert len(want) > 200 and sum(map(len, near.values())) > 400 and any(r[1] and r[1] != r[2] for r in want)
    assert listed(spelling.spelling_variants(docs, group_rows)) == want


def test_groups_are_divided(spark):
    """A group that holds all words is halved until none is above the limit, and no pair is lost."""
    rng = random.Random(1)
    words = sorted({"word" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(400)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    placed = spelling.divided(spelling.entries(df), 20)
    assert max(r["count"] for r in placed.groupBy(*spelling.GROUP).count().collect()) <= 20
    found = {r["word"]: r["n_near"] for r in spelling.near_words(df, 20).collect()}
    want = {w: sum(edits_one(w, v) for v in words if v != w) for w in words}
    assert found == {w: n for w, n in want.items() if n}


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_BYTES", 50)
    rows = [(1, "garçon garcon " * 40), (2, "x" * 300 + " " + "y" * 49 + " zebra zebra zebra " + "x" * 300)]
    batches = spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches()
    found = Counter()
    for batch in spelling.word_rows(iter(batches)):
        for r in batch.to_pylist():
            found[r["word"]] += r["n"]
    want = Counter()
    for doc, text in rows:
        for run in RUN.findall(text):
            h = zlib.crc32(f"{doc}:{run}".encode())
            want[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    assert found == {w: n for w, n in want.items() if len(w) >= 5}


def test_query_and_empty_table(spark, sf_dir, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    query = registry.QUERIES["op11_dense_prefix_suffix"]
    got = query(spark, sf_dir)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert listed(got) == brute_force(rows)[0]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert query(spark, str(tmp_path)).isEmpty()


def test_same_as_sql(spark, sf_dir, tmp_path):
    name = "op11_dense_prefix_suffix"
    difference, _ = compare(spark, connect(sf_dir), name, registry.QUERIES[name], registry.ORACLE[name], sf_dir)
    assert difference is None
    spark.createDataFrame(odd_texts(), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    difference, _ = compare(spark, con_of(tmp_path), name, registry.QUERIES[name], registry.ORACLE[name], str(tmp_path))
    assert difference is None
