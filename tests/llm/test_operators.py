"""Every operator against SQL or brute force, on odd rows and on empty tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fleetframe.llm import archives, decontamination, jaccard, packing, privacy, quality, registry, scoring, sharding, suffixes
from tests.compare import compare, connect

from . import corpora

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
QUERIES = registry.QUERIES


def name_of(n):
    return next(k for k in QUERIES if k.startswith(f"op{n}_"))


def write(spark, path, rows, items=None, pages=None):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    if items is None:
        texts = [r[1] for r in rows if r[1] and len(r[1]) > 60]
        items = [(7, " ".join(texts[5].split()[3:40])), (70, texts[9].upper()), (8, "One!"), (9, None), (10, ""), (11, "no such words here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = pages if pages is not None else [
        (i, None if i == 3 else f"http://h/{i} x\n", None if i == 5 else ("é<p>" * (i % 7 * 20)) + ("\r\n\r\nWARC/1.0\r\n" if i % 2 else "")) for i in range(40)
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    return corpora.corpus()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    return write(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def con_of(path):
    con = duckdb.connect()
    for name in os.listdir(path):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}/{name}/*.parquet'")
    return con


@pytest.mark.parametrize("n", [1, 6, 7, 8])
def test_same_as_sql(spark, sf_dir, n):
    name = name_of(n)
    difference, _ = compare(spark, connect(sf_dir), name, QUERIES[name], registry.ORACLE[name], sf_dir)
    assert difference is None


@pytest.mark.parametrize("n", [1, 6, 7, 8])
def test_odd_rows_same_as_sql(spark, folder, n):
    name = name_of(n)
    difference, _ = compare(spark, con_of(folder), name, QUERIES[name], registry.ORACLE[name], folder)
    assert difference is None


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, empty, n):
    assert QUERIES[name_of(n)](spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 9, 10])
def test_null_ids_and_other_columns(spark, tmp_path, n):
    rows = [(None, "a b c d e f g h i j k l m n", "en", None, 3), (2, None, None, "s", None), (None, None, None, None, None),
            (5, "a b c d e f g h i j k l m n", "en", "s", 3)]
    extra = spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "doc_id AS key", "text AS hits", "1 AS contamination", "'x' AS pii", "2 AS size", "3 AS shard", "4 AS kept",
        "5 AS n_words", "6 AS block", "7 AS sig")
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "c d e f g h i j k l")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES[name_of(n)](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == {None, 2, 5} and len(found) >= 4
    if n == 6:  # the null id sorts first and keeps its words
        assert {r["doc_id"]: r["n_removed"] for r in found if r["n_words"]} == {None: 0, 5: 14}


def test_packing_is_exact(spark, folder, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    found = QUERIES[name_of(2)](spark, folder).collect()
    want = {}
    for r in rows:
        want.setdefault(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])
    copies = {}
    for r in rows:
        copies[r[0]] = copies.get(r[0], 0) + 1
    covered, sequences = {}, {}
    for r in found:
        ids = np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, places in covered.items():
        assert sorted(places) == sorted([*range(len(want[doc]))] * copies[doc])
    assert set(covered) == set(want)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in parts])
        assert [r["offset"] for r in parts] == [0, *ends[:-1]]
        assert ends[-1] == parts[0]["tier"] and ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= 1024
        assert len({r["step_group"] for r in parts}) == 1


def test_units_join_to_the_tokenizers_ids():
    from tokenizers import Tokenizer

    import random

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    own, rng = packing.WordTokenizer(packing.vocabulary_path()), random.Random(3)
    alphabet = " \n\t\r\x0b\x1c\x1f\x85\xa0​᠎ 　﻿ab1'st.é日<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice([*alphabet, "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_scores(spark, folder, rows):
    base, tree = corpora.unigram(rows), corpora.context_tree(rows, scoring.DEPTH)
    found = {r["doc_id"]: r for r in QUERIES[name_of(3)](spark, folder).collect()}
    for doc, text, *_ in rows:
        r, (n, known, total, score) = found[doc], base(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (corpora.held_out(doc), n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        if len(text or "") < 400:
            assert r["score"] == pytest.approx(tree(text), rel=1e-6)


def test_held_out_text_is_cheaper_than_eight_bits(spark, sf_dir):
    found = QUERIES[name_of(3)](spark, sf_dir).filter("held_out").selectExpr("avg(bits_per_byte) AS b").first()
    assert found["b"] < 3


@pytest.mark.parametrize("seed", [5, 6])
def test_components(spark, tmp_path, seed):
    rows = corpora.corpus(seed)
    path = write(spark, tmp_path, rows)
    want = {k[0]: v for k, v in corpora.components(rows).items()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES[name_of(4)](spark, path).collect()}
    assert found == want


def test_components_in_tiles(spark, tmp_path, monkeypatch):
    """Hot buckets and large families are cut, and no link is lost."""
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 4)
    monkeypatch.setattr(jaccard, "FAMILY_ROWS", 6)
    monkeypatch.setattr(jaccard, "RARE", 0)
    rows = corpora.corpus(7, 140)
    path = write(spark, tmp_path, rows)
    want = {k[0]: v for k, v in corpora.components(rows).items()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES[name_of(4)](spark, path).collect()}
    assert found == want


def test_one_document_of_each_component(spark):
    text = " ".join("abcdefghijklmnop")
    rows = [(3, text, "en", "s", 1), (1, text + " z", "en", "s", 1), (1, "other words altogether", "de", "s", 2), (9, text, None, None, 1), (4, None, None, None, 0)]
    kept = jaccard.first_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, text + " z"), (1, "other words altogether"), (4, "")]


def test_personal_data(spark, folder, rows):
    found = {r["doc_id"]: r for r in QUERIES[name_of(5)](spark, folder).collect()}
    for doc, text, *_ in rows:
        base, r = corpora.base_spans(text), found[doc]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in corpora.KINDS] == [sum(s.startswith(k) for s in base) for k in corpora.KINDS]
        assert set(base) <= set(filter(None, r["spans"].split(",")))


def test_field_finds_whole_spans_and_bounds():
    import random

    rng = random.Random(1)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    sample = [f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(60)]
    sample += [f"{'.'.join(str(rng.randint(0, 255)) for _ in range(4))}" for _ in range(40)]
    sample += [f"ab.c{digits(1)}@mail{digits(1)}.example.com" for _ in range(40)] + [digits(17) + "x" + digits(9) for _ in range(40)]
    field = privacy.fit_field(sample)
    # Both are lost to the base patterns: the phone pattern runs on into the address.
    text = "call +1 (826) 555-4081 190.137.223.7 today"
    base, added = privacy.find(text, field)
    assert [text[s.start:s.stop] for s in base if s.kind == "ip"] == ["190.137.223.7"]
    assert [(s.kind, text[s.start:s.stop]) for s in added] == [("phone", "+1 (826) 555-4081")]
    assert privacy.find("version 2.0 of 17 words, item 12345", field) == ([], [])


def test_field_learns_from_different_regions(spark, monkeypatch):
    """Copies fill no place of the sample; without copies it is what it was."""
    monkeypatch.setattr(privacy, "fit_field", lambda sample: sample)
    texts = [f"call +1 (826) 555-{4000 + i} now" for i in range(50)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(t for i, t in enumerate(texts) for _ in range(60 if i % 3 == 0 else 1))]
    found = privacy.fit(spark.createDataFrame(rows, DOCS).repartition(3), 20)
    once = privacy.region_rows(spark.createDataFrame([(0, t, "en", "s", 1) for t in texts], DOCS))
    assert found == [r["region"] for r in once.orderBy(privacy.F.xxhash64("region"), "region").limit(20).collect()]
    assert len(set(found)) == 20


def test_masking():
    assert privacy.masked("a 1 b 22 c", [("ip", 2, 3), ("card", 6, 8), ("phone", 7, 8)]) == "a [IP] b [CARD] c"


def test_bytes(spark, folder, rows):
    want = corpora.byte_repeats(rows)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES[name_of(9)](spark, folder).collect()}
    assert found == want


def test_bytes_around_a_hot_passage(spark, tmp_path, monkeypatch):
    """A passage between different texts: its anchors are divided, and no string is lost."""
    import random

    whole, most, rng = suffixes.refined, 1 << 14, random.Random(4)

    def bounded(data, starts, length=suffixes.LENGTH):
        if len(data) > 2 * most:
            raise MemoryError(f"{len(data)} bytes of contexts at once")
        return whole(data, starts, length)

    monkeypatch.setattr(suffixes, "refined", bounded)
    monkeypatch.setattr(suffixes, "REFINE_BYTES", most)
    letters = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    passage, sides = letters(150), [letters(70) for _ in range(3)]
    rows = [(i, rng.choice([*sides, letters(90), letters(9)]) + passage + rng.choice([*sides, letters(80)]), "en", "s", 1) for i in range(900)]
    rows += [rows[3], (None, rows[8][1], "en", "s", 1), (1000, passage * 3, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = corpora.byte_repeats([(suffixes.ta.NULL_ID if r[0] is None else r[0], *r[1:]) for r in rows])
    found = {suffixes.ta.NULL_ID if r["doc_id"] is None else r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
             for r in QUERIES[name_of(9)](spark, str(tmp_path)).collect()}
    assert found == want


def test_shards(spark, folder, rows):
    found = QUERIES[name_of(10)](spark, folder).collect()
    assert len(found) == len(rows)
    counts = {}
    for r in found:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert set(counts) == set(range(8))
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    for doc, text, *_ in rows:
        r = next(x for x in found if x["doc_id"] == doc)
        assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))


def test_curve_is_continuous():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
        place = sharding.hilbert_index(list(grid), bits)
        order = np.argsort(place)
        assert sorted(place) == list(range(len(place)))
        assert (np.abs(np.diff(grid[:, order], axis=1)).sum(0) == 1).all()


def test_shard_files_prune(spark, folder, tmp_path, rows):
    sharding.write_shards(spark.read.parquet(f"{folder}/documents.parquet"), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    bounds = sharding.shard_bounds(sharding.hilbert_shards(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    assert sum(b["n_rows"] for b in bounds) == len(rows)


def test_ranges_skip_shards(spark):
    """A range of ids or of sources lies outside the bounds of most shards."""
    rows = [(i * 7, "x" * (1 + i * 37 % 900), ("de", "en", "fr")[i % 3], f"src{i * 11 % 40:02}", 1) for i in range(2000)]
    bounds = sharding.shard_bounds(sharding.hilbert_shards(spark.createDataFrame(rows, DOCS), 64)).collect()
    assert len(bounds) == 64
    for name, low, high in (("doc_id", 0, 1400), ("source", "src00", "src03")):
        assert sum(b[f"min_{name}"] > high or b[f"max_{name}"] < low for b in bounds) >= 32


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n<p>\n", b"", "é\n".encode() * 9]
    records = [archives.arc_record(version, u, "text/html", b) for u, b in zip(("http://a b", None, "x"), bodies)]
    data = archives.arc_file_header(version) + b"\n" + b"\n".join(records)
    # Two archives one after the other, of both versions.
    data += b"\n" + archives.arc_file_header(3 - version) + b"\n" + archives.arc_record(3 - version, "y", "t", b"z")
    found = list(archives.parse_arc(data))
    assert [r.body for r in found] == [*bodies, b"z"]
    assert [r.url for r in found] == ["http://a%20b", "-", "x", "y"]
    for broken in (data[:-1], data.replace(b" text/html ", b" ", 1), data.replace(b"filedesc", b"nothing", 1)):
        with pytest.raises(ValueError):
            list(archives.parse_arc(broken))
    assert archives.iso_date("20240102") == "2024-01-02T00:00:00Z"


def test_warc_round_trip():
    record = archives.warc_record("id", "response", "u", "d", "m", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\n\r\n")
    again = archives.warc_record("id2", "revisit", "u", "d", "m", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\n\r\n", "<id>")
    (first, block), (second, head) = archives.parse_warc(record + b"\r\n\r\n" + again + b"\r\n\r\n")
    assert archives.split_response(block)[1] == b"WARC/1.0\r\n\r\n" and first["WARC-Type"] == "response"
    assert archives.split_response(head)[1] == b"" and second["WARC-Refers-To"] == "<id>"
    assert first["WARC-Payload-Digest"] == second["WARC-Payload-Digest"]


def test_lines_above_the_limits_same_as_sql(spark, tmp_path):
    """Planted lines: removed and depleting in hot and small hosts, kept where few documents or only copies hold them."""
    line = " Terms of  use apply to all PAGES here "
    own = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    rows = [(i, own(i, 30 if i % 3 else 4) + ("\n" + line + ("\n" + line if i % 2 else "") if i < 90 else "") + "\nOk so", "en", "hot", 1) for i in range(300)]
    rows += [(1000 + i, own(1000 + i, 12) + ("\n" + line if i < 7 else ""), "en", "small", 1) for i in range(40)]
    rows += [(2000 + i, own(2000 + i, 12) + ("\n" + line if i < 5 else ""), "en", "few", 1) for i in range(30)]
    rows += [(3000 + i, own(3000 + i, 12) + ("\n" + line if i < 40 else ""), "en", "large", 1) for i in range(900)]
    # A family of near copies: one line of twenty differs, all others are in every member.
    shared = [own(9000 + j, 9) for j in range(19)]
    rows += [(4000 + i, "\n".join([*shared[:i % 19], own(5000 + i, 9), *shared[i % 19:]]), "en", "copies", 1) for i in range(120)]
    path, name = write(spark, tmp_path, rows, []), name_of(8)
    difference, _ = compare(spark, con_of(path), name, QUERIES[name], registry.ORACLE[name], path)
    assert difference is None
    found = {r["doc_id"]: r for r in QUERIES[name](spark, path).collect()}
    assert {d for d, r in found.items() if r["n_removed_words"]} == {*range(90), *range(1000, 1007)}
    depleted = {d for d, r in found.items() if not r["kept"] and not r["base_failed"]}
    assert depleted == set(range(0, 90, 6))  # the line twice is a repeat, which fails the base rules


def test_lines_go_on_the_given_tables(spark):
    """The rule removes lines on the test tables, and the pipeline stage strips just those."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    found = {r["doc_id"]: r for r in QUERIES[name_of(8)](spark, path).collect()}
    hit = {d for d, r in found.items() if r["n_removed_words"]}
    assert 20 < len(hit) < 200
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in corpus_pipeline.STAGES[0][1](spark, docs, path).collect()}
    assert set(after) == {d for d, r in found.items() if r["kept"]}
    assert {d for d, r in after.items() if r["text"] != before[d]} == hit & set(after)
    assert all(len(r["text"].split()) == found[d]["n_words"] - found[d]["n_removed_words"] for d, r in after.items())
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if d in hit)


def test_clean_documents_keeps_any_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["n_words", "kept", "n_removed_words", "_over", "_host", "_quality_key", "_words", "_doc", "_hash", "a b.c"]
    extra = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    got = quality.clean_documents(extra)
    assert got.columns == extra.columns
    plain = {(r["doc_id"], r["text"], r["n_chars"]) for r in quality.clean_documents(docs).collect()}
    rows = got.collect()
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in rows} == plain
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


@pytest.mark.parametrize("share", [0.01, 0.5, 1.0])
def test_combinations_find_every_link(spark, folder, rows, share, monkeypatch):
    """Whatever part of the shingles is frequent, no link is lost; all of them means combinations alone."""
    monkeypatch.setattr(jaccard, "FREQUENT_SHARE", share)
    monkeypatch.setattr(jaccard, "frequent_from", lambda sketch, share=share: 2 if share == 1.0 else max(
        2, int(np.quantile(sketch[sketch > 0], 1 - share)) + 1))
    found = jaccard.link(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    want = corpora.components(rows)
    texts = {}
    for (doc, text), (n, root) in want.items():
        texts.setdefault(doc, set()).add((n, root))
    assert all((r["n_shingles"], r["component_id"]) in texts[r["doc_id"]] for r in found) and len(found) == len(rows)


def test_combinations_are_indexed(spark):
    """On the test tables a part of the index entries are combinations of frequent shingles."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    texts = [r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").select("text").distinct().collect()]
    import pyarrow as pa

    sets = [v for v in jaccard.shingle_sets(pa.array(texts)) if len(v)]
    sketch = np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    for v in sets:
        np.add.at(sketch, (v >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64), 1)
    frequent = jaccard.frequent_from(sketch)
    combined = sum(int((~np.isin(jaccard.bucket_keys(v, sketch, frequent), v)).sum()) for v in sets)
    assert 3 <= frequent < sketch.max() and combined > 1000


def test_benchmark_in_blocks(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r["doc_id"], r["text"], str(r["contamination"])) for r in decontamination.mark(docs, items).collect()}
    many = {(r["doc_id"], r["text"], str(r["contamination"])) for r in decontamination.mark(docs, items, block_bytes=90).collect()}
    assert one == many and any("hit_words=[]" not in c for *_, c in one)


def test_native_rules_use_no_python(spark, sf_dir):
    plan = QUERIES[name_of(8)](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, tmp_path, folder, rows):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in QUERIES[name_of(8)](spark, folder).collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r[0] for r in kept[-1]}
        if k == 0:
            assert ids == {d for d, ok in verdicts.items() if ok}
        elif k == 1:
            assert ids == {c for _, c in corpora.components(before).values()} and len(kept[-1]) == len(ids)
        elif k == 2:
            windows = decontamination.windows([(r["item_id"], r["text"]) for r in items.collect()])
            padded = {w: b" " + w + b" " for w in windows}
            want = {r[0] for r in before if not any(
                p in b" " + b" ".join(decontamination.normal_words(r[1])) + b" " for p in padded.values())}
            assert ids == want
        elif k == 3:
            assert ids == {r[0] for r in before}
            texts = {r[0]: r for r in before}
            for r in kept[-1]:
                assert r[4] == len(r[1])
                if not corpora.base_spans(texts[r[0]][1]) and "[" not in r[1]:
                    assert r[1] == texts[r[0]][1]
                assert not corpora.base_spans(r[1])
    assert sum(r[2] for r in kept[-1]) == sum({r[0]: r[4] for r in kept[-1]}.values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "doc_tokens").distinct().collect()} == {
        (r[0], r[4]) for r in kept[-1]}
