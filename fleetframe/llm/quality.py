"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per document: word and symbol counts, repeated lines, and words inside repeated five-word
windows. Across documents: lines are normalised and hashed, the different documents that hold a
line are counted for each host, lines above the limits are removed, and a document with too
little left is rejected.

A line of at least ``MIN_LINE_WORDS`` words is above the limits when more than ``max_docs`` different
documents of its host hold it, or, for small hosts, more than ``min_docs`` that are also more than
``max_share`` of the host's texts. Copies of a document, with or without small changes, are not different
documents: texts whose least line hash beside the line is the same count once, and the line
is above the limits only where that leaves at least half of the texts that hold it. So what a
family of near copies has in common stays, and what stands in many documents goes.

Cases: a null text has no words and fails; a null source is one host of its own; repeated
rows get equal results; a very long text is one row, its lines are rows of their own; an empty table
gives no rows; other columns pass through ``clean_documents`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sizing import shared_table

SPACE = r"[\x20\x09-\x0D]+"
UNEVEN_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
"""White space that is not one space already, which is seldom."""
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_LINE_WORDS = 3
MAX_DOCS = 50
MIN_DOCS = 5
MAX_SHARE = 0.1
MIN_LEFT_SHARE = 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = "_quality_key"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised(line: Column) -> Column:
    """Line with A-Z lowered and white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), UNEVEN_SPACE, " "))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows found twice or more in ``words``.

    Window hashes with their places are sorted; neighbours with one hash are repeats, and
    the places they cover are added up in order. No window is compared with all others.
    """
    count = F.size(words) - (WINDOW - 1)
    hashes = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.struct(
            F.xxhash64(*[F.element_at(words, i + j) for j in range(WINDOW)]).alias("h"), i.alias("i")
        ),
    )

    def covered(pairs: Column) -> Column:
        places = F.array_sort(F.transform(
            F.filter(
                F.sequence(F.lit(1), F.size(pairs)),
                lambda k: ((k > 1) & (F.get(pairs, k - 2)["h"] == F.get(pairs, k - 1)["h"]))
                | ((k < F.size(pairs)) & (F.get(pairs, k)["h"] == F.get(pairs, k - 1)["h"])),
            ),
            lambda k: F.get(pairs, k - 1)["i"],
        ))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    def counted(pairs: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(pairs, lambda x: x["h"])))
        return F.when(distinct == F.size(pairs), F.lit(0).cast("long")).otherwise(
            _bound(F.array_sort(pairs), covered)
        )

    return F.when(count < 2, F.lit(0).cast("long")).otherwise(_bound(hashes, counted))


def measures(docs: DataFrame) -> DataFrame:
    """Add the base measures of each whole text and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return (
        docs.withColumn("_words", words_of(text)).withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _bound(F.col("_words"), repeated_words))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("_words", "_lines")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_host", F.coalesce(F.col("source").cast("string"), F.lit("\0"))).withColumn(
        KEY, F.xxhash64("_host", text)
    )


def line_hash(norm: Column) -> Column:
    return F.substring(F.md5(norm.cast("binary")), 1, 16)


def held_lines(docs: DataFrame) -> DataFrame:
    """One row for each text and different line of it: host, hash, words, places, least hash of the other lines.

    Repeated rows share a text. A line alone in its text has the empty word for other lines.
    """
    line = lambda x: F.struct(
        line_hash(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n"))
    norm = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), normalised), lambda x: x != "")
    texts = _keyed(docs).select(KEY, "_host", F.transform(norm, line).alias("_lines"))
    # The two least hashes of a text tell the least one beside any of its lines.
    least = _bound(F.array_sort(F.array_distinct(F.col("_lines.hash"))), lambda h: F.struct(F.get(h, F.lit(0)).alias("a"), F.get(h, F.lit(1)).alias("b")))
    rows = texts.withColumn("_least", least).select(KEY, "_host", "_least", F.posexplode("_lines").alias("_place", "_line"))
    other = F.coalesce(F.when(F.col("_line.hash") == F.col("_least.a"), F.col("_least.b")).otherwise(F.col("_least.a")), F.lit(""))
    return rows.filter(F.col("_line.n") >= MIN_LINE_WORDS).select(
        "_host", F.col("_line.hash").alias("_hash"), KEY, "_place", F.col("_line.n").alias("_n"), other.alias("_other"),
    ).groupBy("_host", "_hash", KEY).agg(
        F.max("_n").alias("_n"), F.max("_other").alias("_other"), F.size(F.collect_set("_place")).alias("_places"))


def frequent_lines(
    docs: DataFrame, held: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(``_host``, ``_hash``) of the lines above the limits, with the texts and different documents that hold them."""
    counts = held.groupBy("_host", "_hash", "_other").agg(F.count(F.lit(1)).alias("_t")).groupBy("_host", "_hash").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("_t").alias("n_texts")
    ).filter((F.col("n_docs") > min_docs) & (2 * F.col("n_docs") >= F.col("n_texts")))
    hosts = _keyed(docs).groupBy("_host", KEY).agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    return counts.join(hosts, "_host").filter(
        (F.col("n_docs") > max_docs) | (F.col("n_docs") > max_share * F.col("_texts"))).drop("_texts")


def line_verdicts(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Texts with lines above the limits: key, hashes of these lines, words they hold."""
    held = shared_table(held_lines(docs))
    over = frequent_lines(docs, held, max_docs, max_share, min_docs)
    return held.join(over, ["_host", "_hash"]).groupBy(KEY).agg(
        F.collect_set("_hash").alias("_over"), F.sum(F.col("_n") * F.col("_places")).alias("n_removed_words")
    )


def quality_rules(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT_SHARE,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Every document (text, source and others) with its measures, ``n_removed_words``, ``_over`` and ``kept``.

    Columns of these names are overwritten; :func:`clean_documents` keeps them.
    """
    verdicts = line_verdicts(docs.select("text", "source"), max_docs, max_share, min_docs)
    named = docs.drop("n_removed_words", "_over", "kept", KEY, "_host", "_words", "_lines")
    joined = _keyed(measures(named)).join(verdicts, KEY, "left").drop(KEY, "_host")
    removed = F.coalesce(F.col("n_removed_words"), F.lit(0).cast("long"))
    left = F.col("n_words") - removed
    depleted = (removed > 0) & ((left < MIN_WORDS) | (left < min_left * F.col("n_words")))
    return joined.withColumn("n_removed_words", removed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Kept documents without the lines above the limits; ``n_chars`` follows the text."""
    lean = docs.select(F.col("text").cast("string").alias("text"), "source", F.struct("*").alias("_doc"))
    judged = quality_rules(lean).filter("kept")
    kept = F.array_join(F.filter(
        F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_over"), line_hash(normalised(x)))
    ), "\n")
    changed = F.col("_over").isNotNull()
    text = F.when(changed, kept).otherwise(F.col("text"))
    own = lambda c: F.col("_doc").getField(c)
    out = {c: own(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(own("n_chars"))
    return judged.select(*[c.alias(name) for name, c in out.items()])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words",
    )


_ASCII_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"
MEASURES_SQL = rf"""
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host FROM documents),
word_lists AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM word_lists)),
repeats AS (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, g HAVING count(*) > 1),
repeat_words AS (SELECT r, count(DISTINCT i + j) AS n FROM repeats, range({WINDOW}) t(j) GROUP BY r),
lines AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM docs),
word_lines AS (SELECT r, host, text, line, trim(regexp_replace({_ASCII_LOWER.format('line')}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
               FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM word_lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM docs GROUP BY host),
lines_of AS (SELECT DISTINCT host, text, norm, substr(md5(norm), 1, 16) AS hash FROM word_lines),
least AS (SELECT host, text, list_sort(list(hash)) AS hashes FROM lines_of GROUP BY host, text),
others AS (SELECT host, norm, CASE WHEN hash = hashes[1] THEN coalesce(hashes[2], '') ELSE hashes[1] END AS other
           FROM lines_of JOIN least USING (host, text) WHERE len(string_split(norm, ' ')) >= {MIN_LINE_WORDS}),
over AS (SELECT host, norm FROM (SELECT host, norm, count(*) AS t, count(DISTINCT other) AS n FROM others GROUP BY host, norm) JOIN hosts USING (host)
         WHERE 2 * n >= t AND n > {MIN_DOCS} AND (n > {MAX_DOCS} OR n > {MAX_SHARE} * texts)),
removed AS (SELECT r, sum(len(string_split(norm, ' ')))::BIGINT AS n FROM word_lines SEMI JOIN over USING (host, norm) GROUP BY r),
measured AS (
  SELECT docs.*, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_removed_words
  FROM docs JOIN word_lists USING (r) LEFT JOIN dup_lines d USING (r) LEFT JOIN repeat_words p USING (r) LEFT JOIN removed x USING (r)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_removed_words > 0 AND (n_words - n_removed_words < {MIN_WORDS} OR n_words - n_removed_words < {MIN_LEFT_SHARE} * n_words) AS depleted
  FROM measured)
"""
SQL = f"""
WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT depleted AS kept, n_removed_words FROM judged
"""
