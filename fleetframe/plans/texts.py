"""Queries rendering and parsing whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import text_map
from ..operators import templates as R
from .views import table


def _templates(spark, sf):
    """Whole document texts with common words turned into placeholders."""
    body = F.replace(F.replace("text", F.lit(" the "), F.lit(" {{ WORD }} ")), F.lit(" de "), F.lit(" {{LANG}} "))
    params = F.when(
        F.col("lang") == "en", text_map({"WORD": F.upper("lang"), "SOURCE": F.col("source")})
    ).otherwise(text_map({"WORD": "-", "LANG": F.col("lang"), "SOURCE": F.col("source")}))
    return table(spark, sf, "documents").select("doc_id", body.alias("body"), params.alias("params"))


def render(spark, sf):
    docs = _templates(spark, sf).select("doc_id", F.concat(F.lit("{{ SOURCE }}: "), "body").alias("text"), "params")
    return R.render_templates(docs).rows.select("doc_id", "rendered", "error")


def render_parse(spark, sf):
    quoted = F.to_json(F.struct(F.col("body").alias("body")))
    docs = _templates(spark, sf).select(
        "doc_id",
        F.concat(F.lit("source: {{ SOURCE }}\nday: 2022-11-10\ndoc: "), quoted, F.lit("\n---\nversion: 23.10\n"))
        .alias("text"), "params")
    cell = lambda path: F.get_json_object("json", path)
    return R.render_and_parse(docs).rows.select(
        "doc_id", "doc_pos", cell("$.source").alias("source"), cell("$.day").alias("day"),
        cell("$.doc.body").alias("body"), cell("$.version").alias("version"),
        F.concat("stage", F.lit(": "), "error").alias("error"))


QUERIES = {"render": render, "render_parse": render_parse}

_BODY = """
    SELECT doc_id, source, lang = 'en' AND contains(t, ' de ') AS bad,
           replace(replace(t, ' the ', CASE WHEN lang = 'en' THEN ' EN ' ELSE ' - ' END),
                   ' de ', ' ' || lang || ' ') AS body
    FROM (SELECT *, text AS t FROM {documents})"""

ORACLE = {
    "render": f"""
        SELECT doc_id, CASE WHEN NOT bad THEN source || ': ' || body END AS rendered,
               CASE WHEN bad THEN 'UnknownPlaceholder: LANG' END AS error FROM ({_BODY})""",
    "render_parse": f"""
        SELECT doc_id, 0 AS doc_pos, source, '2022-11-10' AS day, body, NULL AS version, NULL AS error
        FROM ({_BODY}) WHERE NOT bad
        UNION ALL SELECT doc_id, 1, NULL, NULL, NULL, '23.10', NULL FROM ({_BODY}) WHERE NOT bad
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'template: UnknownPlaceholder: LANG'
        FROM ({_BODY}) WHERE bad""",
}
