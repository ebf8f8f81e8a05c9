"""Placeholder rendering without a UDF, and the render-then-parse document pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Split, split
from ..sources.yaml_docs import parse_yaml

PLACEHOLDER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))


def render(text: Column, params: Column) -> Column:
    """Replace every ``{{ NAME }}`` by its value; an unknown name makes the result null."""
    literals = F.split(text, PLACEHOLDER, -1)
    values = F.transform(placeholders(text), lambda n: F.try_element_at(params, n))
    # One literal more than values; array_join would skip a null value, so check first.
    pieces = F.flatten(
        F.zip_with(literals, values, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    )
    known = ~F.exists(values, lambda v: v.isNull())
    return F.when(known, F.array_join(pieces, ""))


def render_templates(
    docs: DataFrame, text: str = "text", params: str = "params", on_error: str = "quarantine"
) -> Split:
    """Add ``rendered`` from each document's own parameter map; unknown names reject."""
    unknown = F.filter(
        placeholders(F.col(text)),
        lambda n: F.try_element_at(F.col(params), n).isNull(),
    )
    rendered = docs.withColumns({
        "rendered": render(F.col(text), F.col(params)),
        "error": F.when(
            F.size(unknown) > 0, F.concat(F.lit("UnknownPlaceholder: "), F.get(unknown, F.lit(0)))
        ),
    })
    return split(rendered, "error", on_error)


def render_and_parse(
    docs: DataFrame, text: str = "text", params: str = "params", on_error: str = "quarantine"
) -> Split:
    """Render each document, then parse it as YAML; a reject says which stage failed.

    Good rows are one per YAML document with ``doc_pos`` and ``json``.
    """
    kept = [c for c in docs.columns if c not in (text, params)]
    # Every document passes the parser once; one that was not rendered passes as a single row.
    rendered = render_templates(docs, text, params, on_error).rows.select(
        *kept, F.when(F.col("error").isNull(), F.col("rendered")).otherwise("null").alias("rendered"),
        F.col("error").alias("_unrendered"),
    )
    parsed = parse_yaml(rendered, "rendered", on_error=on_error).rows
    bad = F.col("_unrendered").isNotNull()
    rows = parsed.select(
        *kept, F.when(~bad, F.col("doc_pos")).alias("doc_pos"), F.when(~bad, F.col("json")).alias("json"),
        F.when(bad, "template").when(F.col("error").isNotNull(), "yaml").alias("stage"),
        F.coalesce("_unrendered", "error").alias("error"),
    )
    good, rejects = split(rows, "error", on_error)
    return Split.of(good.drop("stage"), rejects.select(*kept, "stage", "error"), rows)
