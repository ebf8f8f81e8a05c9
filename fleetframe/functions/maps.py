"""Map overlays that do not depend on the session's duplicate-key policy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY = "CAST(map() AS MAP<STRING, STRING>)"


def overlay_map(base: Column, extra: Column) -> Column:
    """Entries of ``extra`` replace those of ``base``; a null map counts as empty."""
    base = F.coalesce(base, F.expr(EMPTY))
    extra = F.coalesce(extra, F.expr(EMPTY))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def text_map(entries: dict) -> Column:
    """Constant keys with literal or Column values."""
    if not entries:
        return F.expr(EMPTY)
    cells = []
    for key, value in entries.items():
        cells += [F.lit(key), value if isinstance(value, Column) else F.lit(value)]
    return F.create_map(*cells)


def label(labels: Column, key: str) -> Column:
    return F.try_element_at(labels, F.lit(key))
