"""Spec catalogs: overlay, lookup, reference resolution, parameters and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import Split, split
from ..functions.maps import overlay_map, text_map
from ..schemas import DEFAULT_NAMESPACE

ORDER = ("source_ord", "pos")


def overlay_last_wins(
    df: DataFrame, key: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """One row per key: the last definition's values at the first definition's position.

    Both are partial aggregates, so many definitions of one key are reduced before the
    shuffle.
    """
    key, order = list(key), list(order)
    values = [c for c in df.columns if c not in key and c not in order]
    at = F.struct(*order)
    aggregates = [F.min(at).alias("_first")]
    if values:
        aggregates.append(F.max_by(F.struct(*values), at).alias("_last"))
    merged = df.groupBy(*key).agg(*aggregates)
    picked = [F.col(f"_first.{c}").alias(c) for c in order] + [
        F.col(f"_last.{c}").alias(c) for c in values
    ]
    return merged.select(*key, *picked).select(*df.columns)


def describe(df: DataFrame, name: str, key: str = "name") -> DataFrame:
    """The spec with this name (no row when missing); the filter reaches the scan."""
    return df.filter(F.col(key) == name)


def lookup(
    requests: DataFrame, specs: DataFrame, key: str = "name", error: str = "NoSuchSpec",
    on_error: str = "quarantine",
) -> Split:
    """Bulk :func:`describe`: requested names with their spec, unknown names rejected."""
    found = requests.join(specs.withColumn("_known", F.lit(True)), key, "left").withColumn(
        "error", F.when(F.col("_known").isNull(), error)
    ).drop("_known")
    return split(found, "error", on_error)


def filter_products(
    products: DataFrame,
    include: DataFrame | Sequence[str] | None = None,
    exclude: DataFrame | Sequence[str] | None = None,
    name: str = "product",
    empty_means_all: bool = True,
) -> DataFrame:
    """Keep included, drop excluded products. Excluding wins and unknown names are ignored.

    Names come as a list, or as a table with the column ``name``.
    """
    if isinstance(include, DataFrame) and empty_means_all and include.isEmpty():
        include = None
    if isinstance(include, DataFrame):
        products = products.join(include.select(name), name, "left_semi")
    elif include or not empty_means_all:
        products = products.filter(F.col(name).isin(list(include or [])))
    if isinstance(exclude, DataFrame):
        products = products.join(exclude.select(name), name, "left_anti")
    elif exclude:
        products = products.filter(~F.col(name).isin(list(exclude)))
    return products


def included(name: Column, include: Column, exclude: Column | None = None) -> Column:
    """Row-wise form of :func:`filter_products` for list columns; empty includes all."""
    listed = F.coalesce(F.size(include) == 0, F.lit(True)) | F.array_contains(include, name)
    if exclude is None:
        return listed
    return listed & ~F.coalesce(F.array_contains(exclude, name), F.lit(False))


def resolve_refs(demos: DataFrame, stacks: DataFrame, releases: DataFrame) -> DataFrame:
    """demo -> stack -> release -> products limited to the stack's operators."""
    d = demos.select(F.col("name").alias("demo"), "stack")
    s = stacks.select(F.col("name").alias("stack"), "release", "operators")
    r = releases.select(F.col("name").alias("release"), "products")
    return (
        d.join(s, "stack").join(r, "release")
        .withColumn("p", F.explode("products"))
        .filter(included(F.col("p.name"), F.col("operators")))
        .select("demo", "stack", "release", F.col("p.pos").alias("pos"),
                F.col("p.name").alias("product"), F.col("p.version").alias("version"))
    )


def dangling_refs(demos: DataFrame, stacks: DataFrame, releases: DataFrame) -> DataFrame:
    """References to stacks and releases that no catalog defines."""
    no_stack = demos.select("name", F.col("stack").alias("missing")).join(
        stacks.select(F.col("name").alias("missing")), "missing", "left_anti"
    )
    no_release = stacks.select("name", F.col("release").alias("missing")).join(
        releases.select(F.col("name").alias("missing")), "missing", "left_anti"
    )
    return no_stack.select(F.lit("NoSuchStack").alias("error"), "name", "missing").unionByName(
        no_release.select(F.lit("NoSuchRelease").alias("error"), "name", "missing")
    )


def supports_namespace(
    requests: DataFrame, specs: DataFrame, on_error: str = "quarantine"
) -> Split:
    """Requests (name, namespace) against the supported namespaces of their spec, which must exist."""
    joined = requests.join(
        specs.select("name", "supported_namespaces", F.lit(True).alias("_known")), "name", "left"
    )
    allowed = F.coalesce(F.col("supported_namespaces"), F.array().cast("array<string>"))
    ok = (F.size(allowed) == 0) | F.array_contains(allowed, F.col("namespace"))
    return split(
        joined.withColumn("supported", F.array_join(allowed, ", "))
        .withColumn("error", F.when(F.col("_known").isNull(), "NoSuchSpec").when(~ok, "UnsupportedNamespace"))
        .drop("supported_namespaces", "_known"),
        "error", on_error,
    )


def explode_products(releases: DataFrame) -> DataFrame:
    return releases.select(
        F.col("name").alias("release"), F.explode("products").alias("p")
    ).select("release", F.col("p.pos").alias("pos"), F.col("p.name").alias("product"),
             F.col("p.version").alias("version"))


def explode_parameters(specs: DataFrame) -> DataFrame:
    return specs.select("name", F.posexplode("parameters").alias("pos", "p")).select(
        F.col("name").alias("spec"), "pos", F.col("p.name").alias("name"),
        F.col("p.description").alias("description"), F.col("p.default").alias("default"),
    )


def join_lists(df: DataFrame, cols: Sequence[str], sep: str = ", ") -> DataFrame:
    """Render array columns as text; a missing list renders as empty text."""
    return df.withColumns({c: F.coalesce(F.array_join(c, sep), F.lit("")) for c in cols})


def overlay_parameters(
    defaults: DataFrame, given: DataFrame, request: str = "request",
    on_error: str = "quarantine",
) -> Split:
    """Defaults (request, name, default, pos) overlaid by given (request, name, value, pos).

    The last given value of a name wins and declared names never disappear. One
    undeclared name rejects its whole request; the reject, one row, names the first one and lists
    what was expected (the declared names of a spec, null for none).

    Both sides are folded by name in one aggregate; a window over a request's names then finds the first
    undeclared one. Neither side is read twice, and ``rows`` has values and rejects together.
    """
    both = defaults.select(request, "name", "default", "pos", F.lit(True).alias("_declared")).unionByName(
        given.select(request, "name", F.col("value").alias("_given"), F.col("pos").alias("_at")), allowMissingColumns=True)
    folded = both.groupBy(request, "name").agg(
        F.max_by("default", F.col("pos")).alias("default"), F.min("pos").alias("pos"), F.max_by("_given", "_at").alias("_given"),
        F.min("_at").alias("_at"), F.coalesce(F.max("_declared"), F.lit(False)).alias("_declared"),
    )
    names = Window.partitionBy(request)
    unknown = F.min(F.when(~F.col("_declared"), F.struct("_at", "name"))).over(names)
    listed = F.collect_list(F.when(F.col("_declared"), F.struct("pos", "name"))).over(names)
    found = folded.withColumns({"_unknown": unknown, "_listed": listed})
    rejected = F.col("_unknown").isNotNull()
    first = rejected & ~F.col("_declared") & (F.col("name") == F.col("_unknown.name"))
    expected = F.array_join(F.transform(F.array_sort("_listed"), lambda d: d["name"]), ", ")
    rows = found.filter(first | ~rejected).select(
        request, F.when(~rejected, F.col("name")).alias("name"), F.when(~rejected, F.coalesce("_given", "default")).alias("value"),
        F.when(~rejected, F.col("pos")).alias("pos"), F.col("_unknown.name").alias("parameter"),
        F.when(rejected & (F.size("_listed") > 0), expected).alias("expected"), F.when(rejected, "InvalidParameter").alias("error"),
    )
    good, rejects = split(rows, "error", on_error)
    return Split.of(good.drop("parameter", "expected"), rejects.select(request, "parameter", "error", "expected"), rows)


def add_context(params: Column, namespace: Column, stack: Column, demo: Column | None = None):
    """Overlay the reserved names STACK, DEMO (only for demos) and NAMESPACE."""
    reserved = {"STACK": stack}
    if demo is not None:
        reserved["DEMO"] = demo
    return overlay_map(overlay_map(params, text_map(reserved)), text_map({"NAMESPACE": namespace}))


def release_branch(
    requests: DataFrame, releases: DataFrame, by: Sequence[str] = ("catalog",),
    order: Sequence[str] = ORDER, on_error: str = "quarantine",
) -> Split:
    """Branch of the requested release of a catalog, by default the first in its order."""
    by = list(by)
    known = releases.select(*by, F.col("name").alias("requested")).distinct().withColumn(
        "_known", F.lit(True)
    )
    first = releases.groupBy(*by).agg(F.min_by("name", F.struct(*order)).alias("_first"))
    joined = requests.join(known, by + ["requested"], "left").join(first, by, "left")
    requested = F.col("requested")
    branch = (
        F.when(requested.isNull(), F.concat(F.lit("release-"), F.col("_first")))
        .when(requested == "dev", "main")
        .otherwise(F.concat(F.lit("release-"), requested))
    )
    error = F.when(requested.isNotNull() & F.col("_known").isNull(), "NoSuchRelease").when(
        requested.isNull() & F.col("_first").isNull(), "LatestRelease"
    )
    return split(
        joined.select(*requests.columns, branch.alias("branch"), error.alias("error")),
        "error", on_error,
    )


def effective_namespace(namespace: Column, spec: Column, accepted: Column) -> Column:
    """``default`` becomes the spec's name when the suggestion is accepted."""
    return F.when((namespace == DEFAULT_NAMESPACE) & accepted, spec).otherwise(namespace)


def values_entries(docs: DataFrame, json: str = "json", on_error: str = "quarantine") -> Split:
    """Values documents, which must be maps of maps, as rows (..., chart, values JSON map)."""
    rest = [c for c in docs.columns if c != json]
    entries = docs.select(
        *rest, json, F.from_json(json, "MAP<STRING, STRING>").alias("_entries")
    )
    is_map = F.col(json).startswith("{")
    rows = entries.select(
        *rest,
        F.when(~is_map, "InvalidValueType").alias("_doc_error"),
        F.explode_outer(F.when(is_map, F.col("_entries"))).alias("chart", "_text"),
    )
    error = F.coalesce(
        F.col("_doc_error"),
        F.when(F.col("chart").isNotNull() & ~F.coalesce(F.col("_text").startswith("{"), F.lit(False)),
               "InvalidEntryType"),
    )
    good, rejects = split(rows.withColumn("error", error), "error", on_error)
    return Split(
        good.filter(F.col("chart").isNotNull()).select(
            *rest, "chart", F.from_json("_text", "MAP<STRING, STRING>").alias("values")
        ),
        rejects.select(*rest, "chart", "error"),
    )


def attach_values(
    operators: DataFrame, values: DataFrame, preset: Column | None = None,
    on: Sequence[str] = (), name: str = "operator",
) -> DataFrame:
    """Values (chart, values) of each operator's chart ``<name>-operator``, else empty.

    The listener operator gets its ``preset`` value overwritten.
    """
    chart = F.concat(F.col(name), F.lit("-operator"))
    joined = operators.withColumn("chart", chart).join(
        values.select(*on, "chart", "values"), [*on, "chart"], "left"
    )
    attached = overlay_map(F.col("values"), text_map({}))
    if preset is not None:
        attached = F.when(
            F.col(name) == "listener", overlay_map(attached, text_map({"preset": preset}))
        ).otherwise(attached)
    return joined.withColumn("values", attached)
