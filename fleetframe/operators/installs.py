"""Install requests for demos, planned through all stages in one frame.

A request names a demo; the demo names a stack, the stack a release, the release its products.
Each stage can end a request, and a request keeps the first error it met: errors of specs are
carried along in one struct column, errors of single steps (an operator, an object) are found by a
window over the request's steps. Steps of later stages are never planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import specs
from ..functions.maps import EMPTY, overlay_map
from ..functions.quantity import cpu_millis, memory_bytes
from ..schemas import SCOPE
from .catalog import add_context, effective_namespace, included
from .state import add_labels, demo_labels, diff_objects, install_plan, object_identity

STAGES = (
    "demo", "stack", "demo_prerequisites", "stack_prerequisites", "release", "stack_parameters", "stack_manifests",
    "demo_parameters", "demo_manifests",
)
NUMBER = {name: i + 1 for i, name in enumerate(STAGES)}
_FAILED = "struct<stage: int, ord: int, error: string, detail: string>"
_TEXTS = "array<string>"


class _Errors:
    """Conditions that end a request, in the order in which they are met."""

    def __init__(self):
        self.found = [F.lit(None).cast(_FAILED)]

    def add(self, stage: str, condition: Column, error: Column | str, detail: Column | None = None) -> None:
        error = error if isinstance(error, Column) else F.lit(error)
        detail = F.lit(None).cast("string") if detail is None else detail
        self.found.append(F.when(condition, F.struct(
            F.lit(NUMBER[stage]).alias("stage"), F.lit(0).alias("ord"), error.alias("error"), detail.alias("detail"))))

    def first(self) -> Column:
        return F.coalesce(*self.found)


def _steps(*structs: Column) -> Column:
    return F.filter(F.array(*structs), lambda s: s["stage"].isNotNull())


def _step(stage: Column | int, ord: Column | int, item: str, name: Column, value: Column | None = None,
          api_version: Column | None = None, kind: Column | None = None) -> Column:
    as_column = lambda x, t: F.lit(x).cast(t) if not isinstance(x, Column) else x.cast(t)
    return F.struct(
        as_column(stage, "int").alias("stage"), as_column(ord, "int").alias("ord"), F.lit(item).alias("item"),
        name.cast("string").alias("name"), as_column(value, "string").alias("value"),
        as_column(api_version, "string").alias("api_version"), as_column(kind, "string").alias("kind"),
    )


def priced(spec_table: DataFrame) -> DataFrame:
    """Specs with their resource requests read, once for each spec."""
    return spec_table.withColumns({"cpu_needed": cpu_millis(F.col("cpu")), "memory_needed": memory_bytes(F.col("memory"))})


def _check_prerequisites(errors: _Errors, stage: str, spec: Column, namespace: Column) -> Column:
    """Errors of the namespace and the resource requests; what the cluster lacks is only a warning."""
    allowed = F.coalesce(spec["supported_namespaces"], F.array().cast(_TEXTS))
    errors.add(stage, (F.size(allowed) > 0) & ~F.array_contains(allowed, namespace), "UnsupportedNamespace", F.array_join(allowed, ", "))
    asks = spec["cpu"].isNotNull() | spec["memory"].isNotNull()
    errors.add(stage, asks & F.col("_capacity").isNull(), "UnknownCapacity")
    errors.add(stage, asks & spec["cpu_needed"].isNull(), "ParseCpuResourceRequirements", spec["cpu"])
    errors.add(stage, asks & spec["memory_needed"].isNull(), "ParseMemoryResourceRequirements", spec["memory"])

    def lacking(i, name, needed, there):
        text = F.concat(needed.cast("decimal(38,0)").cast("string"), F.lit(" > "), there.cast("decimal(38,0)").cast("string"))
        return F.when(needed > there, _step(NUMBER[stage], i, "warning", F.lit(name), text))

    return _steps(lacking(0, "InsufficientCpu", spec["cpu_needed"], F.col("_capacity.cpu_millis")),
                  lacking(1, "InsufficientMemory", spec["memory_needed"], F.col("_capacity.memory_bytes")))


def _read_parameters(errors: _Errors, stage: str, given: Column, declared: Column) -> Column:
    """Map of the declared parameters overlaid by the given ones, whose first error ends the stage."""
    items = F.transform(F.coalesce(given, F.array().cast(_TEXTS)), specs.parameter)
    bad = F.get(F.filter(items, lambda i: i["error"].isNotNull()), F.lit(0))
    names = F.transform(declared, lambda p: p["name"])
    errors.add(stage, bad["error"].isNotNull(), bad["error"])
    unknown = F.get(F.filter(items, lambda i: ~F.array_contains(names, i["name"])), F.lit(0))["name"]
    errors.add(stage, unknown.isNotNull(), "InvalidParameter", F.concat(unknown, F.lit(", expected "), F.array_join(names, ", ")))
    put = lambda name, value: (lambda m, p: overlay_map(m, F.create_map(p[name], p[value])))
    base = F.aggregate(declared, F.expr(EMPTY), put("name", "default"))
    return F.aggregate(F.filter(items, lambda i: i["error"].isNull()), base, put("name", "value"))


def _parameter_steps(stage: str, parameters: Column) -> Column:
    return F.transform(F.array_sort(F.map_keys(parameters)), lambda k, i: _step(
        NUMBER[stage], i, "parameter", k, F.try_element_at(parameters, k)))


def _manifest_steps(stage: str, manifests: Column) -> Column:
    return F.transform(F.coalesce(manifests, F.array().cast("array<struct<api_version: string, kind: string, name: string>>")),
                       lambda m, i: _step(NUMBER[stage], i, "manifest", m["name"], None, m["api_version"], m["kind"]))


def resolved_steps(
    requests: DataFrame, demos: DataFrame, stacks: DataFrame, releases: DataFrame, capacity: DataFrame,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Requests with their namespace, ``failed`` (the first error of a spec) and one row for each step before it."""
    whole = lambda df, name, key: df.select(F.col("name").alias(key), F.struct("*").alias(name))
    joined = (
        requests.join(whole(priced(demos), "_demo", "demo"), "demo", "left")
        .withColumn("stack", F.col("_demo.stack"))
        .join(whole(priced(stacks), "_stack", "stack"), "stack", "left")
        .withColumn("release", F.col("_stack.release"))
        .join(whole(releases, "_release", "release"), "release", "left")
        .join(capacity.select(*scope, F.struct("cpu_millis", "memory_bytes").alias("_capacity")), list(scope), "left")
        .withColumn("target", effective_namespace(F.col("namespace"), F.col("demo"), F.col("accepted")))
    )
    demo, stack, target = F.col("_demo"), F.col("_stack"), F.col("target")
    errors = _Errors()
    errors.add("demo", demo.isNull(), "NoSuchDemo", F.col("demo"))
    errors.add("stack", stack.isNull(), "NoSuchStack", F.col("stack"))
    warnings = [_check_prerequisites(errors, "demo_prerequisites", demo, target),
                _check_prerequisites(errors, "stack_prerequisites", stack, target)]
    skip = F.coalesce(F.col("skip_release"), F.lit(False))
    errors.add("release", ~skip & F.col("_release").isNull(), "NoSuchRelease", F.col("release"))
    wanted = F.filter(F.col("_release.products"), lambda p: included(p["name"], F.col("_stack.operators")))
    operators = F.when(~skip, F.transform(wanted, lambda p: _step(NUMBER["release"], p["pos"], "operator", p["name"], p["version"])))
    of_stack = _read_parameters(errors, "stack_parameters", F.col("stack_parameters"), stack["parameters"])
    of_demo = _read_parameters(errors, "demo_parameters", F.col("parameters"), demo["parameters"])
    read = joined.withColumns({
        "failed": errors.first(),
        "_stack_map": add_context(of_stack, target, F.col("stack"), F.col("demo")),
        "_demo_map": add_context(of_demo, target, F.col("stack"), F.col("demo")),
    })
    empty = F.array().cast("array<struct<stage: int, ord: int, item: string, name: string, value: string, api_version: string, kind: string>>")
    planned = F.concat(*[F.coalesce(part, empty) for part in (
        *warnings, operators, _parameter_steps("stack_parameters", F.col("_stack_map")),
        _manifest_steps("stack_manifests", F.col("_stack.manifests")), _parameter_steps("demo_parameters", F.col("_demo_map")),
        _manifest_steps("demo_manifests", F.col("_demo.manifests")))])
    before = F.filter(planned, lambda s: F.col("failed").isNull() | (s["stage"] < F.col("failed.stage")))
    steps = F.concat(F.array(_step(0, 0, "request", F.col("demo"))), before)
    used = ("namespace", "accepted", "skip_release", "stack_parameters", "parameters")
    return read.withColumn("_step", F.explode(steps)).select(
        *[c for c in requests.columns if c not in used], "stack", "target", "failed", "_step.*")


def demo_install_plan(
    requests: DataFrame, demos: DataFrame, stacks: DataFrame, releases: DataFrame, capacity: DataFrame,
    installed: DataFrame, resources: DataFrame, live: DataFrame, domain: str, tool: str, vendor: str,
    key: Sequence[str] = ("id",), scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """What installing each requested demo would do, or the first error that ends it.

    requests (key, scope, demo, namespace, accepted, operator_namespace, skip_release, and the lists of
    texts stack_parameters and parameters); demos (name, stack, supported_namespaces, cpu, memory,
    parameters, manifests); stacks (the same with release and operators); releases (name, products);
    capacity (scope, cpu_millis, memory_bytes); installed (scope, operator_namespace, release,
    version); resources (group, version, kind, scope); live objects (scope, group, version, kind,
    name, namespace, resource_version).

    One row of item ``request`` for each request, with ``error`` and ``detail`` and the ``stage`` that
    failed, or action ``install``. The other rows are what is planned up to and including the stage
    that fails: warnings about the cluster's size, operators, parameters and objects with their
    labels. A step of a conflict or an unknown object type is listed with its own error, and steps
    of later stages are not. The keys of a request are unique, and no request has a null key.
    """
    scope, key = list(scope), list(key)
    rows = resolved_steps(requests, demos, stacks, releases, capacity, scope)
    # Steps that are looked up nowhere get keys of their own, which match nothing and meet nowhere.
    own = F.concat(F.lit("\0"), F.concat_ws("\0", *[F.col(k).cast("string") for k in key]))
    is_operator, is_object = F.col("item") == "operator", F.col("item") == "manifest"
    rows = rows.withColumns({
        "release": F.when(is_operator, F.concat("name", F.lit("-operator"))).otherwise(own),
        "version": F.when(is_operator, F.col("value")),
    })
    rows = install_plan(rows, installed, "install", [*scope, "operator_namespace", "release"]).withColumnRenamed(
        "action", "operator_action").drop("version", "current_version", "release")
    rows = object_identity(rows, resources, F.col("target")).rows.withColumn("object_name", F.when(is_object, F.col("name")).otherwise(own))
    rows = diff_objects(
        rows, live.withColumnRenamed("name", "object_name"), "manifest", [*scope, "group", "version", "kind", "object_name"])
    labels = F.when(F.col("stage") == NUMBER["stack_manifests"], demo_labels(domain, tool, vendor, F.col("demo"), F.col("stack"))).otherwise(
        demo_labels(domain, tool, vendor, F.col("demo")))
    rows = add_labels(rows.withColumn("labels", F.lit(None).cast("map<string, string>")), labels)
    error = F.when(is_operator & (F.col("operator_action") == "error_conflict"), "OperatorConflict").when(is_object, F.col("error"))
    rows = rows.withColumn("error", error)
    step_error = F.when(F.col("error").isNotNull(), F.struct("stage", "ord", "error", F.col("name").alias("detail")))
    steps = Window.partitionBy(*key, *scope)
    first = F.coalesce(F.min(step_error).over(steps), F.col("failed"))
    rows = rows.withColumn("first", first).filter(F.col("first").isNull() | (F.col("stage") <= F.col("first.stage")))
    is_request, ok = F.col("item") == "request", F.col("first").isNull()
    stage = F.when(is_request, F.coalesce(F.col("first.stage"), F.lit(0))).otherwise(F.col("stage"))
    return rows.select(
        *key, *scope, "item", F.get(F.array(F.lit("done"), *[F.lit(s) for s in STAGES]), stage).alias("stage"), "ord", "name",
        F.when(is_operator, F.col("target_version")).when(is_request, F.col("target")).otherwise(F.col("value")).alias("value"),
        F.when(is_request, F.when(ok, "install").otherwise("fail")).when(is_operator, F.col("operator_action"))
        .when(is_object & F.col("error").isNull(), F.col("action")).alias("action"),
        F.when(is_object, F.col("namespace")).alias("namespace"), F.when(is_object, F.col("labels")).alias("labels"),
        F.when(is_request, F.col("first.error")).otherwise(F.col("error")).alias("error"),
        F.when(is_request, F.col("first.detail")).alias("detail"),
    )
