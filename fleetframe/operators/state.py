"""Desired versus installed: plans and selections. Nothing here changes a cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Split, split
from ..functions.locations import crd_url
from ..functions.maps import label, overlay_map, text_map
from ..schemas import DEFAULT_CHART_VERSION, SCOPE
from .catalog import overlay_last_wins


def installed_operators(
    releases: DataFrame, operators: DataFrame, scope: Sequence[str] = SCOPE,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Releases named ``<operator>-operator``; a repeated name keeps its last release."""
    charts = operators.select(F.concat("operator", F.lit("-operator")).alias("name"))
    known = releases.join(charts, "name", "left_semi").select(releases.columns)
    return overlay_last_wins(known, [*scope, "namespace", "name"], order)


def install_plan(
    requests: DataFrame, releases: DataFrame, mode: str | Column = "install",
    on: Sequence[str] = (*SCOPE, "namespace", "release"),
) -> DataFrame:
    """Action per request: install, replace, skip_same, skip_unspecified, error_conflict.

    ``mode`` is ``install`` or ``upsert``, for all requests or as a column.
    ``releases`` has one row per ``on`` key with the installed ``version``; a release of
    unknown version exists all the same.
    """
    if isinstance(mode, str):
        if mode not in ("install", "upsert"):
            raise ValueError(f"mode must be 'install' or 'upsert', not {mode!r}")
        mode = F.lit(mode)
    installed = releases.select(*on, F.col("version").alias("current_version"), F.lit(True).alias("_exists"))
    requested, current = F.col("version"), F.col("current_version")
    action = (
        F.when(F.col("_exists").isNull(), "install")
        .when(requested.isNull(), "skip_unspecified")
        .when(requested.eqNullSafe(current), "skip_same")
        .otherwise(F.when(mode == "install", "error_conflict").otherwise("replace"))
    )
    target = F.when(
        action.isin("install", "replace"), F.coalesce(requested, F.lit(DEFAULT_CHART_VERSION))
    )
    return requests.join(installed, list(on), "left").withColumns(
        {"action": action, "target_version": target}
    ).drop("_exists")


def uninstall_plan(
    requests: DataFrame, releases: DataFrame,
    on: Sequence[str] = (*SCOPE, "namespace", "release"),
) -> DataFrame:
    installed = releases.select(*on, F.col("version").alias("current_version"), F.lit(True).alias("_exists"))
    action = F.when(F.col("_exists").isNotNull(), "uninstall").otherwise("not_installed")
    return requests.join(installed, list(on), "left").withColumn("action", action).drop("_exists")


def upgrade_plan(
    requests: DataFrame,
    products: DataFrame,
    installed: DataFrame,
    valid: Sequence[str],
    include: Sequence[str] | Column = (),
    exclude: Sequence[str] = (),
    guard_empty: bool | Column = True,
    scope: Sequence[str] = SCOPE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Uninstall and install rows for clusters moving to a release.

    requests (scope, release), products (release, product, version), installed (scope,
    name = chart name). Only installed valid operators move, plus the included ones;
    excluded products never do. A cluster with nothing installed and nothing included has
    an empty list: ``guard_empty`` reads that as "nothing", otherwise it means every
    product of the release. ``include`` and ``guard_empty`` may be columns of the requests,
    and columns named in ``keep`` stay.
    """
    if not isinstance(include, Column):
        include = F.array(*[F.lit(n) for n in include]).cast("array<string>")
    if not isinstance(guard_empty, Column):
        guard_empty = F.lit(guard_empty)
    scope = list(scope)
    charts = [f"{v}-operator" for v in valid]
    present = installed.filter(F.col("name").isin(charts)).select(
        *scope, F.expr("substr(name, 1, length(name) - length('-operator'))").alias("product")
    ).distinct().withColumn("_installed", F.lit(True))
    any_present = present.select(*scope).distinct().withColumn("_any", F.lit(True))
    rows = (
        requests.join(products, "release")
        .join(any_present, scope, "left")
        .join(present, [*scope, "product"], "left")
    )
    is_installed = F.col("_installed").isNotNull()
    empty = F.col("_any").isNull()
    all_products = empty & ~guard_empty
    added = F.array_contains(include, F.col("product"))
    uninstall = is_installed | all_products
    install = is_installed | added | (all_products & (F.size(include) == 0))
    steps = F.filter(
        F.array(F.when(uninstall, F.lit("uninstall")), F.when(install, F.lit("install"))),
        lambda s: s.isNotNull(),
    )
    kept = rows if not exclude else rows.filter(~F.col("product").isin(list(exclude)))
    return kept.withColumn("action", F.explode(steps)).select(
        *scope, *keep, "release", "product", "version", "action"
    )


def definition_upgrades(
    plan: DataFrame, template: str, keys: Sequence[str] = (*SCOPE, "release", "product", "version")
) -> DataFrame:
    """The step between uninstall and install: the definitions of every product to be installed.

    ``plan`` comes from :func:`upgrade_plan`; the result adds a row with action
    ``upgrade_definitions`` for each install, with the ``url`` of the product's definitions, in
    the order of ``step`` (uninstall 0, upgrade_definitions 1, install 2).
    """
    installs = F.col("action") == "install"
    steps = F.when(installs, F.array(F.lit("upgrade_definitions"), F.lit("install"))).otherwise(F.array("action"))
    others = [c for c in plan.columns if c not in (*keys, "action")]
    rows = plan.select(*keys, *others, F.explode(steps).alias("action"))
    url = F.when(F.col("action") == "upgrade_definitions", crd_url(F.col("product"), F.col("version"), template))
    step = F.when(F.col("action") == "uninstall", 0).when(F.col("action") == "install", 2).otherwise(1)
    return rows.withColumns({"url": url, "step": step})


def api_group(api_version: Column) -> Column:
    slash = F.instr(api_version, F.lit("/"))
    return F.when(slash == 0, "").otherwise(F.substr(api_version, F.lit(1), slash - 1))


def api_version_part(api_version: Column) -> Column:
    return F.substr(api_version, F.instr(api_version, F.lit("/")) + 1)


def object_identity(
    objs: DataFrame, resources: DataFrame, target_namespace: Column | None = None,
    on: Sequence[str] = (), on_error: str = "quarantine",
) -> Split:
    """Add (group, version) and the effective namespace of each object.

    ``resources`` is the discovery table (group, version, kind, scope), per ``on`` columns
    if clusters differ. Objects without type, or of an unknown kind, are rejected.
    Cluster-scoped kinds lose their namespace, others take the target namespace.
    """
    typed = objs.withColumns(
        {"group": api_group(F.col("api_version")), "version": api_version_part(F.col("api_version"))}
    )
    keys = [*on, "group", "version", "kind"]
    joined = typed.join(resources.select(*keys, F.col("scope").alias("_scope")), keys, "left")
    target = F.col("namespace") if target_namespace is None else target_namespace
    error = F.when(F.col("api_version").isNull() | F.col("kind").isNull(), "ObjectType").when(
        F.col("_scope").isNull(), "UnknownKind"
    )
    return split(
        joined.withColumns(
            {"namespace": F.when(F.col("_scope") == "Namespaced", target), "error": error}
        ).drop("_scope"),
        "error", on_error,
    )


def diff_objects(
    desired: DataFrame, actual: DataFrame, kind: str = "manifest",
    on: Sequence[str] = (*SCOPE, "group", "version", "kind", "name"),
) -> DataFrame:
    """Action per desired object, carrying the live resource version when it exists.

    Identity includes the namespace; cluster-scoped objects have none, so it is compared
    as empty text.
    """
    exists, absent = {"manifest": ("patch_merge", "apply"), "crd": ("replace", "create")}[kind]
    here = F.coalesce("namespace", F.lit("")).alias("_ns")
    live = actual.select(*on, here, F.col("resource_version").alias("live_version"),
                         F.lit(True).alias("_live"))
    return (
        desired.withColumn("_ns", F.coalesce("namespace", F.lit("")))
        .join(live, [*on, "_ns"], "left")
        .withColumn("action", F.when(F.col("_live"), exists).otherwise(absent))
        .drop("_ns", "_live")
    )


def add_labels(objs: DataFrame, labels: Column | dict) -> DataFrame:
    """Given labels overwrite those an object already has."""
    extra = labels if isinstance(labels, Column) else text_map(labels)
    return objs.withColumn("labels", overlay_map(F.col("labels"), extra))


def demo_labels(domain: str, tool: str, vendor: str, demo: Column, stack: Column | None = None):
    """Label set of a demo, or with ``stack`` the set for the objects of its stack."""
    entries = {f"{domain}/managed-by": tool, f"{domain}/demo": demo, f"{domain}/vendor": vendor}
    if stack is not None:
        entries[f"{domain}/stack"] = stack
    return text_map(entries)


def select_by_label(
    objs: DataFrame, resources: DataFrame, key: str, value: str, namespace: str | None = None,
    on: Sequence[str] = (),
) -> DataFrame:
    """Objects to tear down: exact label match among listable kinds of the right scope.

    With a namespace only namespaced kinds in it are searched, without one only
    cluster-scoped kinds.
    """
    scope = "Cluster" if namespace is None else "Namespaced"
    kinds = resources.filter(F.array_contains("verbs", "list") & (F.col("scope") == scope))
    matching = objs.filter(label(F.col("labels"), key) == value)
    if namespace is not None:
        matching = matching.filter(F.col("namespace") == namespace)
    keys = [*on, "group", "version", "kind"]
    return matching.join(kinds.select(*keys), keys, "left_semi").select(objs.columns)


def select_by_group_suffix(crds: DataFrame, suffix: str) -> DataFrame:
    """Definitions whose group ends with the suffix (no dot boundary) and that have a name."""
    return crds.filter(F.col("group").endswith(suffix) & F.col("name").isNotNull())


def longest_group_suffix(crds: DataFrame, suffixes: DataFrame, key: Sequence[str] = ("name",), suffix: str = "suffix") -> DataFrame:
    """Definitions (key, group, suffix) whose group ends with a wanted suffix, with the longest one.

    Every tail of a group that is as long as some wanted suffix is looked up by equality, so many suffixes
    cost no more than the lengths they have. Definitions without a name are left out, as for one suffix.
    """
    wanted = suffixes.select(suffix).filter(F.col(suffix).isNotNull()).distinct()
    # At most as many lengths as a group name has characters.
    lengths = wanted.agg(F.sort_array(F.collect_set(F.length(suffix)))).first()[0]
    group = F.col("group")
    tails = F.transform(
        F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(group)),
        lambda n: F.substr(group, F.length(group) - n + 1))
    named = crds.filter(F.col("name").isNotNull())
    found = named.select(*[F.col(k) for k in key], "group", F.explode(tails).alias(suffix)).join(wanted, suffix)
    return found.groupBy(*key, "group").agg(F.max_by(suffix, F.length(suffix)).alias(suffix))
