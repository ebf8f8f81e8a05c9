"""Queries over layered catalogs, references, parameters and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import specs
from ..functions.maps import text_map
from ..operators import catalog as C
from ..operators.ordering import enumerate_rows, join_text
from ..schemas import OPERATORS
from ..sizing import shared_table
from ..sources.registry import audit_pages, page_gaps, with_source_order
from .views import query, table, view


def overlay(spark, sf):
    merged = C.overlay_last_wins(view(spark, sf, "v_def"), ["name"])
    return enumerate_rows(merged, ["source_ord", "pos"], name="row_no")


def source_order(spark, sf):
    named = [
        query(spark, sf, sql) for sql in (
            "SELECT n_name AS name, n_nationkey AS pos FROM {nation}",
            "SELECT s_name AS name, s_suppkey AS pos FROM {supplier}",
            "SELECT c_name AS name, c_custkey AS pos FROM {customer}")
    ]
    return with_source_order(named).select("name", F.col("pos").cast("bigint").alias("pos"), "source_ord")


DEMOS = """SELECT o_orderkey AS name,
       CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS stack FROM {orders}"""
STACKS = """SELECT c_custkey AS name, CASE WHEN c_custkey % 13 = 0 THEN 99 ELSE c_nationkey END AS release
            FROM {customer}"""


def _catalogs(spark, sf):
    demos = query(spark, sf, DEMOS)
    key = F.col("name")
    p = lambda n: F.concat(F.lit("p"), n.cast("string"))
    stacks = query(spark, sf, STACKS).withColumn(
        "operators",
        F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(p(key % 5), p((key + 1) % 5))))
    products = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
        i.alias("pos"), p(i).alias("name"),
        F.concat((F.col("n_nationkey") % 10).cast("string"), F.lit("."), i.cast("string"), F.lit(".0"))
        .alias("version")))
    releases = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), products.alias("products"))
    return demos, stacks, releases


def resolve_chain(spark, sf):
    return C.resolve_refs(*_catalogs(spark, sf))


def dangling(spark, sf):
    return C.dangling_refs(*_catalogs(spark, sf))


def include_exclude(spark, sf):
    products = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("product"))
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    mode = lambda mode, inc, exc: F.struct(F.lit(mode).alias("mode"), inc.alias("inc"), exc.alias("exc"))
    modes = F.array(mode("both", names("economy", "promo", "nosuch"), names("promo")),
                    mode("all", names(), names("promo", "large")))
    rows = products.withColumn("_m", F.explode(modes))
    return rows.filter(C.included(F.col("product"), F.col("_m.inc"), F.col("_m.exc"))).select(
        "p_partkey", "product", "_m.mode")


def include_table(spark, sf):
    """Names from tables: products of small parts, but for those of the last."""
    products = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("product"))
    named = lambda keep: table(spark, sf, "part").filter(keep).select(F.lower("p_type").alias("product")).distinct()
    return C.filter_products(products, named(F.col("p_size") < 20), named(F.col("p_type") == "PROMO"))


def namespace_ok(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        # Some requests are for specs that no catalog has.
        F.when(F.col("o_orderkey") % 17 == 0, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey")).alias("name"),
        F.concat(F.lit("ns"), (F.col("o_orderkey") % 4).cast("string")).alias("namespace"))
    key = F.col("c_custkey")
    specs_ = table(spark, sf, "customer").select(
        key.alias("name"),
        F.when(key % 3 == 0, F.array().cast("array<string>"))
        .when(key % 3 == 1, F.array(F.lit("ns1"))).otherwise(F.array(F.lit("ns0"), F.lit("ns2")))
        .alias("supported_namespaces"))
    return C.supports_namespace(requests, specs_).rows


def explode_items(spark, sf):
    key = F.col("c_custkey")
    item = lambda i: F.struct(
        F.concat(F.lit(f"p{i}-"), F.lower("c_mktsegment")).alias("name"), F.lit("d").alias("description"),
        (key + i).cast("string").alias("default"))
    rows = table(spark, sf, "customer").select(
        key.alias("name"), F.array(item(0), item(1), item(2)).alias("parameters"),
        F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda i: F.struct(
            i.alias("pos"), F.concat(F.lit("q"), i.cast("string")).alias("name"),
            F.lit("1.0.0").alias("version"))).alias("products"))
    params = C.explode_parameters(rows).select(
        F.col("spec").alias("name"), "pos", F.col("name").alias("item"), F.col("default").alias("value"))
    products = C.explode_products(rows).select(
        F.col("release").alias("name"), "pos", F.col("product").alias("item"), F.col("version").alias("value"))
    return params.unionByName(products)


def join_lists(spark, sf):
    labels = F.array_compact(F.array(
        F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("third"))))
    rows = table(spark, sf, "documents").select(
        "doc_id", labels.alias("labels"), F.when(F.col("doc_id") % 2 == 0, labels).alias("other"))
    return C.join_lists(rows, ["labels", "other"])


def joined_items(spark, sf):
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("items"))
    return join_text(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "items")


def describe(spark, sf):
    return C.describe(table(spark, sf, "part"), "red widget", "p_name").select(
        "p_partkey", "p_name", "p_brand")


def lookup(spark, sf):
    requests = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("name"))
    specs_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), "c_mktsegment")
    return C.lookup(requests, specs_).rows


def param_parse(spark, sf):
    return specs.parse_parameters(view(spark, sf, "v_text_param"), "text").rows.select(
        "event_id", "name", "value", "error")


def param_lists(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a="), k, F.lit(" b="), k)).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("a="), k, F.lit("  b="), k)).otherwise(
        F.concat(F.lit("a="), k, F.lit(" b c=1")))
    rows = specs.parse_parameter_lists(
        table(spark, sf, "events").select("event_id", text.alias("text")), "text").rows
    return rows.select("event_id", F.col("pos").cast("int").alias("pos"), "name", "value", "error")


def param_overlay(spark, sf):
    parsed = specs.parse_parameters(view(spark, sf, "v_text_param"), "text").rows
    unread = parsed.filter(F.col("error").isNotNull()).select("request", F.col("error").alias("state"))
    given = parsed.filter(F.col("error").isNull()).select("request", "name", "value", F.col("event_id").alias("pos"))
    defaults = table(spark, sf, "events").select(F.col("user_id").alias("request")).distinct().select(
        "request", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select(
        "request", F.concat(F.lit("k"), F.col("pos").cast("string")).alias("name"),
        F.concat(F.lit("d"), F.col("pos").cast("string")).alias("default"), "pos")
    rows = C.overlay_parameters(defaults, given).rows
    return rows.select(
        "request", F.coalesce("name", "parameter").alias("name"), F.coalesce("value", "expected").alias("value"),
        F.coalesce("error", F.lit("ok")).alias("state")).unionByName(unread, allowMissingColumns=True)


def context_overlay(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    params = text_map({"K": k, "STACK": "user", "NAMESPACE": "user"})
    stack, namespace = F.col("event_type"), F.concat(F.lit("ns"), (F.col("user_id") % 5).cast("string"))
    demo = F.concat(F.lit("demo-"), F.col("user_id").cast("string"))
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, C.add_context(params, namespace, stack, demo))
        .otherwise(C.add_context(params, namespace, stack)).alias("m"))
    cell = lambda n: F.try_element_at("m", F.lit(n)).alias(n.lower())
    return rows.select("event_id", cell("K"), cell("STACK"), cell("DEMO"), cell("NAMESPACE"),
                       F.size("m").alias("entries"))


RELEASES = """SELECT p_brand AS catalog, 0 AS source_ord, p_partkey AS pos,
              CASE WHEN p_partkey % 9 = 0 THEN 'dev' ELSE CAST(p_size AS STRING) || '.'
                   || CAST(p_partkey % 12 AS STRING) END AS name FROM {part}"""
REQUESTS = """SELECT c_custkey AS id, 'Brand#' || CAST(c_custkey % 27 AS STRING) AS catalog,
              CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'dev'
                   ELSE CAST(c_custkey % 50 AS STRING) || '.' || CAST(c_custkey % 12 AS STRING) END AS requested,
              CASE WHEN c_custkey % 3 = 0 THEN 'default' ELSE 'own' END AS namespace FROM {customer}"""


def branch_namespace(spark, sf):
    both = C.release_branch(query(spark, sf, REQUESTS), query(spark, sf, RELEASES)).rows
    target = C.effective_namespace(F.col("namespace"), F.lit("spec"), F.col("id") % 2 == 0)
    return both.select("id", F.when(F.col("error").isNull(), F.col("branch")).alias("branch"), "error",
                       target.alias("target"))


def attach_values(spark, sf):
    names = F.array(*[F.lit(n) for n in OPERATORS])
    operators = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"),
        F.get(names, (F.col("o_orderkey") % len(OPERATORS)).cast("int")).alias("operator"))
    key = F.col("c_custkey")
    values = table(spark, sf, "customer").select(
        key.alias("cluster"),
        F.when(key % 2 == 0, "listener-operator").otherwise("trino-operator").alias("chart"),
        text_map({"replicas": (key % 5).cast("string"), "preset": "user"}).alias("values"))
    rows = C.attach_values(operators, values, F.lit("stable-nodes"), on=["cluster"])
    cell = lambda n: F.try_element_at("values", F.lit(n)).alias(n)
    return rows.select("id", "operator", cell("preset"), cell("replicas"), F.size("values").alias("entries"))


def page_audit(spark, sf):
    # Repository 3 misses page 2; the last page of each repository is as long as it comes.
    rows = query(spark, sf, """
        SELECT o_orderkey % 25 AS repository, o_orderkey AS pos,
               CAST(floor(o_orderkey / 500.0) AS INT) + 1
               + CASE WHEN o_orderkey % 25 = 3 AND o_orderkey >= 500 THEN 1 ELSE 0 END AS page
        FROM {orders}""")
    out = audit_pages(rows)
    return out.select("repository", "last_page", F.col("pages").cast("bigint").alias("pages"),
                      F.col("last_count").cast("bigint").alias("last_count"), "problem")


LISTED = """SELECT o_custkey % 97 AS repository, CAST(floor(o_orderkey / 300.0) AS INT) + 1 AS page, o_orderkey % 120 AS pos FROM {orders}"""


def page_gap_intervals(spark, sf):
    return page_gaps(query(spark, sf, LISTED))


QUERIES = {
    "page_gap_intervals": page_gap_intervals, "overlay": overlay, "source_order": source_order, "resolve_chain": resolve_chain,
    "dangling": dangling, "include_exclude": include_exclude, "include_table": include_table, "namespace_ok": namespace_ok,
    "explode_items": explode_items, "join_lists": join_lists, "joined_items": joined_items,
    "describe": describe, "lookup": lookup, "param_parse": param_parse, "param_lists": param_lists,
    "param_overlay": param_overlay, "context_overlay": context_overlay,
    "branch_namespace": branch_namespace, "attach_values": attach_values, "page_audit": page_audit,
}

_NAMES = "[" + ", ".join(f"'{n}'" for n in OPERATORS) + "]"

ORACLE = {
    "page_gap_intervals": f"""
        WITH listed AS ({LISTED}), pages AS (SELECT DISTINCT repository, page FROM listed),
        gaps AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY repository ORDER BY page), 0) AS before FROM pages),
        doubled AS (SELECT repository, page, max(n) AS copies FROM (
            SELECT repository, page, pos, count(*) AS n FROM listed GROUP BY ALL) GROUP BY ALL HAVING max(n) > 1)
        SELECT repository, CAST(before + 1 AS INT) AS first_page, CAST(page - 1 AS INT) AS last_page, 'MissingPages' AS problem, CAST(NULL AS BIGINT) AS copies
        FROM gaps WHERE page > before + 1
        UNION ALL SELECT repository, page, page, 'DoubledPage', copies FROM doubled""",
    "overlay": """
        SELECT *, row_number() OVER (ORDER BY source_ord, pos) AS row_no FROM (
          SELECT name, CAST(place // 1000000000000 AS INT) AS source_ord, place % 1000000000000 AS pos, value FROM (
            SELECT name, min(source_ord * 1000000000000 + pos) AS place,
                   arg_max(value, source_ord * 1000000000000 + pos) AS value FROM {v_def} GROUP BY name))""",
    "source_order": """
        SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS pos, 0 AS source_ord FROM {nation}
        UNION ALL SELECT s_name, s_suppkey, 1 FROM {supplier}
        UNION ALL SELECT c_name, c_custkey, 2 FROM {customer}""",
    "resolve_chain": f"""
        SELECT d.name AS demo, s.name AS stack, s.release, CAST(i AS INT) AS pos,
               'p' || CAST(i AS STRING) AS product,
               CAST(n_nationkey % 10 AS STRING) || '.' || CAST(i AS STRING) || '.0' AS version
        FROM ({DEMOS}) d JOIN ({STACKS}) s ON d.stack = s.name JOIN {{nation}} ON n_nationkey = s.release
        JOIN (VALUES (0), (1), (2), (3), (4)) g(i)
          ON s.name % 4 = 0 OR i = s.name % 5 OR i = (s.name + 1) % 5""",
    "dangling": f"""
        SELECT 'NoSuchStack' AS error, name, stack AS missing FROM ({DEMOS})
        WHERE stack NOT IN (SELECT c_custkey FROM {{customer}})
        UNION ALL
        SELECT 'NoSuchRelease', name, release FROM ({STACKS})
        WHERE release NOT IN (SELECT n_nationkey FROM {{nation}})""",
    "include_exclude": """
        SELECT p_partkey, lower(p_type) AS product, 'both' AS mode FROM {part} WHERE p_type IN ('ECONOMY')
        UNION ALL
        SELECT p_partkey, lower(p_type), 'all' FROM {part} WHERE p_type NOT IN ('PROMO', 'LARGE')""",
    "include_table": """
        SELECT p_partkey, lower(p_type) AS product FROM {part}
        WHERE p_type IN (SELECT p_type FROM {part} WHERE p_size < 20) AND p_type <> 'PROMO'""",
    "namespace_ok": """
        SELECT id, name, namespace,
               CASE WHEN c_custkey IS NULL THEN '' ELSE CASE name % 3 WHEN 0 THEN '' WHEN 1 THEN 'ns1'
                    ELSE 'ns0, ns2' END END AS supported,
               CASE WHEN c_custkey IS NULL THEN 'NoSuchSpec'
                    WHEN name % 3 = 1 AND id % 4 <> 1 OR name % 3 = 2 AND id % 4 NOT IN (0, 2)
                    THEN 'UnsupportedNamespace' END AS error
        FROM (SELECT o_orderkey AS id, 'ns' || CAST(o_orderkey % 4 AS STRING) AS namespace,
                     CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS name
              FROM {orders}) LEFT JOIN {customer} ON name = c_custkey""",
    "explode_items": """
        SELECT c_custkey AS name, CAST(i AS INT) AS pos,
               'p' || CAST(i AS STRING) || '-' || lower(c_mktsegment) AS item,
               CAST(c_custkey + i AS STRING) AS value
        FROM {customer}, (VALUES (0), (1), (2)) g(i)
        UNION ALL
        SELECT c_custkey, i, 'q' || CAST(i AS STRING), '1.0.0'
        FROM {customer}, (VALUES (0), (1), (2)) g(i) WHERE i <= c_custkey % 3""",
    "join_lists": """
        SELECT doc_id, t AS labels, CASE WHEN doc_id % 2 = 0 THEN t ELSE '' END AS other
        FROM (SELECT doc_id, concat_ws(', ', lang, source, CASE WHEN doc_id % 3 = 0 THEN 'third' END) AS t
              FROM {documents})""",
    "joined_items": """
        SELECT l_orderkey, CAST((rn - 1) // 1000 AS INT) AS part, string_agg(t, ', ' ORDER BY rn) AS items
        FROM (SELECT l_orderkey, CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) AS t,
                     row_number() OVER (PARTITION BY l_orderkey
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM {lineitem})
        GROUP BY ALL""",
    "describe": "SELECT p_partkey, p_name, p_brand FROM {part} WHERE p_name = 'red widget'",
    "lookup": """
        SELECT o_custkey * 2 AS name, o_orderkey, c_mktsegment,
               CASE WHEN c_custkey IS NULL THEN 'NoSuchSpec' END AS error
        FROM {orders} LEFT JOIN {customer} ON o_custkey * 2 = c_custkey""",
    "param_parse": """
        SELECT event_id,
               CASE WHEN event_id % 9 > 4 THEN split_part(trim(text), '=', 1) END AS name,
               CASE WHEN event_id % 9 > 4 THEN split_part(trim(text), '=', 2) END AS value,
               CASE event_id % 9 WHEN 0 THEN 'EmptyInput' WHEN 1 THEN 'InvalidEqualSignCount'
                    WHEN 2 THEN 'EmptyValue' WHEN 3 THEN 'EmptyName' WHEN 4 THEN 'InvalidEqualSignCount' END AS error
        FROM {v_text_param}""",
    "param_lists": """
        WITH k AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM {events})
        SELECT event_id, 0 AS pos, 'a' AS name, k AS value, NULL AS error FROM k WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 1, 'b', k, NULL FROM k WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, NULL, NULL, NULL,
          CASE WHEN event_id % 3 = 1 THEN 'EmptyInput' ELSE 'InvalidEqualSignCount' END FROM k WHERE event_id % 3 <> 0""",
    "param_overlay": """
        WITH given AS (
          SELECT request, split_part(trim(text), '=', 1) AS name, split_part(trim(text), '=', 2) AS value, event_id
          FROM {v_text_param} WHERE event_id % 9 > 4),
        last AS (SELECT request, name, arg_max(value, event_id) AS value FROM given GROUP BY ALL),
        bad AS (SELECT request, arg_min(name, event_id) AS name FROM given
                WHERE name NOT IN ('k0', 'k1', 'k2', 'k3') GROUP BY request),
        defaults AS (SELECT DISTINCT user_id AS request, 'k' || CAST(i AS STRING) AS name,
                            'd' || CAST(i AS STRING) AS value
                     FROM {events}, (VALUES (0), (1), (2), (3)) g(i))
        SELECT d.request, d.name, coalesce(l.value, d.value) AS value, 'ok' AS state
        FROM defaults d LEFT JOIN last l ON d.request = l.request AND d.name = l.name
        WHERE d.request NOT IN (SELECT request FROM bad)
        UNION ALL SELECT request, name, 'k0, k1, k2, k3', 'InvalidParameter' FROM bad
        UNION ALL SELECT request, NULL, NULL, CASE event_id % 9 WHEN 0 THEN 'EmptyInput' WHEN 2 THEN 'EmptyValue'
          WHEN 3 THEN 'EmptyName' ELSE 'InvalidEqualSignCount' END FROM {v_text_param} WHERE event_id % 9 <= 4""",
    "context_overlay": """
        SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, event_type AS stack,
               CASE WHEN event_id % 2 = 0 THEN 'demo-' || CAST(user_id AS STRING) END AS demo,
               'ns' || CAST(user_id % 5 AS STRING) AS namespace,
               CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END AS entries
        FROM {events}""",
    "branch_namespace": f"""
        WITH rel AS ({RELEASES}),
        first AS (SELECT catalog, arg_min(name, pos) AS name FROM rel GROUP BY catalog),
        joined AS (
          SELECT q.*, f.name AS first_name,
                 EXISTS (SELECT 1 FROM rel r WHERE r.catalog = q.catalog AND r.name = q.requested) AS known
          FROM ({REQUESTS}) q LEFT JOIN first f ON q.catalog = f.catalog),
        judged AS (
          SELECT *, CASE WHEN requested IS NOT NULL AND NOT known THEN 'NoSuchRelease'
                         WHEN requested IS NULL AND first_name IS NULL THEN 'LatestRelease' END AS error FROM joined)
        SELECT id, CASE WHEN error IS NULL THEN
                     CASE WHEN requested IS NULL THEN 'release-' || first_name WHEN requested = 'dev' THEN 'main'
                          ELSE 'release-' || requested END END AS branch, error,
               CASE WHEN namespace = 'default' AND id % 2 = 0 THEN 'spec' ELSE namespace END AS target
        FROM judged""",
    "attach_values": f"""
        WITH o AS (SELECT o_orderkey AS id, o_custkey, {_NAMES}[o_orderkey % {len(OPERATORS)} + 1] AS operator
                   FROM {{orders}}),
        j AS (SELECT id, operator, c_custkey FROM o LEFT JOIN {{customer}} ON o_custkey = c_custkey
              AND operator = CASE WHEN c_custkey % 2 = 0 THEN 'listener' ELSE 'trino' END)
        SELECT id, operator,
               CASE WHEN operator = 'listener' THEN 'stable-nodes' WHEN c_custkey IS NOT NULL THEN 'user' END AS preset,
               CAST(c_custkey % 5 AS STRING) AS replicas,
               CASE WHEN c_custkey IS NOT NULL THEN 2 WHEN operator = 'listener' THEN 1 ELSE 0 END AS entries
        FROM j""",
    "page_audit": """
        WITH rows AS (
          SELECT o_orderkey % 25 AS repository,
                 CAST(o_orderkey // 500 AS INT) + 1
                 + CASE WHEN o_orderkey % 25 = 3 AND o_orderkey >= 500 THEN 1 ELSE 0 END AS page FROM {orders}),
        pages AS (SELECT repository, page, count(*) AS n FROM rows GROUP BY ALL)
        SELECT repository, max(page) AS last_page, count(*) AS pages, arg_max(n, page) AS last_count,
               CASE WHEN min(page) <> 1 OR count(*) <> max(page) THEN 'MissingPage'
                    WHEN max(n) > 20 THEN 'OversizedPage'
                    WHEN arg_max(n, page) >= 20 THEN 'UnfinishedListing'
                    WHEN count(*) FILTER (n < 20) > 1 THEN 'ShortPageInside' END AS problem
        FROM pages GROUP BY repository""",
}
