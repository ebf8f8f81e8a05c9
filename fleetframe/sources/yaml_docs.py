"""YAML corpora: files of catalogs, indexes, values and manifests as rows of JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..errors import Split, split
from ..schemas import CHART_FILE, RELEASE_SPEC, demo_spec, stack_spec


def parse_yaml(
    df: DataFrame, text: str = "text", root: str | None = None, on_error: str = "quarantine"
) -> Split:
    """Parse a text column of (multi-document) YAML into rows ``doc_pos``, ``json``.

    With ``root``, the mapping under that key is unfolded: one row per entry with its
    ``name`` and 0-based ``pos`` in the document. Scalars stay text, so ``23.10`` keeps its
    zero and dates are not rewritten; only null values are null. A bad document rejects its whole text.
    """
    kept = [c for c in df.columns if c != text]
    extra = [StructField("doc_pos", IntegerType())]
    if root is not None:
        extra += [StructField("pos", IntegerType()), StructField("name", StringType())]
    extra += [StructField("json", StringType()), StructField("error", StringType())]
    schema = StructType([f for f in df.schema.fields if f.name in kept] + extra)
    names = [f.name for f in extra]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        class loader(getattr(yaml, "CBaseLoader", yaml.BaseLoader)):
            """Scalars stay text, but an absent value is absent."""

        loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile("^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
        loader.add_constructor("tag:yaml.org,2002:null", lambda self, node: None)
        for batch in batches:
            source, cells = [], {n: [] for n in names}
            for i, value in enumerate(batch.column(text).to_pylist()):
                for row in _documents(yaml, loader, value, root):
                    source.append(i)
                    for n in names:
                        cells[n].append(row.get(n))
            rows = batch.select(kept).take(pa.array(source, pa.int64()))
            types = {"doc_pos": pa.int32(), "pos": pa.int32()}
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in kept]
                + [pa.array(cells[n], types.get(n, pa.string())) for n in names],
                names=kept + names,
            )

    return split(df.select(*kept, text).mapInArrow(parse, schema), "error", on_error)


def _documents(yaml, loader, text, root):
    """Rows of one text; every document is parsed before any row of it is given out."""
    try:
        docs = list(yaml.load_all(text or "", Loader=loader))
        if root is None:
            return [{"doc_pos": i, "json": json.dumps(d, ensure_ascii=False)}
                    for i, d in enumerate(docs)]
        rows = []
        for i, doc in enumerate(docs):
            if not isinstance(doc, dict) or not isinstance(doc.get(root), dict):
                return [{"error": f"missing mapping {root!r}"}]
            rows += [
                {"doc_pos": i, "pos": p, "name": n, "json": json.dumps(s, ensure_ascii=False)}
                for p, (n, s) in enumerate(doc[root].items())
            ]
        return rows
    except (yaml.YAMLError, ValueError, RecursionError, TypeError) as e:
        return [{"error": f"{type(e).__name__}: {' '.join(str(e).split())}"}]


def read_yaml_documents(
    spark: SparkSession, paths: Sequence[str] | str, root: str | None = None,
    partitions: int | None = None, on_error: str = "quarantine",
) -> Split:
    """YAML files as rows (file, source_ord, doc_pos, [pos, name,] json).

    Each path is a file, folder or pattern; its place in the list is ``source_ord``, so
    later paths take precedence in :func:`~fleetframe.operators.catalog.overlay_last_wins`.
    ``partitions`` spreads many small files before the parser, which is the costly step.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    texts = None
    for i, path in enumerate(listed):
        one = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.lit(i).alias("source_ord"),
            F.col("value").alias("text"),
        )
        texts = one if texts is None else texts.unionByName(one)
    if partitions:
        texts = texts.repartition(partitions, "file")
    return parse_yaml(texts, "text", root, on_error)


def _spec(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(
        "name", "source_ord", "file", "doc_pos", "pos", F.from_json("json", schema).alias("s")
    )


def _list(name: str, kind: str = "string"):
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def _manifests():
    return F.transform(
        F.coalesce(F.col("s.manifests"),
                   F.array().cast("array<struct<helmChart:string,plainYaml:string>>")),
        lambda m: F.struct(
            F.when(m["helmChart"].isNotNull(), "helmChart").otherwise("plainYaml").alias("kind"),
            F.coalesce(m["helmChart"], m["plainYaml"]).alias("location"),
        ),
    )


def _common():
    return [
        F.col("s.description").alias("description"),
        _list("s.supportedNamespaces").alias("supported_namespaces"),
        _list("s.labels").alias("labels"),
        _manifests().alias("manifests"),
        F.col("s.resourceRequests").alias("resource_requests"),
        _list("s.parameters", "struct<name:string,description:string,default:string>")
        .alias("parameters"),
    ]


ORDER_COLUMNS = ("source_ord", "file", "doc_pos", "pos")


def read_demos(spark, paths, vendor: str, on_error: str = "quarantine") -> Split:
    """Demo catalogs (root ``demos``); references use the field ``<vendor>Stack``.

    Definitions of one name are not merged yet: overlay them by :data:`ORDER_COLUMNS`.
    """
    rows, rejects = read_yaml_documents(spark, paths, "demos", on_error=on_error)
    return Split(_spec(rows, demo_spec(vendor)).select(
        "name", *ORDER_COLUMNS, F.col("s.documentation").alias("documentation"),
        F.col(f"s.{vendor}Stack").alias("stack"), *_common(),
    ), rejects)


def read_stacks(spark, paths, vendor: str, on_error: str = "quarantine") -> Split:
    """Stack catalogs (root ``stacks``); fields ``<vendor>Release``, ``<vendor>Operators``."""
    rows, rejects = read_yaml_documents(spark, paths, "stacks", on_error=on_error)
    return Split(_spec(rows, stack_spec(vendor)).select(
        "name", *ORDER_COLUMNS, F.col(f"s.{vendor}Release").alias("release"),
        _list(f"s.{vendor}Operators").alias("operators"), *_common(),
    ), rejects)


def read_release_catalog(spark, paths, on_error: str = "quarantine") -> Split:
    """Release catalogs (root ``releases``) with products in document order."""
    rows, rejects = read_yaml_documents(spark, paths, "releases", on_error=on_error)
    products = F.transform(
        F.map_entries("s.products"),
        lambda e, i: F.struct(i.alias("pos"), e["key"].alias("name"),
                              e["value"]["operatorVersion"].alias("version")),
    )
    return Split(_spec(rows, RELEASE_SPEC).select(
        "name", *ORDER_COLUMNS, F.col("s.releaseDate").alias("release_date"),
        F.try_to_date("s.releaseDate").alias("release_day"),
        F.col("s.description").alias("description"), products.alias("products"),
    ), rejects)


def read_chart_files(spark, paths, on_error: str = "quarantine") -> Split:
    """Chart files as (release_name, name, repo, version, options as JSON text)."""
    rows, rejects = read_yaml_documents(spark, paths, on_error=on_error)
    chart = rows.select("file", "source_ord", "doc_pos", F.from_json("json", CHART_FILE).alias("c"))
    return Split(chart.select(
        "file", "source_ord", "doc_pos", F.col("c.releaseName").alias("release_name"),
        F.col("c.name").alias("name"), F.col("c.repo").alias("repo"),
        F.col("c.version").alias("version"), F.col("c.options").alias("options"),
    ), rejects)


def read_chart_index(spark, paths, on_error: str = "quarantine") -> Split:
    """Chart repository indexes as (repo = file, entries map) for ``explode_index``."""
    rows, rejects = read_yaml_documents(spark, paths, on_error=on_error)
    entries = F.from_json(
        "json", "entries MAP<STRING, ARRAY<STRUCT<name: STRING, version: STRING>>>"
    )["entries"]
    return Split(rows.select(F.col("file").alias("repo"), entries.alias("entries")), rejects)


def manifest_objects(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Manifest documents as object rows for ``object_identity`` and ``diff_objects``."""
    schema = (
        "apiVersion STRING, kind STRING, "
        "metadata STRUCT<name: STRING, namespace: STRING, labels: MAP<STRING, STRING>, "
        "resourceVersion: STRING>"
    )
    o = F.from_json(json_col, schema)
    return docs.withColumn("_o", o).select(
        *[c for c in docs.columns if c != json_col],
        F.col("_o.apiVersion").alias("api_version"), F.col("_o.kind").alias("kind"),
        F.col("_o.metadata.name").alias("name"), F.col("_o.metadata.namespace").alias("namespace"),
        F.col("_o.metadata.labels").alias("labels"),
        F.col("_o.metadata.resourceVersion").alias("resource_version"),
        F.col(json_col).alias("body"),
    )
