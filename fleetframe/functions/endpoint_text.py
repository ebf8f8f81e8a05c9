"""Names and URLs of reachable endpoints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: port names served over plain HTTP -----------------------------------
HTTP_PORTS = ("http", "ui-http", "ui", "airflow", "superset")
# ---------------------------------------------------------------------------------------


def _trim_dashes(text: Column) -> Column:
    return F.ltrim(text, F.lit("-"))


def trim_repeated_prefix(text: Column, prefix: Column) -> Column:
    """Remove every leading copy of ``prefix``; an empty prefix removes nothing."""
    repeated = F.concat(F.lit(r"^(\Q"), prefix, F.lit(r"\E)+"))
    return F.when(
        (prefix != "") & text.startswith(prefix), F.regexp_replace(text, repeated, F.lit(""))
    ).otherwise(text)


def endpoint_name(service: Column, owner: Column, port_name: Column, port: Column) -> Column:
    """``<service without owner prefix>-<port name or number>``, or just the port name."""
    rest = _trim_dashes(trim_repeated_prefix(service, owner))
    label = port_label(port_name, port)
    return F.when(rest == "", label).otherwise(F.concat(rest, F.lit("-"), label))


def port_label(port_name: Column, port: Column) -> Column:
    return F.coalesce(port_name, port.cast("string"))


def endpoint_url(host: Column, port: Column, port_name: Column) -> Column:
    scheme = (
        F.when(port_name.isin(*HTTP_PORTS) | port_name.startswith("http-"), "http://")
        .when((port_name == "https") | port_name.startswith("https-"), "https://")
        .otherwise("")
    )
    return F.concat(scheme, host, F.lit(":"), port.cast("string"))


def listener_display(listener: Column, owner: Column) -> Column:
    """Text after the first occurrence of ``owner``; null when it does not occur."""
    found = F.instr(listener, owner)
    rest = F.substr(listener, found + F.length(owner))
    return F.when(found > 0, _trim_dashes(rest))
