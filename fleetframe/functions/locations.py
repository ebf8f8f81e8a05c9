"""Location classifiers, derived URLs and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .semver import prerelease


def chart_source_kind(url: Column) -> Column:
    return (
        F.when(url.startswith("oci://"), "Oci")
        .when(url.startswith("http://") | url.startswith("https://"), "Repo")
        .otherwise("Local")
    )


def path_or_url(location: Column) -> Column:
    is_url = location.startswith("http://") | location.startswith("https://")
    return F.when(is_url, "Url").otherwise("Path")


def crd_url(product: Column, version: Column, template: str) -> Column:
    """Definition URL of a product; ``template`` has two ``%s``: product, then branch.

    A version whose pre-release is exactly ``dev`` lives on branch ``main``.
    Without a product or version there is no URL.
    """
    branch = F.when(prerelease(version) == "dev", "main").otherwise(version)
    return F.when(product.isNotNull() & branch.isNotNull(), F.format_string(template, product, branch))


def cache_key(url: Column) -> Column:
    """File-system safe key: other than letters and digits become ``-``, then the hash."""
    safe = F.regexp_replace(url, r"[^\p{IsAlphabetic}\p{N}]", "-")
    return F.concat(safe, F.lit("-"), F.sha2(url, 256))
