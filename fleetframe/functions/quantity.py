"""Kubernetes resource quantities as exact decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_QUANTITY = (
    r"^([+-]?)(?=\.?[0-9])([0-9]*)(?:\.([0-9]*))?"
    r"([eE][+-]?[0-9]+|n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)?\z"
)

# --- fixed values: suffix -> decimal places to the right, or factor ---------------------
PLACES = {"n": -9, "u": -6, "m": -3, "": 0, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}
FACTORS = {"Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "Pi": 2**50, "Ei": 2**60}
# ---------------------------------------------------------------------------------------
MOST_PLACES = 1000
"""Exponents beyond move the point this far: no digit but 0 is left in the type's range."""


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _constant_map(entries: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) if i == 0 else F.lit(str(x)).cast(kind) for pair in entries.items() for i, x in enumerate(pair)])


def _moved(sign: Column, digits: Column, point: Column) -> Column:
    """The number whose decimal point stands after ``point`` of the ``digits`` (below 0: left of them)."""
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(0), -point))
    whole = F.rpad(F.concat(zeros, digits), F.greatest(F.length(digits) - F.least(F.lit(0), point), point), F.lit("0"))
    at = F.greatest(F.lit(0), point)
    text = F.concat(sign, F.lit("0"), F.substr(whole, F.lit(1), at), F.lit("."), F.substr(whole, at + 1))
    return text.try_cast("decimal(38,3)")


def quantity(col: Column, thousands: bool = False) -> Column:
    """``DECIMAL(38,3)`` value of a quantity text, in thousandths if asked; null when malformed.

    Exact for every value the type holds: decimal suffixes and exponents move the decimal point in
    the text, binary suffixes multiply whole numbers apart from fractions. A well-formed value that
    the type cannot hold is null as well; :func:`quantity_error` tells the two apart.
    """
    group = lambda i: F.regexp_extract(col, _QUANTITY, i)
    parts = F.struct(group(1).alias("sign"), group(2).alias("whole"), group(3).alias("after"), group(4).alias("suffix"))
    extra = 3 if thousands else 0

    def places(suffix: Column) -> Column:
        power = F.substr(suffix, F.lit(2))
        far = F.when(power.startswith("-"), -MOST_PLACES).otherwise(MOST_PLACES)
        power = F.greatest(F.lit(-MOST_PLACES), F.least(F.lit(MOST_PLACES), F.coalesce(power.try_cast("int"), far)))
        return F.coalesce(F.try_element_at(_constant_map(PLACES, "int"), suffix), power) + extra

    def value(p: Column) -> Column:
        factors = _constant_map({k: f * 10**extra for k, f in FACTORS.items()}, "decimal(22,0)")
        signed = lambda text, kind: F.concat(p["sign"], F.lit("0"), text).try_cast(kind)
        binary = lambda factor: F.try_add(
            F.try_multiply(signed(p["whole"], "decimal(38,0)"), factor).try_cast("decimal(38,3)"),
            (signed(F.concat(F.lit("."), p["after"]), "decimal(10,9)") * factor).cast("decimal(38,3)"),
        )
        decimal = _once(F.length(p["whole"]) + places(p["suffix"]), lambda point: _moved(
            p["sign"], F.concat(p["whole"], p["after"]), point))
        return _once(F.try_element_at(factors, p["suffix"]), lambda factor: F.when(factor.isNotNull(), binary(factor)).otherwise(decimal))

    return F.when(col.rlike(_QUANTITY), _once(parts, value))


def quantity_error(col: Column, value: Column) -> Column:
    """``Malformed`` or ``Overflow`` for a text without ``value``; null for others and for null."""
    return F.when(col.isNotNull() & value.isNull(), F.when(col.rlike(_QUANTITY), "Overflow").otherwise("Malformed"))


def cpu_millis(col: Column) -> Column:
    """CPU quantity (``2``, ``500m``, ``0.5``) in thousandths of a core."""
    return quantity(col, True)


def memory_bytes(col: Column) -> Column:
    """Memory quantity (``4Gi``, ``512Mi``, ``1000000Ki``) in bytes."""
    return quantity(col)
