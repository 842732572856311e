"""Values of any depth: one canonical form in which equal values are equal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """JSON text with the keys of every object sorted by code points, without blanks, numbers without trailing zeros; arrays keep their order.

    Null for what isn't JSON (a repeated key included). Numbers with an exponent are doubles
    and equal only such numbers.
    """
    return F.to_json(F.try_parse_json(c))


def value_hash(c: Column) -> Column:
    """SHA-256 of the canonical form: a join or grouping key for values of any depth; null stays null."""
    return F.sha2(canonical_json(c), 256)


def values_equal(a: Column, b: Column) -> Column:
    """Deep equality of JSON values, nulls included; text that isn't JSON equals only the same text."""
    form = lambda c: F.coalesce(canonical_json(c), c)
    return form(a).eqNullSafe(form(b))
