"""Canonical JSON text of columns: names in order at every level, one format for numbers, no missing fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.text import json_string

PLACES = 6


def number(value: Column) -> Column:
    """A real number with six places, halves away from zero; what no whole number of millionths can hold is an error."""
    scaled = F.abs(value) * float(10**PLACES) + 0.5
    units = F.when(scaled.isNull() | (scaled < float(1 << 62)), F.floor(scaled)).otherwise(
        F.raise_error(F.lit("a number is too large for six places")).cast("bigint"))
    sign = F.when((value < 0) & (units > 0), "-").otherwise("")
    digits = F.lpad(units.cast("string"), F.greatest(F.length(units.cast("string")), F.lit(PLACES + 1)), F.lit("0"))
    return F.concat(sign, F.left(digits, F.length(digits) - PLACES), F.lit("."), F.right(digits, F.lit(PLACES)))


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON text of a column of any nested type; NULL is ``null``, times are text."""
    if isinstance(kind, T.StructType):
        text = json_object({f.name: canonical(value[f.name], f.dataType) for f in kind.fields})
    elif isinstance(kind, T.ArrayType):
        text = json_array(F.transform(value, lambda x: canonical(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.map_entries(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(
            json_string(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = number(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    else:
        text = json_string(value.cast("string"))
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def json_object(fields: dict[str, Column]) -> Column:
    """An object of fields that are JSON text already."""
    parts = [F.concat(json_string(F.lit(name)), F.lit(":"), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_array(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
