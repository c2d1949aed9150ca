"""Canonical JSON as columns: compact, keys in code-point order, all but ASCII escaped as UTF-16 units (surrogate pairs above U+FFFF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType

#: Characters that stand for themselves in ASCII JSON.
PLAIN = r" !#-\[\]-~"
#: JSON's short escapes.
SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(run: Column) -> Column:
    """A run of plain characters as it is; any other single character escaped."""
    code = F.ascii(run)
    over = code - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(over, 10)), _unit(F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF))))
    out = F.when(run == '"', SHORT['"'])
    for char, short in SHORT.items():
        out = out.when(run == char, short)
    return out.when(code > 0xFFFF, pair).when((code < 32) | (code > 126), _unit(code)).otherwise(run)


def json_text(x: Column) -> Column:
    """A string as ASCII JSON."""
    runs = F.regexp_extract_all(x, F.lit(f"(?s)[{PLAIN}]+|."), F.lit(0))
    body = F.when(x.rlike(f"[^{PLAIN}]"), F.array_join(F.transform(runs, _escaped), "")).otherwise(x)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(value: Column, kind: DataType) -> Column:
    """Strings, whole numbers, booleans, and arrays, maps and structs of such; null is `null`. Fractions have no canonical form here."""
    if isinstance(kind, StringType):
        out = json_text(value)
    elif isinstance(kind, (BooleanType, IntegralType)):
        out = value.cast("string")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, StructType):
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        raise ValueError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def json_list(texts: Column) -> Column:
    """An array of strings as canonical JSON."""
    return canonical_json(texts, ArrayType(StringType()))
