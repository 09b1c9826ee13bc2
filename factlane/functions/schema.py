"""Explicit schemas, written as text and built without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}


def kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(kind(text[6:-1]))
    return SIMPLE[text]()


def struct(text: str, **nested: str) -> T.StructType:
    """'name type, ...' as a StructType; each nested one is appended as an array of structs."""
    fields = [T.StructField(name, kind(what)) for name, what in (part.split() for part in text.replace("\n", " ").split(","))]
    fields += [T.StructField(name, T.ArrayType(struct(inner))) for name, inner in nested.items()]
    return T.StructType(fields)
