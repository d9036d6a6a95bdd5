"""Reading dynamic headers: field access, null against missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(fm: Column, name: str, kind: str = "string") -> Column:
    """Value at a dotted or bracketed name; a missing key and a wrong shape are null."""
    path = "$" + "".join(f"['{part}']" for part in name.split("."))
    return F.try_variant_get(fm, path, kind)


def note_name(fm: Column, file_name: Column) -> Column:
    """``name`` of the header, else the file's own name."""
    stated = field(fm, "name")
    return F.when(F.trim(stated) != "", stated).otherwise(file_name)


def is_defined(fm: Column, name: str) -> Column:
    """The key is there, even when its value is null."""
    return F.coalesce(F.array_contains(F.map_keys(fm.try_cast("map<string,variant>")), name), F.lit(False))


def is_null(fm: Column, name: str) -> Column:
    """The key is missing or its value is null."""
    v = field(fm, name, "variant")
    return v.isNull() | F.is_variant_null(v)
