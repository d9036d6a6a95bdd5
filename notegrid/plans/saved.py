"""Saved queries: a small record becomes one lazy DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from notegrid.operators import order as O
from notegrid.operators import select as S
from notegrid.types import TypeSchema

KEYS = {"type", "path", "where", "body", "id", "fields", "sort", "desc", "limit", "count"}


def saved_query(notes: DataFrame, schema: TypeSchema, record: dict | str) -> DataFrame:
    """type, path, body, id and where select; then count, or sort, limit and fields.

    ``where`` is Spark SQL, a text or a list of texts that all must hold.
    """
    spec = json.loads(record) if isinstance(record, str) else record
    unknown = set(spec) - KEYS
    if unknown:
        raise ValueError(f"unknown keys in saved query: {sorted(unknown)}")
    df = S.select_all_of(notes, schema, type_name=spec.get("type"), path=spec.get("path"),
                         body=spec.get("body"), note_id=spec.get("id"))
    where = spec.get("where", [])
    for condition in [where] if isinstance(where, str) else where:
        df = df.filter(condition)
    if spec.get("count"):
        return O.count_rows(df)
    if spec.get("sort"):
        df = O.sort_rows(df, spec["sort"], bool(spec.get("desc")))
    if spec.get("limit"):
        df = df.limit(int(spec["limit"]))
    return df.select("path", "name", *spec["fields"]) if spec.get("fields") else df


def save_view(notes: DataFrame, schema: TypeSchema, name: str, record: dict | str) -> None:
    saved_query(notes, schema, record).createOrReplaceTempView(name)
