"""Compile a type schema (a few kilobytes of configuration) into small dimension tables.

A schema is a dict: ``{"types": {name: {...}}, "traits": {name: {...}}, "config": {...}}``.
Types inherit along ``extends``; the nearer ancestor wins, traits replace inherited fields, own
fields merge over inherited ones and replace trait fields.
"""

from __future__ import annotations

import json

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TYPE_ROW = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("ancestors", T.ArrayType(T.StringType())),
    T.StructField("descendants", T.ArrayType(T.StringType())),
    T.StructField("output_dir", T.StringType()),
    T.StructField("recursive", T.BooleanType()),
    T.StructField("description", T.StringType()),
])

FIELD_ROW = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("multiple", T.BooleanType()),
    T.StructField("default", T.StringType()),
    T.StructField("default_json", T.StringType()),
    T.StructField("static_value", T.StringType()),
    T.StructField("options", T.ArrayType(T.StringType())),
    T.StructField("source_types", T.ArrayType(T.StringType())),
    T.StructField("granularity", T.StringType()),
    T.StructField("owned", T.BooleanType()),
    T.StructField("alias", T.BooleanType()),
    T.StructField("derived_expr", T.StringType()),
    T.StructField("derived_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
])


@dataclass
class TypeSchema:
    raw: dict
    parent: dict[str, str | None]
    ancestors: dict[str, list[str]]
    descendants: dict[str, list[str]]
    fields: dict[str, dict[str, dict]]
    output_dir: dict[str, str]
    config: dict = dc_field(default_factory=dict)

    # -- names ------------------------------------------------------------
    def resolve_name(self, name: str) -> str | None:
        """``a/b`` names ``b`` when every prefix is one of its ancestors."""
        *prefixes, last = name.split("/")
        if last not in self.parent:
            return None
        return last if all(p in self.ancestors[last] for p in prefixes) else None

    def family(self, name: str) -> list[str]:
        """The type and everything below it; what selecting a type means."""
        found = self.resolve_name(name)
        if found is None:
            raise ValueError(f"unknown type: {name}")
        return [found, *self.descendants[found]]

    def spec(self, type_name: str) -> dict:
        return self.raw["types"][type_name]

    def alias_field(self, type_name: str) -> str | None:
        return next((f for f, d in self.fields[type_name].items() if d.get("alias")), None)

    def source_family(self, definition: dict) -> list[str]:
        names: list[str] = []
        for source in definition.get("source", []):
            names += [n for n in self.family(source) if n not in names]
        return names

    def parent_like_fields(self, type_name: str) -> list[str]:
        """Fields whose link makes a note a child: parent, owner, or a single relation named as
        its own source type of the same ancestry."""
        lineage = {type_name, *self.ancestors[type_name]}
        found = []
        for name, d in self.fields[type_name].items():
            if d.get("kind") != "relation" or d.get("multiple"):
                continue
            sources = d.get("source", [])
            if name == "parent" or (name in sources and name in lineage):
                found.append(name)
            elif name == "owner" and self.ownable(type_name):
                found.append(name)
        return found

    def ownable(self, type_name: str) -> bool:
        return any(d.get("owned") and type_name in self.source_family(d)
                   for fields in self.fields.values() for d in fields.values())

    # -- dimension tables -------------------------------------------------
    def types_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, self.parent[t], self.ancestors[t], self.descendants[t], self.output_dir[t],
                 bool(self.spec(t).get("recursive")), self.spec(t).get("description"))
                for t in self.parent]
        return spark.createDataFrame(rows, TYPE_ROW)

    def fields_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for t, fields in self.fields.items():
            for i, (name, d) in enumerate(fields.items()):
                derived = d.get("derived") or {}
                rows.append((t, name, d.get("kind"), bool(d.get("required")),
                             bool(d.get("multiple")) or d.get("kind") == "list",
                             _text(d.get("default")),
                             None if d.get("default") is None else json.dumps(d["default"], ensure_ascii=False, default=str),
                             _text(d.get("value")),
                             list(d.get("options", [])), self.source_family(d),
                             d.get("granularity", "day"), bool(d.get("owned")),
                             bool(d.get("alias")), derived.get("expression"),
                             derived.get("type"), d.get("description"), i))
        return spark.createDataFrame(rows, FIELD_ROW)


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ", ".join(map(str, value))
    return str(value)


def compile_types(raw: dict) -> TypeSchema:
    types: dict[str, dict] = raw["types"]
    parent = {t: spec.get("extends") for t, spec in types.items()}
    ancestors: dict[str, list[str]] = {}
    for t in types:
        chain, seen, at = [], {t}, parent[t]
        while at is not None:
            if at in seen:
                raise ValueError(f"inheritance cycle at type {t}")
            if at not in types:
                raise ValueError(f"type {t} extends unknown type {at}")
            chain.append(at)
            seen.add(at)
            at = parent[at]
        ancestors[t] = chain
    descendants = {t: [d for d in types if t in ancestors[d]] for t in types}

    fields: dict[str, dict[str, dict]] = {}
    for t in sorted(types, key=lambda name: len(ancestors[name])):
        spec = types[t]
        inherited = dict(fields[parent[t]]) if parent[t] else {}
        from_traits: dict[str, dict] = {}
        for trait in spec.get("traits", []):
            from_traits.update(raw.get("traits", {})[trait].get("fields", {}))
        merged = {**inherited, **from_traits}
        for name, own in spec.get("fields", {}).items():
            merged[name] = own if name in from_traits else {**merged.get(name, {}), **own}
        if spec.get("recursive") and "parent" not in merged:
            merged["parent"] = {"kind": "relation", "source": [t]}
        order = [f for f in spec.get("field_order", []) if f in merged]
        order += [f for f in merged if f not in order]
        fields[t] = {f: merged[f] for f in order}

    def folder(t: str) -> str:
        if types[t].get("output_dir"):
            return types[t]["output_dir"]
        own = types[t].get("plural", t + "s")
        return f"{folder(parent[t])}/{own}" if parent[t] else own

    return TypeSchema(raw, parent, ancestors, descendants,
                      {t: fields[t] for t in types}, {t: folder(t) for t in types},
                      raw.get("config", {}))
