"""Copies of notes under new ids."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.operators.headers import held, json_text
from notegrid.types import TypeSchema

# Fixed value: header keys a copy never inherits.
NOT_INHERITED = ["id", "forked-from", "prev", "next", "aliases", "name"]


def fork_rows(notes: DataFrame, schema: TypeSchema, suffix: str = " copy") -> DataFrame:
    """Copies with a fresh id, the source's id as lineage parent, alias and chain keys dropped,
    fields marked reset-on-fork emptied and defaults filled in. ``source_id`` names the origin.

    The id comes from the source's path and id, so a task that runs twice makes the same copy.
    """
    reset = {t: [f for f, d in fs.items() if d.get("reset_on_fork")] for t, fs in schema.fields.items()}
    gone = F.array(*map(F.lit, NOT_INHERITED))
    for t, fields in reset.items():
        alias = schema.alias_field(t)
        extra = fields + ([alias] if alias else [])
        if extra:
            gone = F.when(F.col("type") == t, F.concat(gone, F.array(*map(F.lit, extra)))).otherwise(gone)
    source = F.try_variant_get("fm", "$.id", "string")
    digest = F.sha2(F.concat_ws("/", F.lit("fork"), "path", source), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    fresh = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])
    text = lambda c: F.parse_json(json_text(c))
    kept = F.map_filter(held(F.col("fm")), lambda k, v: ~F.array_contains(gone, k))
    defaults = F.lit(None)
    for t, fields in schema.fields.items():
        pairs = [(f, d["default"]) for f, d in fields.items() if d.get("default") is not None]
        if pairs:
            filled = F.create_map(*[x for f, v in pairs for x in (F.lit(f), F.parse_json(F.lit(json.dumps(v, ensure_ascii=False, default=str))))])
            missing = F.map_filter(filled, lambda k, v: ~F.array_contains(F.map_keys(kept), k))
            kept = F.when(F.col("type") == t, F.map_concat(kept, missing)).otherwise(kept)
    named = F.map_concat(kept, F.create_map(
        F.lit("id"), text(fresh), F.lit("name"), text(F.concat("name", F.lit(suffix))),
        F.lit("forked-from"), text(source)))
    rest = [c for c in notes.columns if c not in ("path", "name", "fm")]
    return notes.filter(source.isNotNull()).select(
        F.concat("path", F.lit(suffix)).alias("path"), F.concat("name", F.lit(suffix)).alias("name"), *rest,
        source.alias("source_id"), F.to_variant_object(named).alias("fm"))
