"""Writing notes back: header text in schema order, tables, files and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.operators.headers import held, json_text
from notegrid.session import spread
from notegrid.types import TypeSchema


def render(notes: DataFrame, schema: TypeSchema) -> Column:
    """Raw text of a note. Values are written as JSON, which every YAML reader accepts, with the
    declared fields first in their order and the others after them by name."""
    order = F.lit(None).cast("array<string>")
    for t, fields in schema.fields.items():
        names = F.array(F.lit("type"), *[F.lit(f) for f in fields if f != "type"])
        order = F.when(F.col("type") == t, names).otherwise(order)
    h = held(F.col("fm"))
    keys = F.map_keys(h)
    declared = F.filter(F.coalesce(order, F.array(F.lit("type"))), lambda k: F.array_contains(keys, k))
    rest = F.array_sort(F.array_except(keys, declared))
    line = lambda k: F.concat(F.when(k.rlike(r"^[\w-]+$"), k).otherwise(
        json_text(k)), F.lit(": "), F.to_json(F.try_element_at(h, k)))
    header = F.array_join(F.transform(F.concat(declared, rest), line), "\n")
    return F.when(F.col("fm").isNull(), F.col("body")).otherwise(
        F.concat(F.lit("---\n"), header, F.lit("\n---\n"), F.coalesce("body", F.lit(""))))


def write_table(notes: DataFrame, folder: str) -> None:
    """The corpus as Parquet, one folder per type, so selecting a type reads only its files."""
    notes.write.mode("overwrite").partitionBy("type").parquet(folder)


def write_files(notes: DataFrame, root: str) -> None:
    """One Markdown file per note under a folder all executors share. Each file appears under its
    name only when complete, so a task that runs twice leaves the same files."""
    def write(batches):
        import os
        import uuid
        made = set()
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["raw"]):
                target = os.path.join(root, path + ".md")
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(raw)
                os.replace(part, target)
            yield pdf[["path"]].iloc[:0]

    # Rows go to the workers in Arrow batches, dealt out where the input is small.
    spread(notes).select("path", "raw").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def project_rows(notes: DataFrame, fields: list[str], raw: str = "raw") -> DataFrame:
    """Output rows: _path, _name, revision of the raw text and the chosen fields."""
    plain = [F.col(f) if f in notes.columns else F.try_variant_get("fm", f"$['{f}']", "string").alias(f)
             for f in fields]
    return notes.select(F.col("path").alias("_path"), F.col("name").alias("_name"),
                        F.sha2(raw, 256).alias("revision"), *plain)


def project_paths(notes: DataFrame) -> DataFrame:
    return notes.select("path")
