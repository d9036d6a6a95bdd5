"""Reading Markdown notes, scanning folders and the raw structure of headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.operators.select import glob_regex
from notegrid.session import broadcast_if_small, settle
from notegrid.types import TypeSchema

READ = ("path string, name string, folder string, ext string, size bigint, mtime timestamp, "
        "header string, body string, raw string, error string")


def yaml_tools():
    """A maker of (yaml module, loader); being local it travels to the tasks by value.

    The loader keeps dates as text and knows only true/false as booleans.
    """
    def make():
        import datetime
        import re

        import yaml

        class Loader(yaml.SafeLoader):
            yaml_implicit_resolvers = {
                k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:bool",)]
                for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        Loader.add_implicit_resolver("tag:yaml.org,2002:bool",
                                     re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

        def day(loader, node):
            value = yaml.SafeLoader.construct_yaml_timestamp(loader, node)
            if getattr(value, "tzinfo", None) is not None:
                value = value.astimezone(datetime.timezone.utc)
            return value.strftime("%Y-%m-%d")

        Loader.add_constructor("tag:yaml.org,2002:timestamp", day)
        return yaml, Loader

    return make


def plain_header():
    """A reader of headers whose lines are all ``key: value`` with a quoted ASCII text without escapes, a whole number, true, false
    or null, which YAML and this read alike; anything else is None and left to YAML. Local, like ``yaml_tools``."""
    def make():
        import re
        line = re.compile(r'([A-Za-z][A-Za-z0-9_-]*): (?:"([ !#-\[\]-~]*)"|(-?[1-9][0-9]{0,17}|0)|(true)|(false)|(null))')
        words = {w for x in ("true", "false", "null") for w in (x, x.title(), x.upper())}

        def read(text):
            out = {}
            for row in text.split("\n"):
                m = line.fullmatch(row)
                if not m or m[1] in words:
                    return None
                out[m[1]] = m[2] if m[2] is not None else int(m[3]) if m[3] else True if m[4] else False if m[5] else None
            return out

        return read

    return make


def parse_notes(files: DataFrame, root: str) -> DataFrame:
    """Rows of a binary file scan as parsed notes; one Arrow batch at a time per task."""
    base = root.rstrip("/") + "/"
    rel = F.expr("substring(path, instr(path, base_) + length(base_))")
    named = files.withColumn("base_", F.lit(base)).withColumn("rel", rel) \
        .filter(~F.col("rel").rlike(r"(^|/)\."))
    return _parsed(named.select("rel", "length", "modificationTime", "content"), lambda batches: batches)


def _parsed(files: DataFrame, loaded) -> DataFrame:
    """Notes of files (rel, length, modificationTime, content); ``loaded`` turns the batches of a task into such as have the content."""
    tools, plain = yaml_tools(), plain_header()

    def parse(batches):
        import json
        import re
        yaml, loader = tools()
        simple = plain()
        head = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)
        for pdf in loaded(batches):
            out = []
            for rel, size, mtime, content in zip(pdf["rel"], pdf["length"], pdf["modificationTime"], pdf["content"]):
                raw = content.decode("utf-8", "replace")
                m, header, body, error = head.match(raw), None, raw, None
                if m:
                    body = raw[m.end():]
                    try:
                        value = simple(m[1])
                        if value is None:
                            value = yaml.load(m[1], Loader=loader)
                        if value is None:
                            value = {}
                        if isinstance(value, dict):
                            header = json.dumps({str(k): v for k, v in value.items()}, default=str)
                        else:
                            error = "header is not a mapping"
                    except Exception as e:  # the text of the problem is the result
                        error = str(e).split("\n")[0]
                stem, _, ext = rel.rpartition(".")
                folder, _, name = stem.rpartition("/")
                out.append((stem, name, folder, ext, int(size), mtime, header, body, raw, error))
            yield pd.DataFrame(out, columns=["path", "name", "folder", "ext", "size", "mtime", "header",
                                             "body", "raw", "error"])

    return files.mapInPandas(parse, READ).withColumn("fm", F.try_parse_json("header")).drop("header")


def note_type(schema: TypeSchema, fm: Column) -> Column:
    """``type`` when known, refined by a legacy ``<type>-type`` key naming a descendant."""
    stated = F.try_variant_get(fm, "$.type", "string")
    out = F.when(stated.isin(list(schema.parent)), stated)
    for t in schema.parent:
        if schema.descendants[t]:
            finer = F.try_variant_get(fm, f"$['{t}-type']", "string")
            out = F.when((stated == t) & finer.isin(schema.descendants[t]), finer).otherwise(out)
    return out


def directory_type(schema: TypeSchema, folder: Column) -> Column:
    """Type whose folder holds the note; the deepest such folder wins."""
    out = F.lit(None).cast("string")
    for t in sorted(schema.parent, key=lambda n: len(schema.output_dir[n])):
        d = schema.output_dir[t]
        out = F.when((folder == d) | F.startswith(folder, F.lit(d + "/")), t).otherwise(out)
    return out


FILES_TASK_BYTES = 32 << 20
LIST_BY_TASKS = "spark.sql.sources.parallelPartitionDiscovery.threshold"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Scan of the files below a folder. They are listed right here, two folders side by side or more by tasks: Spark would
    list up to 32 one after the other on the driver."""
    before = spark.conf.get(LIST_BY_TASKS)
    spark.conf.set(LIST_BY_TASKS, "1")
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.md") \
            .option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(LIST_BY_TASKS, before)


LISTED = "rel string, length long, modificationTime timestamp, folder boolean"
READ_BYTES, LIST_ROWS, FILES_TASK = 4 << 20, 5_000, 20_000


def _shared_folder(spark: SparkSession, root: str) -> str | None:
    """The folder as the tasks' own file system has it, if Spark would read it there; None for other stores and for patterns."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    scheme = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return path.toUri().getPath() if scheme == "file" and not any(c in root for c in "*?[]{}\\") else None


def _listing(spark: SparkSession, top: str) -> DataFrame:
    """(rel, length, modificationTime) of the notes below a folder, listed by tasks, one round per level of folders: neither files nor
    folders reach the driver. What Spark's readers pass over is passed over: hidden names, and files without a byte."""
    def scan(batches):
        import os

        def skipped(name: str) -> bool:
            return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")

        def frame(rows):
            pdf = pd.DataFrame(rows, columns=["rel", "length", "modificationTime", "folder"])
            pdf["modificationTime"] = pd.to_datetime(pdf["modificationTime"], unit="ms", utc=True)
            return pdf

        rows = []
        for batch in batches:
            for folder in batch["rel"]:
                with os.scandir(os.path.join(top, folder)) as entries:
                    for e in entries:
                        if skipped(e.name) or not (e.is_dir() or e.name.endswith(".md")):
                            continue
                        stat = e.stat()
                        if stat.st_size == 0 and not e.is_dir():
                            continue
                        rows.append((f"{folder}/{e.name}" if folder else e.name, stat.st_size, stat.st_mtime_ns // 1_000_000, e.is_dir()))
                        if len(rows) == LIST_ROWS:
                            yield frame(rows)
                            rows = []
        if rows:
            yield frame(rows)

    folders, files = spark.createDataFrame([("",)], "rel string"), None
    while True:
        found = settle(folders.mapInPandas(scan, LISTED))
        files = found.filter("NOT folder") if files is None else files.unionAll(found.filter("NOT folder"))
        folders = found.filter("folder").select("rel")
        if folders.isEmpty():
            return files.drop("folder")
        folders = folders.repartition(4 * spark.sparkContext.defaultParallelism)


def _loader(top: str):
    """Reads the files of a batch, some megabytes at a time."""
    def load(batches):
        import os
        for batch in batches:
            contents, first, size = [], 0, 0
            for i, rel in enumerate(batch["rel"]):
                with open(os.path.join(top, rel), "rb") as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= READ_BYTES or i == len(batch) - 1:
                    yield batch.iloc[first:i + 1].assign(content=contents, length=[len(c) for c in contents])
                    contents, first, size = [], i + 1, 0

    return load


def read_notes(spark: SparkSession, root: str, schema: TypeSchema | None = None) -> DataFrame:
    """All Markdown notes below a folder; hidden files and folders are left out.

    Below a folder that all machines mount, tasks list the folders and read the files, so the driver holds no list of them. In other stores
    Spark lists the files, folders beside each other by tasks. Spark packs some 30 files to a task, as it counts 4 MB for opening one;
    such packs are joined to a few tasks per core, or to 32 MB of notes where there are more.
    """
    few, top = 4 * spark.sparkContext.defaultParallelism, _shared_folder(spark, root)
    if top is not None:
        files = _listing(spark, top)
        total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
        tasks = max(few, total["size"] // FILES_TASK_BYTES, total["n"] // FILES_TASK)
        notes = _parsed(files.repartition(tasks), _loader(top))
    else:
        files = _listed(spark, root)
        size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        notes = parse_notes(files.coalesce(max(few, size // FILES_TASK_BYTES)), root)
    if schema is None:
        return notes
    return notes.withColumn("type", note_type(schema, F.col("fm"))).withColumn(
        "directory_type", directory_type(schema, F.col("folder")))


# ---------------------------------------------------------------- path scans

def exclude_paths(notes: DataFrame, prefixes: list[str]) -> DataFrame:
    """Drop notes equal to or below configured folders."""
    test = F.lit(False)
    for p in prefixes:
        test = test | (F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/"))
    return notes.filter(~test)


def ignore_rules(files: list[tuple[str, str]]) -> list[tuple[bool, str]]:
    """(negated, regex) in order of effect from (folder, ignore file text) pairs, outermost first.

    A pattern with a slash is relative to its folder, one without matches at any depth below it;
    a trailing slash means folders only.
    """
    rules = []
    for folder, text in sorted(files, key=lambda f: (f[0].count("/") + bool(f[0]), f[0])):
        base = folder + "/" if folder else ""
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            pattern = line[1:] if negated else line
            only_below = pattern.endswith("/")
            pattern = pattern.rstrip("/")
            anchored = "/" in pattern
            body = glob_regex(pattern.lstrip("/"))
            where = glob_regex(base) + ("" if anchored else "(?:.*/)?")
            rules.append((negated, f"^{where}{body}" + ("/.+$" if only_below else "(?:/.*)?$")))
    return rules


def ignore_patterns(notes: DataFrame, files: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Drop ignored notes; of the matching rules the last one decides. Rules are configuration and
    become one row-local expression."""
    ignored = F.lit(False)
    for negated, rx in ignore_rules(files):
        ignored = F.when(F.col(path).rlike(rx), F.lit(not negated)).otherwise(ignored)
    return notes.filter(~ignored)


def dedupe_paths(notes: DataFrame, key: Column | None = None) -> DataFrame:
    """One note per canonical path (``.`` and ``..`` worked out): the first in path order.

    Paths are counted first; only rows whose path is listed more than once are gathered, with a
    partial aggregate, and all others stay where they are.
    """
    from notegrid.operators.search import resolve_relative
    canonical = resolve_relative(F.lit(""), F.col("path")) if key is None else key
    rows = notes.withColumn("canonical", canonical)
    keep = [c for c in rows.columns if c != "canonical"]
    often = rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("canonical", F.lit(True).alias("often"))
    marked = rows.join(broadcast_if_small(often), "canonical", "left")
    first = (marked.filter("often").groupBy("canonical").agg(F.min_by(F.struct(*keep), F.col("path")).alias("r")).select("r.*"))
    return marked.filter("often IS NULL").select(*keep).unionByName(first)


def read_unmanaged(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Notes outside every type's folder."""
    return notes.filter(directory_type(schema, F.col("folder")).isNull())


def read_owned(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Notes living under an owner's folder: (path, owner_path, owner_type, field).

    An owner's children sit in ``<folder of owner>/<owned field>`` where the owner is the note
    named like its own folder.
    """
    owned = [(t, f) for t, fs in schema.fields.items() for f, d in fs.items() if d.get("owned")]
    dim = F.broadcast(notes.sparkSession.createDataFrame(owned, "owner_type string, field string"))
    own_folder = F.element_at(F.split("folder", "/"), -1) == F.col("name")
    owners = notes.filter(own_folder).join(dim, F.col("type") == F.col("owner_type")).select(
        F.col("path").alias("owner_path"), "owner_type", "field",
        F.concat("folder", F.lit("/"), "field").alias("folder"))
    return notes.select("path", "folder").join(owners, "folder").select(
        "path", "owner_path", "owner_type", "field")


# ---------------------------------------------------------------- raw structure

SCAN = ("struct<n_blocks int, at_top boolean, unterminated boolean, has_type boolean, error string, "
        "duplicates array<struct<key string, mergeable boolean>>, "
        "trailing array<struct<key string, line int, value string>>>")


def structural_scan(raw: Column) -> Column:
    """Header blocks of raw text: how many, where, duplicate keys, YAML errors, trailing blanks."""
    def scan(text: str, yaml, loader, rx) -> dict:
        lines = text.split("\n")
        marks = [i for i, x in enumerate(lines) if x.rstrip("\r \t") == "---"]
        blocks = list(zip(marks[::2], marks[1::2]))
        headers, first, value, error = 0, None, None, None
        for a, b in blocks:
            top = not "".join(lines[:a]).strip()
            try:
                got, problem = yaml.load("\n".join(lines[a + 1:b]), Loader=loader), None
            except Exception as e:
                got, problem = {}, str(e).split("\n")[0]
            if isinstance(got, dict) or (got is None and top):
                headers += 1
                if first is None:
                    first, value, error = (a, b, top), got or {}, problem
        duplicates, trailing = [], []
        if first:
            seen: dict[str, list[str]] = {}
            block_indent = None
            for i in range(first[0] + 1, first[1]):
                m = rx.match(lines[i])
                if block_indent is not None:
                    if not m or len(m[1]) > block_indent:
                        continue
                    block_indent = None
                if not m:
                    continue
                rest = m[3].lstrip(" \t")
                if not m[1]:
                    seen.setdefault(m[2], []).append(rest.strip())
                if rest[:1] in ("|", ">"):
                    block_indent = len(m[1])
                elif rest.strip() and not rest.startswith("#") and lines[i] != lines[i].rstrip(" \t") \
                        and m[2] != "type" and not m[2].endswith("-type"):
                    trailing.append((m[2], i + 1, rest))
            for key, values in seen.items():
                if len(values) > 1:
                    filled = {v for v in values if v not in ("", "''", '""', "[]", "null", "~")}
                    duplicates.append((key, len(filled) <= 1))
        return {"n_blocks": headers, "at_top": bool(first and first[2]), "unterminated": len(marks) % 2 == 1,
                "has_type": bool(first and value.get("type")), "error": error,
                "duplicates": duplicates, "trailing": trailing}

    tools = yaml_tools()

    @F.pandas_udf(SCAN)
    def run(raws: pd.Series) -> pd.DataFrame:
        import re
        yaml, loader = tools()
        rx = re.compile(r"^([ \t]*)([^\s:#][^:]*):(?=\s|$)(.*)$")
        return pd.DataFrame([scan(r or "", yaml, loader, rx) for r in raws])

    return run(raw)


def structural_issues(notes: DataFrame) -> DataFrame:
    """frontmatter-not-at-top, duplicate-frontmatter-keys and trailing-whitespace as issues."""
    from notegrid.operators.rules import ISSUE, issue, one
    s = F.col("s")
    rows = notes.select("path", structural_scan(F.col("raw")).alias("s"))
    away = one((s["n_blocks"] > 0) & ~s["at_top"] & s["has_type"],
               issue("frontmatter-not-at-top", "error", fix=(s["n_blocks"] == 1) & ~s["unterminated"]))
    twice = F.transform(s["duplicates"], lambda d: issue(
        "duplicate-frontmatter-keys", "error", field=d["key"], fix=d["mergeable"]))
    blanks = F.transform(s["trailing"], lambda b: issue(
        "trailing-whitespace", "warning", field=b["key"], value=b["value"], index=b["line"], fix=F.lit(True)))
    nothing = F.array().cast(f"array<{ISSUE}>")
    return rows.select("path", F.explode(F.concat(
        away, F.coalesce(twice, nothing), F.coalesce(blanks, nothing))).alias("i")).select("path", "i.*")


def fix_structure(raw: Column) -> Column:
    """Header moved to the top; of a repeated key whose values agree the filled one stays."""
    def mend(text: str, rx) -> str:
        lines = text.split("\n")
        marks = [i for i, x in enumerate(lines) if x.rstrip("\r \t") == "---"]
        if len(marks) < 2:
            return text
        a, b = marks[0], marks[1]
        header, rest = lines[a + 1:b], lines[:a] + lines[b + 1:]
        groups: list[list[str]] = []
        for line in header:
            if rx.match(line) or not groups:
                groups.append([line])
            else:
                groups[-1].append(line)
        keyed: dict[str, list[list[str]]] = {}
        for g in groups:
            m = rx.match(g[0])
            keyed.setdefault(m[1] if m else g[0], []).append(g)
        out = []
        for key, same in keyed.items():
            filled = [g for g in same if len(g) > 1 or g[0].split(":", 1)[-1].strip() not in
                      ("", "''", '""', "[]", "null", "~")]
            agree = len({"\n".join(g).strip() for g in filled}) <= 1
            for g in ([(filled or same)[0]] if agree else same):
                out += g
        moved = "".join(lines[:a]).strip() != ""
        body = "\n".join(rest).lstrip("\n") if moved else "\n".join(rest)
        return "\n".join(["---", *out, "---"]) + "\n" + body

    @F.pandas_udf("string")
    def run(raws: pd.Series) -> pd.Series:
        import re
        rx = re.compile(r"^([^\s:#][^:]*):(?=\s|$)")
        return pd.Series([mend(r or "", rx) for r in raws])

    return run(raw)
