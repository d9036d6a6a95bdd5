"""Packing texts into token sequences: large items matched in pairs, small ones best-fit into the gaps.

A text becomes the ids of a public tokenizer and one end id. Texts longer than a sequence are cut into
full pieces, the first one taking the remainder. Pieces are counted by length, and only that
histogram, one number per length, reaches the driver: it is packed there as a whole. Lengths over a
third of the capacity are large; a large item is matched with the largest other large one that fits,
at most two to a sequence. Smaller lengths go, longest first, into the tightest gap that holds them;
what is left of them fills sequences of its own. The outcome is a table of runs: for a run of pieces
of one length, the first sequence and the offset. Pieces are numbered within their length in parallel
and look their run up.

Null text counts as empty and still has the end id. Rows may repeat and ids may be null: every row is
packed for itself. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import stored

SPACES = r"\t-\r \x85\xa0"  # all there are below the rarer characters
WIDE = 500  # white space in a row


class Encoder:
    """Ids of a byte-level tokenizer file, exactly those of the library it is made for.

    In such a file an id is also the rank of the merge that makes it, which is checked; a faster
    encoder over the same ranks then gives the same ids. Texts with rarer characters, where the two may
    split words differently, texts with a special string of the file and texts with long runs of white
    space, which the faster one's word pattern cannot take, go to the library itself, and so does every
    text if the file is of another kind.
    """

    def __init__(self, path: str):
        self.path = path
        self.rare = re.compile("[^\\x00-\\u024f]")
        self.wide = re.compile(f"[{SPACES}]{{{WIDE}}}")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._fast(spec)

    @cached_property
    def library(self):
        """The library's own tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def _fast(self, spec: dict):
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges"))
        if not plain:
            return None
        import tiktoken
        # Bytes that are no printable Latin characters stand as characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        single = len(model["vocab"]) - len(merged)
        if single != 256 or any(model["vocab"][m] != single + k for k, m in enumerate(merged)):
            return None
        # Fixed value: the word pattern of byte-level tokenizers of this kind, blanks spelt out.
        words = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
        return tiktoken.Encoding("ranks of the file", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known = (self.fast is not None and (text.isascii() or not self.rare.search(text)) and not self.wide.search(text)
                 and not any(s in text for s in self.special))
        ids = self.fast.encode_ordinary(text) if known else self.library.encode(text, add_special_tokens=False).ids
        return np.array(array("I", ids), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False,
           key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) and, if asked for, the ids themselves."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.asarray([end_id], "<u4").tobytes()

    def work(batches):
        own = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column("_text")):
                data = own.encode(text.as_py() or "") + end
                if with_ids:
                    ids.append(data)
                n = len(data) // 4
                at, first = 0, n % capacity or capacity
                for p in range(-(-n // capacity)):
                    size = first if p == 0 else capacity
                    part = data[4 * at:4 * (at + size)]
                    row.append(k), piece.append(p), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    at += size
            columns = [batch.column(key).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:  # pieces of a text lie one after another in its ids
                ends = pa.array(np.cumsum([0, *length]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return docs.select(F.col(key), F.col("text").alias("_text")).mapInArrow(work, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, past the last rank, first sequence, offset) for all pieces.

    Works on whole groups of equal sequences, so its cost depends on the number of distinct lengths,
    not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[list[int], int]] = []  # lengths in order, how many sequences

    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    while large:
        top = large[-1]
        count = left[top]
        k = bisect_left(large, capacity - top + 1) - 1
        if k < 0:
            gaps[capacity - top].append(([top], count))
            left[top] = 0
        elif large[k] == top:  # only the longest length itself is left to pair with
            if count > 1:
                gaps[capacity - 2 * top].append(([top, top], count // 2))
            left[top] = count % 2
            if left[top] and k > 0:
                mate = large[k - 1]
                gaps[capacity - top - mate].append(([top, mate], 1))
                left[top], left[mate] = 0, left[mate] - 1
                if not left[mate]:
                    large.remove(mate)
            elif left[top]:
                gaps[capacity - top].append(([top], 1))
                left[top] = 0
        else:
            mate = large[k]
            m = min(count, left[mate])
            gaps[capacity - top - mate].append(([top, mate], m))
            left[top] -= m
            left[mate] -= m
            if not left[mate]:
                large.remove(mate)
        if not left[top]:
            large.remove(top)

    open_gaps = sorted(g for g, held in gaps.items() if held)
    small = sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True)
    for n in small:
        count = left[n]
        while count:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):  # no gap holds it: sequences of n alone, as full as they get
                each = min(capacity // n, count)
                m = max(1, count // each)
                gap, lengths = capacity - each * n, [n] * each
                count -= each * m
            else:
                old = open_gaps[k]
                lengths, there = gaps[old].pop()
                each = min(old // n, max(1, count // there))
                m = min(there, count // each)
                if m < there:
                    gaps[old].append((lengths, there - m))
                if not gaps[old]:
                    open_gaps.pop(k)
                gap, lengths = old - each * n, lengths + [n] * each
                count -= each * m
            if not gaps[gap] and gap:
                insort(open_gaps, gap)
            gaps[gap].append((lengths, m))
    for held in gaps.values():
        groups.extend(held)

    out, rank, sequence = [], defaultdict(int), 0
    for lengths, m in groups:
        offset = 0
        for n in lengths:
            out.append((n, rank[n], rank[n] + m, sequence, offset))
            rank[n] += m
            offset += n
        sequence += m
    return out


def pack(items: DataFrame, capacity: int = 1024, slice_rows: int = 20_000) -> DataFrame:
    """``items`` (any columns, one of them length of 1 to capacity) with sequence_id and offset."""
    spark = items.sparkSession
    held = stored(items.withColumn("_lot", F.monotonically_increasing_id()))
    counted = held.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row per length at most
    histogram = {r.length: r.n for r in counted}
    if any(n > capacity or n < 1 for n in histogram):
        raise ValueError("length outside 1 to capacity")
    total = sum(histogram.values())
    # Numbers within a length: within lots first, and lots one after another. Lots are as many as the rows need.
    lots = max(16, -(-total // slice_rows))
    lot = F.pmod(F.xxhash64("_lot"), F.lit(lots))
    held = held.withColumn("_slice", lot)
    per = held.groupBy("length", "_slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select("length", "_slice", (F.sum("n").over(before) - F.col("n")).alias("_before"))
    within = Window.partitionBy("length", "_slice").orderBy("_lot")
    ranked = (held.withColumn("_rank", F.row_number().over(within) - 1).join(per, ["length", "_slice"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    # As an Arrow table: rows of Python objects would start a second set of Python workers on every executor.
    kinds = {"r_length": pa.int32(), "first": pa.int64(), "past": pa.int64(), "base": pa.int64(), "offset": pa.int64()}
    of_plan = np.array(plan(histogram, capacity), np.int64).reshape(-1, len(kinds))
    runs = spark.createDataFrame(pa.table({c: pa.array(of_plan[:, k], kind) for k, (c, kind) in enumerate(kinds.items())}))
    # One row per run, fewer than a few per pair of lengths whatever the number of rows: a bounded broadcast.
    per_length = runs.groupBy("r_length").agg(F.sort_array(F.collect_list(F.struct("first", "past", "base", "offset"))).alias("runs"))
    ranked = ranked.join(F.broadcast(per_length), F.expr("length = r_length"))
    run = F.expr("filter(runs, r -> _rank >= r.first AND _rank < r.past)[0]")
    return (ranked.withColumn("_run", run)
            .select(*items.columns, (F.col("_run.base") + F.col("_rank") - F.col("_run.first")).alias("sequence_id"),
                    F.col("_run.offset").alias("offset")))
