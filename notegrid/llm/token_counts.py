"""Token counts of whole texts: batches of even size in bytes, long texts cut where no token can reach across.

Only lengths leave the Python worker, never ids. Rows of an Arrow batch are encoded in calls of about
``call_bytes`` each. A text longer than ``piece_chars`` is cut at the next safe place, one that no
token of the vocabulary can span, so the counts of the pieces add up to that of the text:

* A .model file is safe at a single blank between two other characters if it keeps blanks as they
  are, puts one before every text (which stands for the blank cut away) and has no piece with a blank
  after another character. All three are looked up when the file is loaded.
* A .json file is safe before a blank between two ASCII letters if it is a byte-level one that cuts
  words by its pattern and neither normalizes nor adds a blank.

Other files, and texts without such a place, are encoded whole. Null text counts as empty: 0 bytes and
0 tokens. Repeated rows are counted each for itself, ids may be null, an empty table gives no rows, and
columns of the input that bear the names of the result do not disturb it.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"  # Fixed value: how pieces of a .model file write a blank


class Counter:
    """Numbers of tokens by the library that a tokenizer file is made for."""

    def __init__(self, path: str):
        self.cut: re.Pattern | None = None
        self.drops_blank = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor
            own = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in own.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
            whole = any(re.search(f"[^{BLANK}]{BLANK}", own.id_to_piece(i)) for i in range(own.get_piece_size()))
            kept = own.decode(own.encode("a  b ")) == "a  b " and own.encode_as_pieces("a")[0].startswith(BLANK)
            if kept and not whole:
                self.cut, self.drops_blank = re.compile(f"(?<=[^ {BLANK}]) (?=[^ {BLANK}])"), True
        else:
            from tokenizers import Tokenizer
            file = Tokenizer.from_file(path)
            file.no_truncation()
            file.no_padding()
            self.lengths = lambda texts: [len(e.ids) for e in file.encode_batch(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            before = spec.get("pre_tokenizer") or {}
            if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer"):
                self.cut = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

    def pieces(self, text: str, most: int):
        """Parts of ``text`` of about ``most`` characters whose counts add up to its own."""
        at = 0
        while self.cut is not None and len(text) - at > most:
            place = self.cut.search(text, at + most)
            if place is None:
                break
            yield text[at:place.start()]
            at = place.end() if self.drops_blank else place.start()
        yield text[at:]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One tokenizer per Python worker serves all its tasks; another file takes its place."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, key: str = "doc_id", text: str = "text",
                 call_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; narrow, one pass."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"

    def work(batches):
        own = counter(tokenizer)
        for batch in batches:
            column = batch.column("_text")
            size, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            rows: list[int] = []
            held: list[str] = []
            weight = 0

            def flush():
                np.add.at(total, rows, own.lengths(held))
                rows.clear(), held.clear()
            for i, value in enumerate(column):
                data = value.as_py() or ""
                size[i] = len(data.encode())
                for part in own.pieces(data, piece_chars):
                    rows.append(i), held.append(part)
                    weight += len(part.encode())
                    if weight >= call_bytes:
                        flush()
                        weight = 0
            if held:
                flush()
                weight = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total), pa.array(total > limit)],
                                             [key, "n_bytes", "n_tokens", "over_limit"])
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(work, schema)
