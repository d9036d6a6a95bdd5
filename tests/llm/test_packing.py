import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from notegrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world", "it's don't WE'LL  two  spaces\n\n\tx  ", "é ü ñ ß Ærø 123 456abc", "<|endoftext|> x", "日本語 テスト", "a b c", " lead", "x\x1cy\x1fz",
         "\x85q", "$$$ ### word!!! | pipe", "ab" * 3000, "word " * 5000, "😀 ok", "naïve\r\nline", "a   b", "a  b", "a    ", "x \n y", "x  \ny", " ", "  ", "   ", "\n word", "w \n\n\tx 's 't", "a \t b", "é  ü",
         "end ", " \n", "a\u00a0 b", "\u0085 x"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(text):
    encoder = packing.Encoder(PATH)
    want = np.asarray(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text) == want and encoder.encode(text) == want


def test_ids_of_random_texts_equal_the_library():
    rng = random.Random(8)
    encoder = packing.Encoder(PATH)
    assert encoder.fast is not None
    for _ in range(1500):
        text = "".join(rng.choice(["a", "B", "'s", "é", " ", " ", "\n", "\t", "1", ",", "!!", "\u00a0", "\x1c", "\x85"]) for _ in range(rng.randrange(14)))
        want = np.asarray(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, text


def check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packs_every_piece_gapless(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gam", "d"]) for _ in range(int(rng.expovariate(1 / 300)))) for _ in range(400)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, None), (7, texts[7], None), (500, "word " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    items = packing.pieces(docs, PATH, with_ids=True)
    got = packing.pack(items, 1024, slice_rows=50).collect()
    n = check(got, 1024)
    total = sum(r.length for r in got)
    assert n <= -(-total // 1024) * 1.03 + 1
    library = packing.Encoder(PATH).library
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts[:50]):
        if i == 7:
            continue
        want = library.encode(t, add_special_tokens=False).ids + [2]
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == want
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
        assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in mine)
        assert all(r.length == 1024 for r in mine[1:])
    assert [tuple(r.ids) for r in by[None]] == [(2,)] and len(by[7]) % 2 == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    lengths = [min(100, 1 + int(rng.expovariate(1 / rng.choice([8, 30, 60])))) for _ in range(500)]
    runs = packing.plan(Counter(lengths), 100)
    seen, fill = Counter(), Counter()
    for n, first, past, base, offset in runs:
        seen[n] += past - first
        for k in range(past - first):
            fill[base + k] += n
    assert seen == Counter(lengths) and max(fill.values()) <= 100
    large = sum(n > 50 for n in lengths)
    assert len(fill) <= max(large, -(-sum(lengths) // 100)) * 1.08 + 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 300_000 + "x", "a" + "\n" * 300_000, " \n\u00a0" * 100_000 + "b c", "x " * 400 + " " * 499 + "y"],
                         ids=["blanks", "tabs", "lines", "mixed", "short"])
def test_long_white_space(text):
    encoder = packing.Encoder(PATH)
    assert encoder.encode(text) == np.asarray(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_planning_starts_no_python_workers(spark):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(20)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, PATH, with_ids=True), 1024)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()  # the runs come as Arrow, not as pickled rows
    assert packed.count() == 20


def test_batches_of_a_stage_stay_small(spark, tmp_path):
    from notegrid.llm.common import table
    (spark.range(600).selectExpr("id AS doc_id", "repeat(sha2(string(id), 512), 80) AS text").coalesce(1)
     .write.parquet(f"{tmp_path}/documents.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})
    held = [r.n for r in table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(held) > 6_000_000 and max(held) < 3_000_000
