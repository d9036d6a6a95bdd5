import random

import public_tokenizers
import pytest

from notegrid.llm import queries
from notegrid.llm.token_counts import Counter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["a", "the", "Étion", "日本語", "▁", "x▁y", " ", "  ", "\n", "\t", "\r\n", " ", "😀", "<s>", "</s>", "<unk>", "<|endoftext|>", "1234", "\x00", "’s", "'s", "()", "…"]


def whole(path, text):
    if path == MODEL:
        from sentencepiece import SentencePieceProcessor
        return len(SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer
    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_pieces_add_up_to_the_whole_text(path):
    rng, own = random.Random(6), Counter(path)
    assert own.cut is not None
    cut = 0
    for _ in range(400):
        text = rng.choice(["", " ", "\n"]).join(rng.choice(WORDS) + rng.choice(["", " ", "  ", "b c d"]) for _ in range(rng.randrange(25)))
        parts = list(own.pieces(text, 5))
        cut += len(parts) > 1
        assert sum(own.lengths(parts)) == own.lengths([text])[0], text
    assert cut > 100


def test_lengths_are_those_of_the_library():
    for path in (MODEL, JSON):
        own = Counter(path)
        for text in ["", " ", " a", "a ", "Étion dans <s>", "a\x00b", "<|endoftext|>"]:
            assert own.lengths([text])[0] == whole(path, text)


def test_nulls_empties_long_texts_and_repeats(spark):
    long = "Étion dans, çouelle un éonierç " * 20_000
    blanks = " " * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, long, "x"), (5, blanks, "x"), (6, "z" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(1)
    want = sorted(((k, len((t or "").encode()), n := whole(MODEL, t or ""), n > 4096) for k, t, _ in rows), key=repr)
    for call, piece in ((1 << 20, 1 << 16), (1, 1), (100, 7_000)):
        got = token_counts(docs, MODEL, 4096, call_bytes=call, piece_chars=piece)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts(docs.filter("doc_id > 9"), MODEL).collect() == []


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    from sentencepiece import SentencePieceProcessor
    own = SentencePieceProcessor(model_file=MODEL)
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n = len(own.encode(text or ""))
        assert got[doc_id] == (len((text or "").encode()), n, n > 4096)
