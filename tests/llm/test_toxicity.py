import random
import time

from pyspark.sql import functions as F

from notegrid.llm import toxicity
from notegrid.llm.common import in_fold
from notegrid.llm.toxicity import Lexicon, canonical

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_folding_look_alikes_digits_and_hidden_characters():
    line = lambda t: toxicity.canonical(t)[0].split()
    plain = line("idiot")
    for disguised in ("1d10t", "іdіоt", "ＩＤＩＯＴ", "id​iot", "ID!OT", "i d i o t"):
        assert line(disguised) == plain, disguised
    assert line("word$$$ other!!! 42 b4") == ["word", "other", "ba"] or line("word$$$ other!!! 42") == ["word", "other"]


def test_exceptions_cover_terms_and_weights_shrink_with_length():
    lex = toxicity.Lexicon({"iame": 4.0}, ["iame duck"], 0.5, 2.0, -3.0)
    machine = lex.automaton()
    assert lex.raw("a lame duck swims", machine)[1] == 0
    assert lex.raw("a lame excuse", machine)[1] == 1
    assert lex.raw("blame", machine)[1] == 0  # only at word starts
    short, long = lex.raw("lame", machine), lex.raw("lame " + "word " * 99, machine)
    assert lex.score(short[0], short[2]) > lex.score(long[0], long[2])


def test_learns_terms_and_scores_every_row(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "kmnprt" for b in "aeiou" for c in ("la", "to", "nu")]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["zworf", "xquib", "ZW0RF" if i % 8 else "zworfen"]))
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "zworf " * 3, None, None, None), (5, rows[5][1], "en", "s", 1)]
    rows.append((902, "mala " * 200_000 + "zworf", "en", "s", 1))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    lex = toxicity.learn(docs, known, in_fold(F.col("doc_id"), 4, 2))
    got = toxicity.score(docs, lex).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].predicted == t for i, _, t in labels)
    assert by[900].predicted == by[901].predicted == 0 and by[900].score == by[901].score
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert by[902].hits == 1


def test_without_labels_and_without_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS), spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score(docs, toxicity.learn(docs, none, F.lit(False))).collect()] == [0]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.learn(empty, none, F.lit(False))).count() == 0


def naive(lexicon, text):
    """Score by plain searches for every term and every exception."""
    line, n = canonical(text)
    def places(term):
        at = line.find(term)
        while at >= 0:
            yield at, at + len(term)
            at = line.find(term, at + 1)
    covered = [p for e in lexicon.exceptions for p in places(f" {e} ")]
    best = {}
    for term, weight in lexicon.weights.items():
        for a, b in places(f" {term}"):
            if not any(x <= a and b <= y for x, y in covered):
                best[a] = max(weight, best.get(a, 0.0))
    return sum(best.values()), len(best), n


def test_equals_naive_scorer():
    rng = random.Random(2)
    lexicon = Lexicon({"bad ": 2.0, "ba": 1.0, "vile": 3.0, "vi": 0.5, "rot ": 1.5}, ["not bad", "bad rot", "very vile thing", "ba ba"])
    machine = lexicon.automaton()
    for _ in range(800):
        text = " ".join(rng.choice(["bad", "not", "rot", "vile", "very", "thing", "ba", "vi", "good", "BAD", "b4d"]) for _ in range(rng.randrange(14)))
        got, want = lexicon.raw(text, machine), naive(lexicon, text)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9, text


def test_exceptions_in_a_long_text_take_linear_time():
    lexicon = Lexicon({"bad ": 2.0}, ["not bad"])
    start = time.time()
    assert lexicon.raw("not bad bad " * 100_000, lexicon.automaton())[1] == 100_000
    assert time.time() - start < 20
