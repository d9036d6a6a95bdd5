import random

import numpy as np
from pyspark.sql import functions as F

from notegrid.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "kmnprt" for b in "aeiou" for c in ("la", "to", "nu")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        good = i % 3 > 0
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 2 else [text[0]] * len(text)
        rows.append((i, " ".join(text) + ".", "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_votes_match_labels_and_odd_rows_are_scored(spark):
    rows, labels = corpus(240)
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (None, rows[1][1], None, None, None), (7, rows[7][1], "en", "s", 1),
           (902, (rows[1][1] + " ") * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    model = quality.learn(docs, spark.createDataFrame(labels, LABELS), F.col("doc_id") % 5 == 0, rows=150)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].predicted == q for i, q, _ in labels)
    assert by[900].score == by[901].score == model.share


def test_blocked_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    model = quality.Model(np.ones(quality.WIDTH, np.float32), rng.normal(size=(quality.WIDTH, 8)).astype(np.float32), np.zeros((0, 8)), np.zeros(0), 0.5)
    model.vectors = model.project(rng.random((50, quality.WIDTH)).astype(np.float32))
    model.labels = rng.integers(0, 2, 50).astype(float)
    terms = rng.random((9, quality.WIDTH)).astype(np.float32)
    got = model.vote(terms, 7, 12.0)
    for t, g in zip(terms, got):
        v = model.project(t[None])[0]
        cosine = model.vectors.astype(float) @ v
        near = np.argsort(-cosine)[:7]
        w = np.exp(12 * (cosine[near] - cosine.max())) * np.maximum(cosine[near], 0)
        assert abs(g - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in quality.score(docs, quality.learn(docs, none, F.lit(False))).collect()] == [1]
    assert quality.score(docs.limit(0), quality.learn(docs, none, F.lit(False))).count() == 0
