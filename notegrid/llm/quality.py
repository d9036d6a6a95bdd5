"""Quality scores by votes of the nearest labelled texts in a latent-semantic space.

A text becomes counts of terms: three-character patterns of its character classes with runs folded,
pairs of bytes, and how often words and word pairs repeat. Counts are damped, weighted by inverse
document frequency, and projected on the leading singular vectors of a bounded labelled sample. The
vectors of that sample are broadcast; every text takes exact cosine products with all of them, in
blocks, and its nearest ones vote, each with a weight that grows with its similarity.

Null and empty texts have no terms and get the sample's share of good texts. Without any labelled
row every score is 1, so nothing is rejected. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import labelled_sample, settled
from notegrid.llm.text_arrays import pair_hashes, texts, word_hashes

CLASSES = 16
SHAPES = CLASSES ** 3
PAIRS = 512
REPEATS = 3
WIDTH = SHAPES + PAIRS + REPEATS


def _classes() -> np.ndarray:
    """Letters, capitals, digits, blanks, line ends and the commoner signs; other signs share the rest."""
    out = np.full(256, 15, np.uint8)
    out[97:123] = 1
    out[128:] = 1
    out[65:91] = 2
    out[48:58] = 3
    out[[32, 9]] = 4
    out[[10, 11, 12, 13]] = 5
    for k, signs in enumerate((".", ",;:", "!?", "|", "$%&*#", "'\"-", "()[]{}<>"), 6):
        out[[ord(s) for s in signs]] = k
    return out


CLASS = _classes()


def term_vector(text: np.ndarray) -> np.ndarray:
    """Damped term weights: each of the three groups of terms has length one if it is not empty."""
    out = np.zeros(WIDTH, np.float32)
    if not len(text):
        return out
    shape = CLASS[text]
    shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].astype(np.int64)
    shape = np.concatenate(([0], shape, [0]))
    code = (shape[:-2] * CLASSES + shape[1:-1]) * CLASSES + shape[2:]
    out[:SHAPES] = np.sqrt(np.bincount(code, minlength=SHAPES) / len(code))
    if len(text) > 1:
        two = (text[:-1].astype(np.int64) * 31 + text[1:]) % PAIRS
        out[SHAPES:SHAPES + PAIRS] = np.sqrt(np.bincount(two, minlength=PAIRS) / len(two))
    words = word_hashes(text)
    if len(words) > 1:
        same = (words[1:] == words[:-1]).mean()
        again = 1 - len(pair_hashes(words)) / (len(words) - 1)
        out[-REPEATS:] = [np.sqrt(same), np.sqrt(again), 0.25]
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.idf) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def vote(self, terms: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """Exact cosine products of a block of texts with all labelled vectors, then weighted votes."""
        if not len(self.labels):
            return np.full(len(terms), self.share)
        close = self.project(terms) @ self.vectors.T
        k = min(neighbours, close.shape[1])
        near = np.argpartition(-close, k - 1, axis=1)[:, :k] if k < close.shape[1] else np.arange(k)[None].repeat(len(close), 0)
        cosine = np.take_along_axis(close, near, 1).astype(np.float64)
        weight = np.exp(sharpness * (cosine - cosine.max(1, keepdims=True))) * np.maximum(cosine, 0)
        total = weight.sum(1)
        empty = (terms == 0).all(1) | (total <= 0)
        return np.where(empty, self.share, (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1))


def _sparse_terms(rows: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            where, what = [], []
            for text in texts(batch.column("text")):
                v = term_vector(text)
                at = np.flatnonzero(v)
                where.append(at.astype(np.int32).tobytes())
                what.append(v[at].tobytes())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "i": pa.array(where, pa.binary()),
                                              "v": pa.array(what, pa.binary())})
    return rows.mapInArrow(work, "label int, i binary, v binary")


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = 3000, axes: int = 48) -> Model:
    """Fit on at most about ``rows`` labelled texts, both labels in proportion to their numbers.

    The sparse term vectors of that bounded sample are all that reaches the driver.
    """
    fit = labels.filter(F.col("doc_id").isNotNull() & ~held_out)
    n = {r.quality: r.n for r in fit.groupBy("quality").agg(F.count("*").alias("n")).collect() if r.quality in (0, 1)}
    if not sum(n.values()):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 1.0)
    parts = [labelled_sample(docs, labels, "quality", held_out, value, max(1, round(rows * n[value] / sum(n.values()))))
             for value in sorted(n)]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pdf = settled(_sparse_terms(found)).toPandas()
    if not len(pdf):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 1.0)
    terms = np.zeros((len(pdf), WIDTH), np.float32)
    for k, (i, v) in enumerate(zip(pdf["i"], pdf["v"])):
        terms[k, np.frombuffer(i, np.int32)] = np.frombuffer(v, np.float32)
    y = pdf["label"].to_numpy(float)
    order = np.lexsort((*terms[:, :6].T, y))  # the result does not depend on the order rows arrive in
    terms, y = terms[order], y[order]
    idf = np.log1p(len(terms) / (1 + (terms > 0).sum(0))).astype(np.float32)
    idf[-REPEATS:] = 3.0  # repeats are rates, not terms that are there or not
    weighted = terms * idf
    live = np.flatnonzero(weighted.any(0))
    gram = weighted[:, live].T @ weighted[:, live]
    _, vectors = np.linalg.eigh(gram.astype(np.float64))
    basis = np.zeros((WIDTH, min(axes, len(live))), np.float32)
    basis[live] = vectors[:, ::-1][:, :basis.shape[1]]
    model = Model(idf, basis, np.zeros((0, 1), np.float32), y, float(y.mean()))
    model.vectors = model.project(terms).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5, neighbours: int = 15, sharpness: float = 12.0,
          keep: tuple[str, ...] = ("doc_id",), block: int = 256) -> DataFrame:
    """``keep`` columns of every row with ``score`` and ``predicted``; one narrow pass over whole texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = source.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def work(batches):
        m = shared.value
        for batch in batches:
            scores, held = [], []
            for text in texts(batch.column("_text")):
                held.append(term_vector(text))
                if len(held) == block:
                    scores.append(m.vote(np.stack(held), neighbours, sharpness))
                    held = []
            if held:
                scores.append(m.vote(np.stack(held), neighbours, sharpness))
            s = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(s, pa.float64()),
                 pa.array((s >= threshold).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])
    return source.mapInArrow(work, schema)
