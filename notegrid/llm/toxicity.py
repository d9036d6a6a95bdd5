"""Toxicity scores from a weighted lexicon.

Text is folded first (case, look-alike letters of other scripts, digits and signs standing for
letters), an Aho-Corasick automaton finds the terms at word starts, phrases learnt or given as
exceptions cover the terms inside them, and the sum of the weights is divided by a power of the
number of words. Lexicon, exceptions, that power and the curve from sums to scores are learnt from a
bounded sample of labelled texts.

Null and empty texts get the score of a text without any term. Repeated rows score alike. With no
toxic label at all nothing can be learnt and every score is 0.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import labelled_sample, settled

# Letters of other scripts that look like Latin ones, and the letters digits and signs stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "i"}

HIDDEN = [0xAD, 0x34F, 0x61C, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)]
WORDS = re.compile(r"[^\W\d_]+")
SIGN_RUN = re.compile(r"[0-9@$!|]+")
SPELT = re.compile(r"(?<=\s)(?:\w ){3,}\w(?=\s)")
PREFIXES = (4, 5, 6)


def _fold_table() -> dict[int, str | None]:
    """Look-alikes, and by rule every letter or digit that is only another shape of an ASCII one."""
    out: dict[int, str | None] = {ord(a): b for a, b in LOOKALIKES.items()}
    for code in (*range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            out[code] = plain
    return out | dict.fromkeys(HIDDEN)


FOLD = _fold_table()
# One class for i and l, since 1, ! and | may stand for either.
MERGE = str.maketrans({"l": "i"})
SIGNS = str.maketrans(STANDS_FOR)


def _stand_in(m: re.Match) -> str:
    """A run of digits or signs as letters: between letters, or one at the edge of a word."""
    text, a, b, run = m.string, m.start(), m.end(), m.group()
    before = a > 0 and text[a - 1].isalpha()
    after = b < len(text) and text[b].isalpha()
    if after and (before or (len(run) == 1 and run not in "!|" and not (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")))):
        return run.translate(SIGNS)
    if before and len(run) == 1 and run.isdigit() and a > 2 and text[a - 3:a].isalpha():
        return run.translate(SIGNS)
    return run


def folded_words(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = text.translate(FOLD)
    return WORDS.findall(SIGN_RUN.sub(_stand_in, text).translate(MERGE))


def canonical(text: str) -> tuple[str, int]:
    """Folded words between single spaces, words spelt letter by letter joined; and the word count."""
    words = folded_words(text)
    line = f" {' '.join(words)} "
    if SPELT.search(line):
        line = SPELT.sub(lambda m: m.group().replace(" ", ""), line)
    return line, len(words)


@dataclass
class Lexicon:
    """Terms match at word starts, or whole words when they end in a space. Exceptions are phrases."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.25
    slope: float = 0.0
    offset: float = -30.0

    def automaton(self):
        import ahocorasick
        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
        for term, weight in self.weights.items():
            out.add_word(f" {term}", (weight, len(term) + 1))
        out.make_automaton()
        return out

    def raw(self, text: str, machine) -> tuple[float, int, int]:
        """Sum of weights, number of hits and of words."""
        line, n = canonical(text)
        if not len(machine):
            return 0.0, 0, n
        covered, hits = [], []
        for end, (weight, length) in machine.iter(line):
            start = end - length + 1
            if weight:
                hits.append((start, end, weight))
            else:
                covered.append((start, end))
        if covered:  # a hit lies in an exception if one that starts no later ends no sooner
            covered.sort()
            starts, ends = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
            hits = [h for h in hits if not ((k := bisect_right(starts, h[0])) and ends[k - 1] >= h[1])]
        best: dict[int, float] = {}
        for start, _, weight in hits:  # nested terms at one word count once
            best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()), len(best), n

    def feature(self, total: float, n: int) -> float:
        return math.log1p(total / max(n, 1) ** self.power)

    def score(self, total: float, n: int) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.feature(total, n) + self.offset))))


def _terms(line: str) -> set[str]:
    words = set(line.split())
    return {w + " " for w in words if len(w) > 2} | {w[:n] for n in PREFIXES for w in words if len(w) >= n}


def _counts(rows: DataFrame, wanted: set[str] | None, pairs: bool = False) -> DataFrame:
    """How many texts hold each term (or each pair of neighbouring words around a wanted term)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                line = canonical(text or "")[0]
                if pairs:
                    words = line.split()
                    hit = [w + " " in wanted or any(w[:n] in wanted for n in PREFIXES) for w in words]
                    seen.update({f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y})
                else:
                    found = _terms(line)
                    seen.update(found if wanted is None else found & wanted)
            keys = list(seen)
            for at in range(0, len(keys), 50_000):
                part = keys[at:at + 50_000]
                yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()),
                                                  "n": pa.array([seen[k] for k in part], pa.int64())})
    return rows.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _held_terms(rows: DataFrame, wanted: set[str]) -> list[tuple[int, list[str]]]:
    """The wanted terms of each sampled text, and a word of it that its near copies are likely to share."""
    def work(batches):
        import xxhash
        for batch in batches:
            found, groups = [], []
            for text in batch.column("text").to_pylist():
                line = canonical(text or "")[0]
                found.append(sorted(_terms(line) & wanted))
                groups.append(min((xxhash.xxh64_intdigest(w) >> 1 for w in set(line.split())), default=0))
            yield pa.RecordBatch.from_pydict({"copies": pa.array(groups, pa.int64()), "terms": pa.array(found, pa.list_(pa.string()))})
    if not wanted:
        return []
    return [(r.copies, r.terms) for r in rows.mapInArrow(work, "copies long, terms array<string>").collect()]


def _chosen(weights: dict[str, float], texts: list[tuple[int, list[str]]], least: int) -> dict[str, float]:
    """Terms picked one after another, each for the sampled toxic texts that no earlier one explains.

    Texts that look like copies of one another count once, so words that many copies share do not pass
    for toxic ones. Of two terms that explain as much the shorter one is taken.
    """
    holders: dict[str, set[int]] = {t: set() for t in weights}
    for k, (_, terms) in enumerate(texts):
        for t in terms:
            holders[t].add(k)
    kept: dict[str, float] = {}
    open_ = set(range(len(texts)))
    most = 0
    while True:
        best = max(((len({texts[k][0] for k in h & open_}) * weights[t], -len(t), t) for t, h in holders.items()), default=None)
        if best is None or best[0] < least * weights[best[2]]:
            break
        term = best[2]
        kept[term] = weights[term]
        open_ -= (chosen := holders.pop(term))
        most = max(most, len({texts[k][0] for k in chosen}))
    # Terms as common as those, though some of those stand beside them everywhere in the sample.
    for term in sorted(holders, key=lambda t: (len(t), t)):
        common = 4 * len({texts[k][0] for k in holders[term]}) >= most >= 4 * least
        if common and not any(term.startswith(t) for t in kept):
            kept[term] = weights[term]
    return dict(sorted(kept.items()))


def _calibrate(lexicon: Lexicon, sums: np.ndarray, counts: np.ndarray, y: np.ndarray, share: float) -> None:
    """Choose the power of the length and fit the curve, by log loss with a small penalty on the slope."""
    best = None
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for power in (0.1, 0.25, 0.5, 1.0):
        x = np.log1p(sums / np.maximum(counts, 1) ** power)
        a, b = 1.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            g = np.array([(weight * (p - y) * x).sum() + 0.01 * a, (weight * (p - y)).sum()])
            w = weight * p * (1 - p)
            h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a - step[0], b - step[1]
        p = np.clip(1 / (1 + np.exp(-np.clip(a * x + b, -40, 40))), 1e-9, 1 - 1e-9)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, power, a, b)
    _, lexicon.power, lexicon.slope, lexicon.offset = best


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, toxic_rows: int = 4000, clean_rows: int = 8000,
          most_terms: int = 20_000, support: int = 5, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon from at most about ``toxic_rows`` toxic and ``clean_rows`` clean labelled texts."""
    toxic, clean = (settled(labelled_sample(docs, labels, "toxic", held_out, label, most).dropDuplicates(["text"]).repartition(24))
                    for label, most in ((1, toxic_rows), (0, clean_rows)))
    n1, n0 = toxic.count(), clean.count()
    if not n1:
        return Lexicon()
    least = max(min(support, n1), n1 // 200)  # more than a few copies of one text can bring about
    c1 = {r.term: r.n for r in _counts(toxic, None).filter(F.col("n") >= least)
          .orderBy(F.desc("n"), "term").limit(most_terms).collect()}
    c0 = {r.term: r.n for r in _counts(clean, set(c1)).collect()}
    weights = {}
    for term, n in c1.items():
        rate1, rate0 = (n + 0.5) / (n1 + 1), (c0.get(term, 0) + 0.5) / (n0 + 1)
        if rate1 >= 6 * rate0 and n / n1 >= 8 * c0.get(term, 0) / max(n0, 1):
            weights[term] = min(8.0, math.log(rate1 / rate0))
    kept = _chosen(weights, _held_terms(toxic, set(weights)), max(2, n1 // 400))
    lexicon = Lexicon(kept)
    if kept:
        p1 = {r.term: r.n for r in _counts(toxic, set(kept), pairs=True).filter(F.col("n") >= least)
              .orderBy(F.desc("n"), "term").limit(most_terms).collect()}
        p0 = {r.term: r.n for r in _counts(clean, set(kept), pairs=True)
              .filter(F.col("n") >= support).orderBy(F.desc("n"), "term").limit(most_terms).collect()}
        harmless = [p for p, n in p0.items() if n / max(n0, 1) >= 4 * p1.get(p, 0) / n1]
        lexicon.exceptions = sorted({*harmless, *(" ".join(folded_words(x)) for x in exceptions)} - {""})
    sums = settled(_raw(toxic.unionByName(clean), lexicon))
    pdf = sums.select("label", "total", "words").toPandas()
    _calibrate(lexicon, pdf["total"].to_numpy(float), pdf["words"].to_numpy(float),
               pdf["label"].to_numpy(float), n1 / max(n1 + n0, 1))
    return lexicon


def _raw(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    model = json.dumps(asdict(lexicon))

    def work(batches):
        lex = Lexicon(**json.loads(model))
        machine = lex.automaton()
        for batch in batches:
            found = [lex.raw(t or "", machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "label": batch.column("label"), "total": pa.array([f[0] for f in found], pa.float64()),
                "words": pa.array([f[2] for f in found], pa.int64())})
    return rows.select("text", "label").mapInArrow(work, "label int, total double, words long")


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with ``score``, ``predicted`` and the number of ``hits``; one narrow pass."""
    model = json.dumps(asdict(lexicon))
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = source.drop("_text").schema
    for name, kind in (("score", "double"), ("predicted", "integer"), ("hits", "integer")):
        schema = schema.add(name, kind)

    def work(batches):
        lex = Lexicon(**json.loads(model))
        machine = lex.automaton()
        for batch in batches:
            found = [lex.raw(t or "", machine) for t in batch.column("_text").to_pylist()]
            scores = [lex.score(f[0], f[2]) for f in found]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array([f[1] for f in found], pa.int32())], [*keep, "score", "predicted", "hits"])
    return source.mapInArrow(work, schema)
