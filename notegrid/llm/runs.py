"""Periodic runs of words, found through Lyndon roots, and texts with the repeats taken out.

A run is a stretch of words of smallest period q that no neighbouring word extends. Those with a length
of at least ``least`` words and ``times`` periods count. Documents are worked off one by one inside
Arrow batches; nothing is shuffled.

1. Words become numbers. A run of four periods or more holds every four words of it twice, so only
   stretches of words whose every four-word window occurs again in the text can hold runs; the others
   are set aside. Stretches are put one after another with walls between them.
2. ``lyndon_lengths`` sorts the suffixes into groups by the first phase of Baier's suffix sorter: groups
   are taken from the highest to the lowest; each member looks up the nearest position to its left that
   is still open, and those positions move to new groups right above their own, whose common prefix
   grows by that of the group just taken. The length of that prefix, when a group is taken, is the
   longest Lyndon word at each of its members. This is done under both orders of the words.
3. Every run has a Lyndon root under one of the two orders that starts in its first period. Roots are
   extended to both sides by longest common extensions, compared in blocks of doubling size; roots inside
   a run already found with their period are passed over, so a run is extended once.

Null text is empty: no words, no runs. Very long texts cost time and memory in proportion to their
words. Rows are treated each for itself, so ids may be null or repeated; an empty table gives no rows,
and other columns of the input, whatever their names, have no influence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.text_arrays import texts

WINDOW = 4


def lyndon_lengths(symbols: list[int], falling: bool = False) -> list[int]:
    """Length of the longest Lyndon word at each place; negative symbols are walls, lower than all.

    ``falling`` turns the order of the symbols round. Walls have length 0.
    """
    size = len(symbols)
    held: dict[int, list[int]] = {}
    for place, symbol in enumerate(symbols, 1):  # place 0 is a wall before the text
        if symbol >= 0:
            held.setdefault(symbol, []).append(place)
    order = sorted(held, reverse=falling)
    members = [held[symbol] for symbol in order]
    prefix = [1] * len(order)
    above, below = [k + 1 for k in range(len(order))], [k - 1 for k in range(len(order))]
    group = [-1] * (size + 1)
    for k, places in enumerate(members):
        for place in places:
            group[place] = k
    open_at = list(range(size + 1))  # itself while open, else some place to the left
    found = [0] * (size + 1)
    top = len(order) - 1
    if order:
        above[top] = -1
    while top >= 0:
        here = [place for place in members[top] if group[place] == top]
        members[top] = []
        reach = prefix[top]
        for place in here:
            found[place] = reach
            open_at[place] = place - 1
        hits: dict[int, int] = {}
        for place in here:
            left = place - 1
            while open_at[left] != left:
                open_at[left] = open_at[open_at[left]]
                left = open_at[left]
            open_at[place] = left
            if group[left] >= 0:
                hits[left] = hits.get(left, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for left, count in hits.items():
            moved.setdefault((count, group[left]), []).append(left)
        for count, old in sorted(moved, reverse=True):
            new = len(members)
            members.append(moved[count, old])
            for left in members[new]:
                group[left] = new
            prefix.append(prefix[old] + count * reach)
            over = above[old]
            above.append(over), below.append(old)
            above[old] = new
            if over >= 0:
                below[over] = new
        top = below[top]
    return found[1:]


def _common(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j on are equal; i < j."""
    done, step = 0, 16
    while j + done < len(words):
        n = min(step, len(words) - j - done)
        differ = np.flatnonzero(words[i + done:i + done + n] != words[j + done:j + done + n])
        if len(differ):
            return done + int(differ[0])
        done, step = done + n, step * 2
    return done


def _common_before(words: np.ndarray, i: int, j: int) -> int:
    """How many words before i and before j are equal; i < j."""
    done, step = 0, 16
    while i - done > 0:
        n = min(step, i - done)
        differ = np.flatnonzero(words[i - done - n:i - done] != words[j - done - n:j - done])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, step = done + n, step * 2
    return done


def _stretches(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches whose four-word windows all occur more than once in ``words``."""
    if len(words) < max(least, WINDOW + 1):
        return []
    ranks = words
    for reach in (1, 2):  # ranks of two-word windows, then of four-word ones
        _, ranks, count = np.unique(ranks[:-reach] * (int(ranks.max()) + 1) + ranks[reach:], return_inverse=True, return_counts=True)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], count[ranks] > 1, [False])).view(np.int8)))
    return [(a, b + WINDOW - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least - WINDOW + 1]


def find_runs(words: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``words``: numbers from 0."""
    if times < 4 or least < WINDOW + 2:
        raise ValueError("runs of fewer than four periods or six words are not found through repeated windows")
    parts = _stretches(words, least)
    if not parts:
        return []
    joined, origin = [], []
    for k, (a, b) in enumerate(parts):
        joined += [words[a:b], np.array([-1 - k], np.int64)]
        origin += [np.arange(a, b), np.array([-1])]
    line, origin = np.concatenate(joined), np.concatenate(origin)
    symbols = line.tolist()
    roots = np.array([lyndon_lengths(symbols), lyndon_lengths(symbols, falling=True)], np.int64).T.ravel()
    place = np.repeat(np.arange(len(line)), 2)
    # A root that starts in the first of four periods has two more of its kind to its right.
    may = (roots > 0) & (place + 3 * roots <= len(line))
    place, roots = place[may], roots[may]
    for turns, back in ((0, 0), (1, 1), (2, 1)):  # first words, last words, and those one period on
        at = place + turns * roots - back
        same = line[at] == line[at + roots]
        place, roots = place[same], roots[same]
    out, last = [], {}
    for i, q in zip(place.tolist(), roots.tolist()):
        start, end = last.get(q, (0, 0))
        if start <= i and i + q <= end:
            continue
        right = _common(line, i, i + q)
        if right < 2 * q:
            continue
        start, end = i - _common_before(line, i, i + q), i + q + right
        last[q] = start, end
        if end - start >= max(least, times * q):
            out.append((int(origin[start]), end - start, q))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _number(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4,
                  with_text: bool = False) -> DataFrame:
    """One row per document: its runs, the longest of them and the text without repeats.

    Columns: key, n_runs, runs array<struct<start, length, period>>, the longest run's start, length, period and
    exponent_milli (null without one; ties go to the smallest start, then period), runs_sha256 of the
    lines ``start,length,period`` and collapsed_sha256 of the kept words joined by one blank;
    ``with_text`` adds collapsed, those words themselves.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = (f"`{key}` {kind}, n_runs long, runs array<struct<start:long,length:long,period:long>>, start long, length long, "
              "period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + (", collapsed string" if with_text else ""))

    def work(batches):
        for batch in batches:
            runs_of, best, lines, kept, whole = [], [], [], [], []
            for data in texts(batch.column("_text")):
                words = data.tobytes().split()  # cuts at the six white-space bytes of ASCII
                runs = find_runs(_number(words), least, times)
                left = b" ".join(collapse(words, runs))
                runs_of.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                best.append(min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None))
                lines.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                kept.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    whole.append(left.decode())
            start, length, period = ([b[k] for b in best] for k in range(3))
            milli = [None if q is None else 1000 * n // q for _, n, q in best]
            columns = [batch.column(0), pa.array([len(r) for r in runs_of], pa.int64()), pa.array(runs_of, pa.list_(run)),
                       *(pa.array(c, pa.int64()) for c in (start, length, period, milli)), pa.array(lines, pa.string()), pa.array(kept, pa.string())]
            names = [key, "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_text:
                columns.append(pa.array(whole, pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names)
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(work, schema)
