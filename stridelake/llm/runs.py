"""Periodic runs of words, found through Lyndon roots, and texts with the repetitions taken out.

Every run (maximal repetition) has a Lyndon root under one of two opposite orders of the words, and
that root is the longest Lyndon word that starts at its position (Bannai et al., the runs theorem).
Phase one of Baier's suffix sorter groups positions by exactly these words: groups are visited from
the highest down, and each position extends the nearest position to its left that is in a lower
group by its own word. The lengths of the groups' words are the Lyndon array, so no suffix array is
built. It is done under both orders; each root (i, i + p) is extended to both sides by longest
common extensions, and extensions of at least ``max(min_length, 2 p)`` words are the runs.

Extensions use exact names of blocks of 1, 2, 4, ... words. Words outside every repeated
``min_length / 2``-gram lie in no run of that length (a run repeats at least that many words at the
distance of its period, and the repeated windows cover it), so only the stretches of covered words
are grouped. Hashes merely find these stretches: equal grams have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; ``word`` holds ranks 0..k-1.

    Baier's first phase: a group is a list of positions with a common word, groups are linked in
    their order. Visited positions leave a union-find forest, whose root left of a position is the
    nearest one in a lower group. Positions that are extended by the same word equally often move
    together into a new group right above their old one, the most often extended ones on top.
    """
    n, k = len(word), max(word, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, c in enumerate(word):
        members[c].append(i)
    group, size = list(word), [1] * k
    above, below = [*range(1, k), -1], list(range(-1, k - 1))
    left = list(range(n + 1))  # of position i - 1 at i; 0 is "none"
    out, g = [1] * n, k - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        length = size[g]
        for i in here:
            left[i + 1] = i
            out[i] = length
        times: dict[int, int] = {}
        for i in here:
            x = i
            while left[x] != x:
                left[x] = left[left[x]]
                x = left[x]
            if x:
                times[x - 1] = times.get(x - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, m in times.items():
            moves.setdefault((m, group[j]), []).append(j)
        for m, old in sorted(moves, reverse=True):
            new, up = len(size), above[old]
            size.append(size[old] + m * length)
            above.append(up)
            below.append(old)
            above[old] = below[up] = new
            members.append(moves[m, old])
            for j in moves[m, old]:
                group[j] = new
        members[g] = []
        g = below[g]
    return out


class Extensions:
    """Longest common extensions in a sequence, by exact names of its blocks of 2^k symbols."""

    def __init__(self, word: np.ndarray, longest: int):
        self.n = len(word)
        self.names = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.names) <= longest:
            half, last = 2 ** (len(self.names) - 1), self.names[-1]
            if self.n < 2 * half:
                break
            a, b = last[: self.n - 2 * half + 1], last[half : self.n - half + 1]
            values, names = np.unique(a * self.n + b, return_inverse=True)
            if len(values) == len(names):  # all differ: longer blocks do, too
                break
            self.names.append(names.astype(np.int64))

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common length of what starts at x and y (x < y)."""
        x, y = x.copy(), y.copy()
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            while True:  # the top level may match more than once
                fits = y + step <= self.n
                same = fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)])
                if not same.any():
                    break
                x[same] += step
                y[same] += step
                done[same] += step
                if k < len(self.names) - 1:
                    break
        return done

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common length of what ends before x and y (x < y)."""
        x, y = x.copy(), y.copy()
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            while True:
                fits = x >= step
                same = fits & (names[np.where(fits, x - step, 0)] == names[np.where(fits, y - step, 0)])
                if not same.any():
                    break
                x[same] -= step
                y[same] -= step
                done[same] += step
                if k < len(self.names) - 1:
                    break
        return done


def repeated_stretches(word: np.ndarray, ends: np.ndarray, gram: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` symbols, each inside a gram that its text repeats.

    ``ends`` are the ends of the texts in ``word``.
    """
    n = len(word)
    if n < 2 * gram:
        return []
    text = np.searchsorted(ends, np.arange(n), side="right")
    odd = np.random.default_rng(7).integers(0, 2**63, gram + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    w = word.astype(np.uint64)
    h = text[: n - gram + 1].astype(np.uint64) * odd[gram]
    for j in range(gram):
        h += w[j : n - gram + 1 + j] * odd[j]
    inside = np.flatnonzero(text[: n - gram + 1] == text[gram - 1 :])
    h = h[inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, inside[again], 1)
    np.add.at(change, inside[again] + gram, -1)
    covered = np.cumsum(change[:n]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    found = []
    for a, b in edge.reshape(-1, 2).tolist():
        cuts = [a, *[int(e) for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")]], b]
        found += [(x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= least]
    return found


def find_runs(word: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in the texts of ``word``, by start, then period."""
    parts = repeated_stretches(word, ends, (min_length + 1) // 2, max(min_length, 2))
    if not parts:
        return np.zeros((0, 3), np.int64)
    symbols, origin, period, at, total = [], [], [], [], 0
    for a, b in parts:
        values, rank = np.unique(word[a:b], return_inverse=True)
        for order in (rank, len(values) - 1 - rank):
            at.append(np.arange(total, total + b - a))
            period.append(np.array(lyndon_array(order.tolist()), np.int64))
        symbols += [word[a:b], np.array([-1 - len(symbols)])]  # a separator of its own behind each stretch
        origin += [np.arange(a, b), np.array([b])]
        total += b - a + 1
    i, p = np.concatenate(at), np.concatenate(period)
    flat, origin = np.concatenate(symbols), np.concatenate(origin)
    before, last = np.maximum(i - 1, 0), total - 1
    hopeful = (flat[i] == flat[np.minimum(i + p, last)]) | (flat[before] == flat[np.minimum(before + p, last)])
    i, p = i[hopeful], p[hopeful]
    lce = Extensions(flat, max(b - a for a, b in parts))
    back = lce.left(i, i + p)
    length = back + p + lce.right(i, i + p)
    good = length >= np.maximum(min_length, 2 * p)
    return np.unique(np.stack([origin[i[good] - back[good]], length[good], p[good]], 1)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def runs_of_texts(texts: list[list[bytes]], min_length: int = 12) -> list[np.ndarray]:
    """For each text, as a list of words, its runs as rows (start, length, period)."""
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    ends = np.cumsum([len(t) for t in texts])
    found = find_runs(word, np.unique(ends), min_length)
    where = np.searchsorted(ends, found[:, 0], side="right")
    cut = np.searchsorted(where, np.arange(len(texts) + 1))
    return [found[cut[k] : cut[k + 1]] - [[int(ends[k]) - len(texts[k]), 0, 0]] for k in range(len(texts))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def detect_runs(docs: DataFrame, min_length: int = 12, words_at_once: int = 200_000, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least ``max(min_length, 2 q)`` words
    that no neighbour extends; collapsed are the words that no run repeats, joined by one space.
    One row per row of ``docs``; nothing is shuffled, and texts are read in groups of about
    ``words_at_once`` words (a longer text is a group of its own). Null and empty texts and texts
    without a word have no runs and collapse to the empty string; null ids and repeated rows pass
    through; an empty table gives an empty table; extra columns are not read.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            found: list[np.ndarray] = []
            group: list[list[bytes]] = []
            for k, t in enumerate(texts):
                group.append(t)
                if k + 1 == len(texts) or sum(map(len, group)) + len(texts[k + 1]) > words_at_once:
                    found += runs_of_texts(group, min_length)
                    group = []
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            at = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(RUNS.value_type))
            kept = [b" ".join(collapse(t, f)).decode() for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), items),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, where one document in ten is made periodic from some word on.

    With h = crc32 of the id in decimal, g = floor(h / 10) and n words: if h % 10 = 0, each word
    i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id counts
    as the empty text; texts without a word stay as they are.
    """
    t = id_text(docs, id_col, text_col)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words: Column = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    w = t.withColumn("words", F.when(h % 10 == 0, words)).withColumn("g", g)
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), copies))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return w.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))
