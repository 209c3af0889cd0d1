"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Training rows are a sample of at most about ``max_train_rows`` labelled documents, chosen by a hash of the
id; their statistics (a few numbers each) are boosted with numpy. The trees are
flattened into arrays and scored level by level for a whole batch of texts and all trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, remainder

_UP = bytes(range(65, 91))
_LOW = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARK = b".,;:?'\"-()"
_SYMBOL = b"#$%&*|<>@^~_=+/\\{}[]`"
_GAP = SPACES.encode()
FEATURES = (
    "log_bytes log_words word_bytes upper lower digit mark symbol shout gap non_ascii pipe log_lines "
    "line_bytes dup_lines short_lines distinct top_word top_ten same_as_last repeat_pairs no_letter "
    "long_words upper_words compressed"
).split()


def statistics(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    b = text.encode()
    n = len(b)
    count = lambda cls: n - len(b.translate(None, cls))
    words = text.split()
    k = max(1, len(words))
    freq = Counter(words).most_common()
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), n / k, count(_UP) / n, count(_LOW) / n, count(_DIGIT) / n, count(_MARK) / n,
        count(_SYMBOL) / n, b.count(b"!") / n, count(_GAP) / n, 1 - len(b.translate(None, bytes(range(128, 256)))) / n,
        b.count(b"|") / n, np.log1p(len(lines)), n / m, 1 - len(set(lines)) / m, sum(len(x) < 20 for x in lines) / m,
        len(freq) / k, (freq[0][1] if freq else 0) / k, sum(c for _, c in freq[:10]) / k,
        sum(a == c for a, c in pairs) / k, 1 - len(set(pairs)) / max(1, len(pairs)),
        sum(1 for w in words if not any(map(str.isalpha, w))) / k, sum(len(w) > 15 for w in words) / k,
        sum(map(str.isupper, words)) / k, len(zlib.compress(b, 1)) / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # a value above the cut goes right
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), self.base)
        t = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.cut[t, node])
        return self.base + self.leaf[t, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, trees=80, depth=4, bins=64, rate=0.15, l2=1.0, least=5) -> Trees:
    """Logistic gradient boosting on per-feature histograms (level by level, all features at once)."""
    n, f = x.shape if len(x) else (0, len(FEATURES))
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2) if n else 0.5
        none = np.zeros((0, 2**depth - 1))
        return Trees(float(np.log(p / (1 - p))), depth, none.astype(int), none, np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    flat = code + np.arange(f) * bins
    p0 = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(n, base)
    feats, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feat, cut, node = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf), np.zeros(n, int)
        for level in range(depth):
            wide = 2**level
            at = ((node[:, None] * f * bins) + flat).ravel()
            size = wide * f * bins
            hist = [
                np.bincount(at, weights=np.repeat(w, f), minlength=size).reshape(wide, f, bins).cumsum(axis=2)
                for w in (g, h, np.ones(n))
            ]
            gl, hl, cl = hist
            gt, ht, ct = (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(cl < least) | (ct - cl < least)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            goes = np.zeros((wide, 2), int)
            for q in range(wide):
                j, c = divmod(int(best[q]), bins)
                i = 2**level - 1 + q
                if gain[q, j, c] > 1e-9 and c < len(edges[j]):
                    feat[i], cut[i], goes[q] = j, edges[j][c], (j, c)
                else:
                    goes[q] = (0, bins)  # no split: everything stays left
            node = 2 * node + (code[np.arange(n), goes[node, 0]] > goes[node, 1])
        sums = [np.bincount(node, weights=w, minlength=2**depth) for w in (g, h)]
        leaf = rate * sums[0] / (sums[1] + l2)
        raw += leaf[node]
        feats.append(feat)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, depth, np.array(feats), np.array(cuts), np.array(leaves))


def train(
    docs: DataFrame, labels: DataFrame, keep: Column, max_train_rows: int = 20_000, id_col="doc_id", text_col="text", **options
) -> Trees:
    """Trees from labelled rows where ``keep`` holds. Repeated labels of an id are averaged.

    The bound on the rows is also the bound on what is broadcast, (id, label) of the sample, and on what comes to the
    driver: an id teaches once, however many rows repeat it (of different texts the one of the least hash).
    """
    marks = (
        labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["quality"].cast("double").alias("q"))
        .dropna().groupBy("l_id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    )
    n = marks.count()
    share = min(1.0, max_train_rows / max(1, n))
    if share < 1:
        marks = marks.filter(F.pmod(F.xxhash64("l_id", F.lit("quality")), F.lit(1 << 20)) < share * (1 << 20))

    @F.pandas_udf("array<double>")
    def numbers(s: pd.Series) -> pd.Series:
        return pd.Series([statistics(t if isinstance(t, str) else None) for t in s])

    rows = docs.filter(keep).select(docs[id_col].cast("long").alias("l_id"), docs[text_col].cast("string").alias("text"))
    once = rows.join(F.broadcast(marks), "l_id").groupBy("l_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = once.select("l_id", "y", numbers("text").alias("x")).toPandas()
    got = got.sort_values("l_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return boost(x, got["y"].to_numpy(float), **options)


def scorer(trees: Trees):
    """Pandas UDF text -> score in 0..1; a null or empty text is scored by its (zero) statistics."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(s), 1024):
            x = [statistics(t if isinstance(t, str) else None) for t in s.iloc[at : at + 1024]]
            out.append(trees.score(np.array(x, float)))
        return pd.Series(np.concatenate(out))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col="doc_id", text_col="text", **options):
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Held out of training: crc32 of the id as text, mod 5, is 0. Null ids, null and empty texts and
    repeated rows are scored like others; without usable labels every score is 0.5; an empty table
    gives an empty table; other columns of ``docs`` are not read.
    """
    held = remainder(docs[id_col], 5) == 0
    trees = train(docs, labels, ~held, id_col=id_col, text_col=text_col, **options)
    s = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held.alias("held_out"), scorer(trees)(docs[text_col].cast("string")).alias("score")
    )
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
