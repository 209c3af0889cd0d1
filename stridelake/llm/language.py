"""Language identification of whole texts, with spans for mixed ones.

Training (Spark): at most ``max_train_docs`` labelled documents, dealt evenly to the languages and
chosen by a hash of the id, give counts of hashed character n-grams per language and of letters
per (script, language). Only those bounded tables reach the driver.

Prediction (Arrow batches): the script of a word (Unicode ranges) narrows the languages it can
have; a word's score per language is the scaled sum of the log probabilities of its n-grams; Viterbi
over the words, with a penalty for each switch, labels every word. The prediction is the language
with most letters, its score the share of the letters that carry that label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices

UNKNOWN = "und"
#: First and last code point of the main ranges of each script.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
NAMES = [*SCRIPTS, "other"]
STARTS = sorted((lo, hi, k) for k, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
#: Runs of letters and of numerals that are no decimal digits (fractions, Roman or circled numbers).
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
LONGEST = 4
#: Words whose n-grams are in memory at a time (about 100 numbers a word).
SCORED_AT_ONCE = 16_384


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def script_of(word: str) -> int:
    """Number of the script of the word's first letter."""
    c = ord(word[0])
    for lo, hi, k in STARTS:
        if lo <= c <= hi:
            return k
    return len(SCRIPTS)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash bucket, word) of every n-gram of 1 to LONGEST bytes, borders marked, and of the whole words."""
    parts = [w.encode() for w in words]
    data = np.frombuffer(b"".join([b"<%b>" % w for w in parts]), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(w) + 2 for w in parts])
    buckets = [np.fromiter((zlib.crc32(w) % BUCKETS for w in parts), np.int64, len(parts))]
    owners = [np.arange(len(parts))]
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        inside = np.flatnonzero(owner[:m] == owner[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
        h = np.full(len(inside), n, np.uint32)
        for k in range(n):
            h = (h ^ data[inside + k]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        buckets.append((h % np.uint32(BUCKETS)).astype(np.int64))
        owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages
    switch: float = 6.0
    scale: float = 0.3
    cache_words: int = 300_000


class Labeller:
    """Viterbi labels of the words of many texts at once."""

    def __init__(self, model: LanguageModel):
        self.m, self.k = model, len(model.langs)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, self.k), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Scaled log probabilities of each word in each language, the best one 0."""
        at, owner = ngrams(words)
        score = np.stack([np.bincount(owner, weights=self.m.logp[at, k], minlength=len(words)) for k in range(self.k)], axis=1)
        score *= self.m.scale
        mask = self.m.allowed[[script_of(w) for w in words]]
        mask[~mask.any(axis=1)] = True  # a script that training never saw narrows nothing
        score = np.where(mask, score, -np.inf)
        return np.maximum(score - score.max(axis=1, keepdims=True), -1e4).astype(np.float32)

    def word_scores(self, found: list[list[str]]) -> list[np.ndarray]:
        """Row of ``self.rows`` of each word of each text; words not seen before are scored together."""
        if len(self.index) > self.m.cache_words:
            self.index.clear()
        index = self.index
        new = list({w for ws in found for w in ws if w not in index})
        if new:
            score = np.concatenate([self.scores(new[i : i + SCORED_AT_ONCE]) for i in range(0, len(new), SCORED_AT_ONCE)])
            first = len(index)
            index.update(zip(new, range(first, first + len(new))))
            self.rows = np.concatenate([self.rows[:first], score])
        return [np.array([index[w] for w in ws], np.int64) for ws in found]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """For each text its words and the language number of each."""
        found = [words_in(t) for t in texts]
        ids = self.word_scores(found)
        return list(zip(found, self.viterbi(ids)))

    def viterbi(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(x) for x in ids])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        kind = np.min_scalar_type(max(self.k - 1, 0))  # the smallest type that numbers the languages
        out = [np.zeros(0, kind) for _ in ids]
        if not len(order):
            return out
        flat = np.concatenate([ids[i] for i in order])
        n = lengths[order]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        alive = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts longer than t
        dp = np.zeros((len(order), self.k), np.float32)
        came = np.empty((len(flat), self.k), kind)  # predecessor of each word and language
        own = np.arange(self.k, dtype=kind)
        for t in range(n[0]):
            a = alive[t]
            d, at = dp[:a], first[:a] + t
            if t:
                best = d.argmax(axis=1)
                top = d[np.arange(a), best][:, None] - np.float32(self.m.switch)
                moved = top > d
                came[at] = np.where(moved, best[:, None].astype(kind), own)
                d = np.where(moved, top, d)
            d = d + self.rows[flat[at]]
            dp[:a] = d - d.max(axis=1, keepdims=True)  # only differences matter; keeps float32 exact enough
        label = np.empty(len(flat), kind)
        label[first + n - 1] = dp.argmax(axis=1)
        for t in range(n[0] - 1, 0, -1):
            a = alive[t]
            at = first[:a] + t
            label[at - 1] = came[at, label[at]]
        for i, f, k in zip(order, first, n):
            out[i] = label[f : f + k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for words, label in self.label(texts):
            if not words:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            mass = np.bincount(label, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=self.k)
            langs.append(self.m.langs[int(mass.argmax())])
            scores.append(float(mass.max() / mass.sum()))
        return langs, scores

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words of one language, in code points."""
        (words, label), out = self.label([text])[0], []
        at = 0
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter whose lower case is longer: positions of the lower-cased text
            text = low
        for w, k in zip(words, label):
            s = low.index(w, at)
            at = s + len(w)
            lang = self.m.langs[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], at, lang)
            else:
                out.append((s, at, lang))
        return out


def train(
    docs: DataFrame,
    keep: Column,
    max_train_docs: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    switch: float = 6.0,
) -> LanguageModel | None:
    """A model from rows where ``keep`` holds and text and language are there; None without any."""
    rows = docs.filter(keep).select(
        docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    each = max(1, max_train_docs // len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def out():
            for lang, c in words.items():
                grams, letters = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
                found, times = list(c), np.array(list(c.values()))
                for i in range(0, len(found), SCORED_AT_ONCE):
                    bucket, owner = ngrams(found[i : i + SCORED_AT_ONCE])
                    grams += np.bincount(bucket, weights=times[i:][owner], minlength=BUCKETS).astype(np.int64)
                for w, n in c.items():
                    letters[script_of(w)] += n * len(w)
                at, sc = np.flatnonzero(grams), np.flatnonzero(letters)
                keys = np.concatenate([at, -1 - sc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(np.concatenate([grams[at], letters[sc]]))],
                    names=["lang", "bucket", "n"],
                )

        for b in slices(batches):
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(words_in(t))
            if sum(map(len, words.values())) > 200_000:
                yield from out()
                words.clear()
        yield from out()

    counts = (
        rows.filter(drawn).mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    grams = np.zeros((BUCKETS, len(langs)))
    letters = np.zeros((len(NAMES), len(langs)))
    col = counts["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int)
    key, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    g = key >= 0
    grams[key[g], col[g]] = n[g]
    letters[-1 - key[~g], col[~g]] = n[~g]
    smooth = 0.5
    logp = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS)).astype(np.float32)
    allowed = letters >= 0.001 * np.maximum(letters.sum(axis=0), 1)
    return LanguageModel(langs, logp, allowed & (letters > 0), switch)


def predictor(model: LanguageModel | None):
    """Pandas UDF text -> (lang_pred, score). Without a model every text is ``und``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lab = Labeller(model) if model else None
        for s in batches:
            langs, scores = [], []
            for at in range(0, len(s), 1024):
                texts = [t if isinstance(t, str) else None for t in s.iloc[at : at + 1024]]
                a, b = lab.predict(texts) if lab else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                langs += a
                scores += b
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    Held out of training: crc32 of the id as text, mod 4, is 2. A null text or one without a letter is
    ``und`` with score 0. Null ids and repeated rows get rows as well; null languages teach
    nothing; an empty table gives an empty table; other columns are not read.
    """
    held = remainder(docs[id_col], 4) == 2
    model = train(docs, ~held, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    seen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held.alias("held_out"),
        predictor(model)(docs[text_col].cast("string")).alias("p"),
    )
    return seen.select("doc_id", "held_out", "p.lang_pred", "p.score")


def span_labels(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, spans: the language of each stretch of a (mixed) text, in code points.

    One row per row of ``docs``. A null text, and one without a letter, has no span; null ids and repeated rows
    pass through; an empty table gives an empty table; other columns are not read. Where lower case changes a
    text's length, positions are those of the lower-cased text.
    """

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lab = Labeller(model)
        for s in batches:
            yield pd.Series([
                [{"start": a, "end": b, "lang": k} for a, b, k in lab.spans(t if isinstance(t, str) else None)] for t in s
            ])

    return docs.select(docs[id_col].alias("doc_id"), label(docs[text_col].cast("string")).alias("spans"))
