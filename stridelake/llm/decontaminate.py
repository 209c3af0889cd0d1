"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. The frequency of every benchmark word is counted over all documents.
2. From each word of a test item the shortest n-gram is taken whose chance frequency (product of its
   words' frequencies) is at most ``rate``; these are the item's seeds. Rarity by chance and not by
   observed count keeps the seeds of a passage that was copied into very many documents.
3. Seeds found in a document propose (item, diagonal); the stretch of words around the
   diagonals is aligned with the whole item by Smith-Waterman (gaps and mismatches allowed), all
   stretches of a batch at once. Its score in shares of a perfect copy decides, or, for an excerpt of a
   longer item, the score itself: ``passage`` is that of so many copied words in a row.

Items of fewer than ``min_words`` words are matched as whole sequences of words, exactly.
Items go through in blocks of bounded size, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_text, slices

#: Separators besides ASCII white space and punctuation: Latin-1 marks, general and CJK punctuation.
OTHER_MARKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
#: Scripts without spaces between words, each character a word: Thai to Burmese, Khmer, kana, Han, half-width kana, supplementary Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH, MISS, GAP = 2, -1, -1
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8: what stands between white space and punctuation, and each character of unspaced scripts."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        if OTHER_MARKS.search(text):
            text = OTHER_MARKS.sub(" ", text)
        if UNSPACED.search(text):
            text = UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(BLANKS).split()


def numbered(texts: list[str | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one row (-1: not in the vocabulary), a -1 behind each text, and their starts."""
    flat: list[bytes] = []
    starts = [0]
    for t in texts:
        flat += words(t)
        flat.append(b"")  # no word: parts the texts
        starts.append(len(flat))
    get = vocab.get
    return np.fromiter([get(w, -1) for w in flat], np.int64, len(flat)), np.array(starts)


def mix(ids: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """64-bit key of the n-gram at each of the places (a collision only costs an alignment)."""
    key = np.zeros(len(at), np.uint64)
    for k in range(n):
        key = (key + ids[at + k].astype(np.uint64) + np.uint64(1)) * SPREAD
        key ^= key >> np.uint64(29)
    return key


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair and the text column (exclusive) where it ends.

    items, texts: rows of word numbers, padded with -3 and -2; unknown words are -1. These match nothing.
    """
    rows, width = texts.shape
    h = np.zeros((rows, width + 1), np.int32)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        fresh = np.zeros_like(h)
        diagonal = h[:, :-1] + np.where(items[:, i, None] == texts, MATCH, MISS)
        np.maximum(diagonal, h[:, 1:] + GAP, out=diagonal)
        np.maximum(diagonal, 0, out=fresh[:, 1:])
        h = np.maximum.accumulate(fresh + slope, axis=1) - slope  # gaps along the text
        top = h.max(axis=1)
        better = top > best
        end[better] = h[better].argmax(axis=1)
        np.maximum(best, top, out=best)
    return best, end


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


@dataclass
class Block:
    """Test items in word numbers with their seeds by n-gram length."""

    names: list
    items: list[np.ndarray]
    vocab: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # n -> sorted keys, item, offset
    threshold: float
    passage: int  # score that suffices whatever the item's length
    whole: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted keys, item; of short items

    @staticmethod
    def build(names, texts, vocab, p: np.ndarray, rate: float, longest: int, threshold: float, passage: int, min_words: int) -> Block:
        items = [np.array([vocab[w] for w in ws], np.int64) for ws in texts]
        found: dict[int, list[tuple[np.uint64, int, int]]] = {}
        short: dict[int, list[tuple[np.uint64, int]]] = {}
        for k, it in enumerate(items):
            if len(it) < min_words:
                short.setdefault(len(it), []).append((mix(it, len(it), np.zeros(1, np.int64))[0], k))
                continue
            keys = {n: mix(it, n, np.arange(max(0, len(it) - n + 1))) for n in range(2, longest + 1)}
            for at in range(len(it)):
                n, chance = 0, 1.0
                while n < min(longest, len(it) - at) and (n < 2 or chance > rate):
                    chance *= p[it[at + n]]
                    n += 1
                if n >= 2 and (chance <= rate or n == longest):
                    found.setdefault(n, []).append((keys[n][at], k, at))
        seeds = {}
        for n, rows in found.items():
            rows.sort()
            seeds[n] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        whole = {n: tuple(np.array(c, t) for c, t in zip(zip(*sorted(rows)), (np.uint64, np.int64))) for n, rows in short.items()}
        return Block(list(names), items, vocab, seeds, threshold, passage, whole)

    def copies(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first word) of each place where a short item stands word for word."""
        run = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, (keys, item) in self.whole.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(run[n:] - run[:-n] == n)
            key = mix(ids, n, at)
            low = np.searchsorted(keys, key)
            low[low == len(keys)] = 0
            at, key, low = (x[keys[low] == key] for x in (at, key, low))
            high = np.searchsorted(keys, key, side="right")
            rows = np.searchsorted(starts, at, side="right") - 1
            for row, p, i, j in zip(rows.tolist(), at.tolist(), low.tolist(), high.tolist()):
                for k in item[i:j].tolist():
                    if np.array_equal(self.items[k], ids[p : p + n]):
                        yield row, k, p - int(starts[row])

    def stretches(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, from, to) around the seed hits in the texts; overlapping ones of an item are joined."""
        run = np.concatenate([[0], np.cumsum(ids >= 0)])
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for n, (keys, item, offset) in self.seeds.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(run[n:] - run[:-n] == n)  # n known words in a row never span two texts
            key = mix(ids, n, at)
            low = np.searchsorted(keys, key)
            low[low == len(keys)] = 0
            at, key, low = (x[keys[low] == key] for x in (at, key, low))
            high = np.searchsorted(keys, key, side="right")
            rows = np.searchsorted(starts, at, side="right") - 1
            for row, p, i, j in zip(rows.tolist(), at.tolist(), low.tolist(), high.tolist()):
                for s in range(i, j):
                    k = int(item[s])
                    m = len(self.items[k])
                    start, pad = p - int(offset[s]), 4 + m // 4
                    span = (max(int(starts[row]), start - pad), min(int(starts[row + 1]) - 1, start + m + pad))
                    spans.setdefault((row, k), []).append(span)
        out = []
        for (row, k), ranges in spans.items():
            ranges.sort()
            a, b = ranges[0]
            for c, d in ranges[1:]:
                if c > b:
                    out.append((row, k, a, b))
                    a = c
                b = max(b, d)
            out.append((row, k, a, b))
        return out

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, object, float, int, int]]:
        """(row, item name, score, first word, last word + 1): the best match of each item in each text."""
        flat, starts = numbered(texts, self.vocab)
        todo = [(row, k, a - int(starts[row]), flat[a:b]) for row, k, a, b in self.stretches(flat, starts)]
        todo.sort(key=lambda x: len(x[3]))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for row, k, p in self.copies(flat, starts):
            best.setdefault((row, k), (1.0, p, p + len(self.items[k])))
        at = 0
        while at < len(todo):  # batches of bounded area; padding stays small because lengths are sorted
            part = todo[at : at + max(1, min(256, 200_000 // (1 + len(todo[min(at + 255, len(todo) - 1)][3]))))]
            at += len(part)
            score, end = align(padded([self.items[k] for _, k, _, _ in part], -3), padded([x for *_, x in part], -2))
            for (row, k, a, ids), s, e in zip(part, score.tolist(), end.tolist()):
                share = s / (MATCH * len(self.items[k]))
                if (share >= self.threshold or s >= self.passage) and share > best.get((row, k), (0.0,))[0]:
                    _, back = align(self.items[k][::-1][None, :], ids[:e][::-1][None, :])
                    best[row, k] = (share, a + e - int(back[0]), a + e)
        for (row, k), (share, start, end) in sorted(best.items()):
            yield row, self.names[k], share, start, end


def word_counts(docs: DataFrame, vocab: dict[bytes, int], text_col: str) -> tuple[np.ndarray, int]:
    """Occurrences of the vocabulary's words and the number of all words, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(vocab), np.int64), 0
        for b in slices(batches):
            ids, _ = numbered(b.column(0).to_pylist(), vocab)
            n += np.bincount(ids[ids >= 0], minlength=len(vocab))
            total += len(ids) - b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], names=["w", "n"])

    got = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(count, "w long, n long")
    got = got.groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocab) + 1, np.int64)
    out[got["w"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def blocks(
    docs: DataFrame, benchmark: DataFrame, text_col="text", items_per_block=5_000, rate=1e-7, longest=6, threshold=0.5, min_words=8, passage_words=18
) -> Iterator[Block]:
    """Blocks of test items. Items without a word (null ones too) match nothing; those of fewer than ``min_words`` words only exactly."""
    rows = benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"].cast("string")).toLocalIterator()
    held: list[tuple[int, list[bytes]]] = []

    def build() -> Block:
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in held for w in ws))}
        n, total = word_counts(docs, vocab, text_col)
        p = (n + 1) / max(1, total + len(vocab))
        return Block.build([i for i, _ in held], [ws for _, ws in held], vocab, p, rate, longest, threshold, MATCH * passage_words, min_words)

    for item, text in rows:
        ws = words(text)
        if ws:
            held.append((item, ws))
        if len(held) == items_per_block:
            yield build()
            held = []
    if held:
        yield build()


MATCHES = "doc_id long, item_id long, score double, first_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every test item that a document holds a copy of.

    score: Smith-Waterman score in shares of a perfect copy, at least ``threshold`` or worth ``passage_words``
    copied words; the best place per row and item. Null and empty texts hold nothing; null ids are reported as null; repeated rows
    are reported each; no items or no documents give an empty table. Other columns are not read.
    """
    own = id_text(docs, id_col, text_col)
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for block in blocks(docs, benchmark, text_col, **options):
        out = out.unionByName(own.mapInArrow(_matcher(block), MATCHES))
    return out


def _matcher(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            found = list(block.matches(b.column("text").to_pylist()))
            row, item, score, start, end = map(list, zip(*found)) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()),
                    pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def _leak_flag(block: Block):
    @F.pandas_udf("boolean")
    def leaks(s: pd.Series) -> pd.Series:
        hit = np.zeros(len(s), bool)
        for at in range(0, len(s), 512):
            texts = [t if isinstance(t, str) else None for t in s.iloc[at : at + 512]]
            hit[[at + row for row, *_ in block.matches(texts)]] = True
        return pd.Series(hit)

    return leaks


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item; all columns stay."""
    for block in blocks(docs, benchmark, text_col, **options):
        name = free_name(docs, "leak")
        docs = docs.withColumn(name, _leak_flag(block)(docs[text_col].cast("string"))).filter(~F.col(name)).drop(name)
    return docs
