"""Exact merge-type (BPE) SentencePiece ids by backtracking over longest matches.

Merging repeatedly joins the neighbouring symbols whose union has the highest score, the leftmost
of equal ones. The ids of a text are the only sequence of pieces in which each two neighbours are
compatible, that is, in which merging the characters of both gives the two again: the first merge
across a border of such a sequence would also happen in the two pieces beside that border alone. So
pieces are searched from left to right, the longest match first (an Aho-Corasick automaton over
reversed pieces yields it for every position), then its shorter prefixes; a position
from which no piece goes on is marked in a bit field and the piece before it is taken back. The
ids of a prefix are unique, so a marked position has failed for good.

A merge never crosses two characters that no piece holds side by side. The text is cut at a word
mark behind another character and around characters that occur in no longer piece (both
checked when the model is loaded); ids of the resulting words are remembered up to a fixed number.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

MARK = "▁"
SCHEMA = "doc_id long, ids binary, decoded string"
#: Fixed values of the model file's format: the kind of a merge-type model and of two piece types.
MERGE_MODEL, USER_DEFINED, UNUSED = 2, 4, 5
NEVER = float("-inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, as the library encodes them without sampling."""

    def __init__(self, model_path: str, words_kept: int = 700_000, pairs_kept: int = 1_000_000):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        message = list(fields(sp.serialized_model_proto()))
        kinds = {dict(fields(v)).get(3, 1) for k, v in message if k == 1}
        trainer = dict(fields(next(v for k, v in message if k == 2)))
        if trainer.get(3, 1) != MERGE_MODEL or not trainer.get(35) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("a merge-type model with byte fallback and without user-defined pieces is needed")
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if not special(i)}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        longer = [p for p in self.id if len(p) > 1]
        if any(c not in self.id for p in longer for c in p):
            raise ValueError("every character of a piece must be a piece itself")
        self.found = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.found.add_word(p[::-1], i)
        self.found.make_automaton()
        inner = {c for p in longer for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.words = re.compile(f"{MARK}+[^{MARK}{lone}]*|[{lone}]|[^{MARK}{lone}]+", re.S)
        if not lone or any(crossing.search(p) for p in longer):
            self.words = re.compile(".+", re.S)
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}
        self.length = [len(p) for p in self.piece]
        self.words_kept, self.pairs_kept = words_kept, pairs_kept

    def merges_to(self, pieces: list[str]) -> bool:
        """Whether merging the characters of one or two pieces gives just these pieces."""
        part, get = list("".join(pieces)), self.score.get
        border = len(pieces[0]) if len(pieces) > 1 else -1  # symbols before the border
        unions = [get(a + b, NEVER) for a, b in zip(part, part[1:])]
        while unions:
            best = max(unions)
            if best == NEVER:
                break
            k = unions.index(best)
            if k == border - 1:
                return False
            border -= k < border
            part[k : k + 2] = [part[k] + part[k + 1]]
            del unions[k]
            if k < len(unions):
                unions[k] = get(part[k] + part[k + 1], NEVER)
            if k:
                unions[k - 1] = get(part[k - 1] + part[k], NEVER)
        return part == pieces

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a; with a = -1, whether b can begin a text. Remembered.

        Two pieces of which one is not what its own characters merge to are never compatible.
        """
        if a < 0:
            ok = self.whole[b] = self.merges_to([self.piece[b]])
        else:
            if len(self.pairs) >= self.pairs_kept:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merges_to([self.piece[a], self.piece[b]])
        return ok

    def shorter(self, i: int) -> int:
        """The longest piece that is a proper prefix of a piece, or -1."""
        if i not in self.prefix:
            p = self.piece[i]
            self.prefix[i] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), -1)
        return self.prefix[i]

    def search(self, text: str) -> list[int]:
        """ids of a text whose characters are all pieces."""
        n = len(text)
        longest = [-1] * (n + 1)
        for end, i in self.found.iter(text[::-1]):
            if longest[n - 1 - end] < 0:  # the longest match at a place comes first
                longest[n - 1 - end] = i
        failed = bytearray(n // 8 + 1)
        ids: list[int] = []
        at, piece, last = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + self.length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = self.whole.get(piece) if last < 0 else self.pairs.get((last, piece))
                    if self.compatible(last, piece) if ok is None else ok:
                        break
                piece = self.shorter(piece)
            if piece >= 0:
                ids.append(piece)
                at, last, piece = end, piece, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = self.shorter(ids.pop())
                at -= self.length[last]
                last = ids[-1] if ids else -1
        return ids

    def word(self, text: str) -> bytes:
        known, ids, start = self.id, [], 0
        for k, c in enumerate(text):
            if c not in known:  # its UTF-8 bytes stand for it
                ids += self.search(text[start:k]) + [self.byte[x] for x in c.encode()]
                start = k + 1
        ids += self.search(text[start:])
        return little(ids)

    def encode(self, normal: str) -> bytes:
        """ids of a text that the model's own normaliser has normalised."""
        cache, out = self.cache, []
        for w in self.words.findall(normal):
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= self.words_kept:
                        cache.clear()
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)


def little(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def listed(ids: bytes) -> list[int]:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tolist()


def encode_documents(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (the library's text of these ids).

    One row per row of ``docs``, without a shuffle. A null text counts as empty (only the begin and end
    ids, decoded to the empty text); null ids and repeated rows pass through; very long texts
    are encoded whole; an empty table gives an empty table; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder(model_path)
        sp = enc.sp
        head, tail = little([sp.bos_id()] if begin else []), little([sp.eos_id()] if end else [])
        for b in slices(batches, 64):
            ids = [head + enc.encode(sp.normalize(t)) + tail if t else head + tail for t in b.column("text").to_pylist()]
            text = [sp.decode(listed(x)) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
