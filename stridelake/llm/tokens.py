"""Token counts of whole texts, huge ones through overlapping chunks.

A text of at most ``chunk_chars`` code points is encoded at once. A longer one is cut into
overlapping chunks, each encoded with offsets. Two neighbouring chunks are spliced at a position
inside their overlap that is (1) a token start in both encodings and (2) proven stable: a space
after a non-space. No piece of the vocabulary holds a space mark behind another character
(checked when the model is loaded), so no merge can cross such a position and the tokens on
either side do not depend on the other side. Where an overlap has no such position it is
widened, at last to the whole rest of the text; the sum always equals the count of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int"


class ChunkEncoder:
    """Counts tokens with bounded encoder input as long as texts have stable positions."""

    def __init__(self, model_path: str, chunk_chars: int, overlap_chars: int):
        import sentencepiece

        if not 0 < overlap_chars < chunk_chars:
            raise ValueError("0 < overlap_chars < chunk_chars is needed")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        crossing = re.compile(f"[^{MARK}]{MARK}")
        kept = self.sp.encode("a  b ", out_type=str)
        self.proven = "".join(kept) == f"{MARK}a{MARK}{MARK}b{MARK}" and not any(
            crossing.search(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())
        )
        self.stable = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")

    def starts(self, text: str) -> np.ndarray:
        """Code point at which each token starts; the dummy prefix belongs to the first one."""
        begins = np.fromiter((p.begin for p in self.sp.encode(text, return_type="proto").pieces), np.int64)
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # offsets come in bytes
        return np.append(np.cumsum(lead) - 1, len(text))[begins]

    def count(self, text: str) -> tuple[int, int, int]:
        """(tokens, chunks, widenings) of a long text."""
        n, size, overlap = len(text), self.chunk, self.overlap
        if n <= size or not self.proven:
            return len(self.sp.encode(text)), 1, 0
        left, start, end = 0, 0, size
        here = self.starts(text[:size])
        total, chunks, widened = 0, 1, 0
        while end < n:
            back = max(start, end - overlap)
            ahead_end = min(n, end + max(size - overlap, size // 2))
            ahead = self.starts(text[back:ahead_end])
            cut = self.common(text, here, start, ahead, back, max(left, back), end)
            if cut is None:
                widened += 1
                if back == start:  # no stable position in the whole chunk: it grows
                    end = min(n, start + 2 * (end - start))
                    here = self.starts(text[start:end])
                overlap *= 2
                continue
            total += int(np.count_nonzero((here + start >= left) & (here + start < cut)))
            left, start, end, here, overlap = cut, back, ahead_end, ahead, self.overlap
            chunks += 1
        return total + int(np.count_nonzero(here + start >= left)), chunks, widened

    def common(self, text, here, start, ahead, back, low, end) -> int | None:
        """Last stable position in (low, end) at which both encodings start a token."""
        both = set((start + here).tolist()) & set((back + ahead).tolist())
        found = None
        for m in self.stable.finditer(text, low + 1, end):
            if m.start() in both:
                found = m.start()
        return found


def count_tokens(
    docs: DataFrame,
    model_path: str,
    chunk_chars: int = 16_384,
    overlap_chars: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks, n_widened: one row per row of ``docs``.

    Null text counts as empty (0 bytes, 0 tokens, 1 chunk). Null ids and repeated rows pass
    through, one row each. An empty table gives an empty table. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder(model_path, chunk_chars, overlap_chars)
        for b in slices(batches, 64):
            texts = [t or "" for t in b.column("text").to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            out = [(0, 1, 0)] * len(texts)
            for i, ids in zip(short, enc.sp.encode([texts[i] for i in short], num_threads=1)):
                out[i] = (len(ids), 1, 0)
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    out[i] = enc.count(t)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    *(pa.array([o[k] for o in out], ty) for k, ty in enumerate((pa.int64(), pa.int32(), pa.int32()))),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
