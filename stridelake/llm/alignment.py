"""How the tokens of two tokenizers lie on each other, once for every distinct text.

Rows are shuffled by their full text, so each distinct text is tokenised and aligned once and carries
its multiplicity. Byte offsets at which tokens of both tokenizers end cut a text into groups; each token
of one side is linked with each token of the other side of its group. A pair of ids counts the documents
that hold it, which is the sum of the multiplicities of the distinct texts that hold it.

Within a text, work is shared, too: both tokenizers treat a space behind a character that is no white
space as the beginning of something new (the pre-tokenizer's pattern on one side; on the other
side no piece holds a word mark behind another character; both are checked when the files are loaded),
so the text is cut there and the alignment of a chunk is remembered, up to a fixed number of chunks.

Counts of pairs come back to the texts in two ways that together cover every pair. The most frequent
pairs, at most ``hot_pairs`` of them, go to the tasks as sorted arrays. The other pairs, of which none
can hold more than one ``hot_pairs``-th of all links of pairs and texts, are joined by pair.
Measures come back to the documents in the same way: texts with more than one 2,000th of all rows
(fewer than 2,000 texts) are broadcast, the others joined by a hash of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, stored
from .packing import ByteEncoder

MARK = "▁"
PAIR, TIMES = "<u8", "<u4"  # little-endian numbers in the binary columns
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
TEXTS = "key binary, n long, n_a long, n_b long, n_groups long, n_links long, {groups} string, pairs binary, times binary"


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(end, self.n), self.data.dtype)])
        self.data[self.n : end] = values
        self.n = end


class Aligner:
    """Alignments of texts; those of their chunks are remembered, up to ``chunks_kept``."""

    def __init__(self, path_a: str, path_b: str, chunks_kept: int = 600_000):
        import sentencepiece

        self.a = ByteEncoder(path_a)
        self.a.tok.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.size_b = self.table_a(), sp.get_piece_size()
        kind = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
        self.bytes_b = [kind(i) for i in range(self.size_b)]
        self.length_a, self.length_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.shown = [str(i) for i in range(max(max(self.bytes_a) + 1, self.size_b))]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        cuttable = "".join(sp.encode("a  b ", out_type=str)) == f"{MARK}a{MARK}{MARK}b{MARK}" and self.a.fast is not None
        cuttable = cuttable and not any(crossing.search(sp.id_to_piece(i)) for i in range(self.size_b))
        self.cut = re.compile(r"(?<=\S)(?= .)", re.S)  # a last space alone is no chunk: without text there is no mark if cuttable else None
        self.chunks_kept = chunks_kept
        self.forget()

    def table_a(self) -> dict[int, bytes]:
        if self.a.fast is not None:
            return {i: b for b, i in self.a.fast._mergeable_ranks.items()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        return {i: bytes(byte[c] for c in t) for t, i in self.a.tok.get_vocab(with_added_tokens=False).items() if set(t) <= set(byte)}

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = Grown("i8,i8,i8,i8")
        self.pairs, self.ends = Grown(np.int64), Grown(np.int64)

    def encode_a(self, text: str) -> list[int]:
        return self.a.fast.encode_ordinary(text) if self.a.fast is not None else self.a.tok.encode(text, add_special_tokens=False).ids

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks, each of which begins with a space."""
        sums, pairs, ends, at = [], [], [], self.pairs.n
        shown, size_b = self.shown, self.size_b
        for chunk, b in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1)):
            a, raw = self.encode_a(chunk), chunk.encode()
            if b"".join([self.bytes_a.get(i, b"") for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
                groups = []
                sums.append((-1, -1, -1, -1))  # the tokens do not spell the chunk: the text has none
            else:
                groups, before = self.align(a, b), len(pairs)
                for x, y in groups:
                    if len(x) == 1 == len(y):
                        pairs.append(x[0] * size_b + y[0])
                    else:
                        pairs += [i * size_b + j for i in x for j in y]
                sums.append((len(a), len(b), len(groups), len(pairs) - before))
            self.number[chunk] = len(self.groups)
            self.groups.append(
                ";".join([f"{','.join([shown[i] for i in x])}|{','.join([shown[i] for i in y])}" for x, y in groups])
            )
            ends.append(at + len(pairs))
        self.sums.add(np.array(sums, self.sums.data.dtype))
        self.pairs.add(np.array(pairs, np.int64))
        self.ends.add(np.array(ends, np.int64))

    def align(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """ids of both sides between neighbouring common ends."""
        groups = []
        length_a, length_b = self.length_a, self.length_b
        i = j = i0 = j0 = x = y = 0
        while i < len(a):
            x += length_a[a[i]]
            i += 1
            while y < x:
                y += length_b[b[j]]
                j += 1
            if x == y:
                groups.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
        return groups

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Sums (n_a, n_b, n_groups, n_links), groups, and distinct pairs with their times, of each text."""
        cuts = [(self.cut.split(" " + t) if self.cut else [" " + t]) if t else [] for t in texts]
        if len(self.groups) > self.chunks_kept:
            self.forget()
        self.learn(list({c: None for t in cuts for c in t if c not in self.number}))
        sums = np.zeros((len(texts), 4), np.int64)
        groups, links = [], []
        table = self.sums.data[: self.sums.n].view(np.int64).reshape(-1, 4)
        ends, pairs = self.ends.data, self.pairs.data
        for k, chunks in enumerate(cuts):
            at = np.array([self.number[c] for c in chunks], np.int64)
            if not len(at) or (table[at, 0] < 0).any():
                groups.append("")
                links.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            sums[k] = table[at].sum(0)
            groups.append(";".join([self.groups[i] for i in at.tolist()]))
            end = ends[at]
            begin = np.where(at > 0, ends[at - 1], 0)
            size = end - begin
            first = np.cumsum(size) - size
            links.append(np.unique(pairs[np.arange(size.sum()) + np.repeat(begin - first, size)], return_counts=True))
        return sums, groups, links


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, text_col: str = "text") -> DataFrame:
    """One row per distinct text (null counts as empty): key (its sha256), n (how many rows have it),
    n_a, n_b, n_groups, n_links, groups (or groups_sha256), pairs and times.

    groups is ``a1,a2|b1;a3|b2,b3``; pairs are the distinct pairs ``a * size_b + b`` in order (``PAIR``),
    times how often each is linked (``TIMES``).
    """
    name = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for b in slices(batches, 128):
            texts = b.column("text").to_pylist()
            sums, groups, links = aligner.texts(texts)
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key"),
                    b.column("n"),
                    *(pa.array(sums[:, c]) for c in range(4)),
                    pa.array(groups, pa.string()),
                    pa.array([p.astype(PAIR).tobytes() for p, _ in links], pa.binary()),
                    pa.array([t.astype(TIMES).tobytes() for _, t in links], pa.binary()),
                ],
                names=["key", "n", *MEASURES, name, "pairs", "times"],
            )

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    distinct = docs.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select(text_key("text").alias("key"), "text", "n").mapInArrow(run, TEXTS.format(groups=name))


def text_key(text):
    return F.unhex(F.sha2(text, 256))


def pair_counts(texts: DataFrame, at_once: int = 4_000_000, kept: int = 1_000_000) -> DataFrame:
    """pair, docs: in how many documents a pair is linked. Tasks add up what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        waiting = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            values, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(values), np.int64)
            np.add.at(total, place, np.concatenate(weights))
            return values, total

        def rows(values, total):
            for i in range(0, len(values), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[i : i + 100_000]), pa.array(total[i : i + 100_000])], names=["pair", "docs"]
                )

        for b in batches:
            for pairs, n in zip(b.column("pairs").to_pylist(), b.column("n").to_pylist()):
                keys.append(np.frombuffer(pairs, PAIR).astype(np.int64))
                weights.append(np.full(len(keys[-1]), n, np.int64))
                waiting += len(keys[-1])
                if waiting >= at_once:
                    values, total = added()
                    if len(values) > kept:
                        yield from rows(values, total)
                        values, total = values[:0], total[:0]
                    keys, weights, waiting = [values], [total], len(values)
        if keys:
            yield from rows(*added())

    seen = texts.select("n", "pairs").mapInArrow(run, "pair long, docs long")
    return seen.groupBy("pair").agg(F.sum("docs").alias("docs"))


def hottest(counts: DataFrame, most: int) -> int:
    """The smallest power-of-two-like step of ``docs`` from which on there are at most ``most`` pairs."""
    steps = counts.groupBy(step().alias("step")).count().collect()  # at most a few hundred rows
    total, least = 0, 1 << 30
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return least


def step():
    return F.floor(F.log2("docs") * 4).cast("int")


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = 500_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    n_best counts the links whose pair is held by the most documents among the pairs of the same first
    id (ties included), count_sum adds up the counts of the links' pairs. Null and empty texts, and texts
    that the tokens of either side do not spell byte by byte, have zeros and an empty groups_sha256. Null
    ids and repeated rows pass through, each row counts as a document of its own. An empty table gives an
    empty table; extra columns are not read.
    """
    import sentencepiece

    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    texts = stored(
        aligned_texts(rows, path_a, path_b, digest=True).withColumn("tid", F.monotonically_increasing_id()), "aligned"
    )
    first = F.floor(F.col("pair") / F.lit(size_b)).cast("long")
    sums = stored(pair_counts(texts), "pair-sums")
    highest = sums.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))  # a row an id: bounded by the vocabulary
    counts = stored(
        sums.withColumn("a", first).join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")),
        "pair-counts",
    )
    least = hottest(counts, hot_pairs)
    hot = counts.filter(step() >= least).toPandas().sort_values("pair")  # at most hot_pairs rows
    table = spark.sparkContext.broadcast(
        (hot["pair"].to_numpy(np.int64), hot["docs"].to_numpy(np.int64), hot["best"].to_numpy(bool))
    )

    def look_up(pairs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, (known, _, _) = np.frombuffer(pairs, PAIR).astype(np.int64), table.value
        if not len(known):
            return p, np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        at = np.minimum(np.searchsorted(known, p), len(known) - 1)
        return p, at, known[at] == p

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, total = [], []
            for pairs, times in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                _, at, known = look_up(pairs)
                t, at = np.frombuffer(times, TIMES).astype(np.int64)[known], at[known]
                best.append(int(t[table.value[2][at]].sum()) if len(t) else 0)
                total.append(int((t * table.value[1][at]).sum()) if len(t) else 0)
            kept = [b.column(c) for c in ("tid", "key", "n", *MEASURES, "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                names=["tid", "key", "n", *MEASURES, "groups_sha256", "best", "total"],
            )

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tid, pairs, times in zip(*(b.column(c).to_pylist() for c in ("tid", "pairs", "times"))):
                p, _, known = look_up(pairs)
                if not known.all():
                    p, t = p[~known], np.frombuffer(times, TIMES).astype(np.int64)[~known]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), tid, np.int64)), pa.array(p), pa.array(t)], names=["tid", "pair", "times"]
                    )

    columns = "n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long"
    measured = texts.mapInArrow(frequent, f"tid long, key binary, {columns}")
    rare = texts.select("tid", "pairs", "times").mapInArrow(other, "tid long, pair long, times long")
    rare = rare.join(counts.filter(step() < least), "pair").groupBy("tid")
    rare = rare.agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_total"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    measures = stored(
        measured.join(rare, "tid", "left").select(
            "key", "n", *MEASURES, plus("best", "more_best").alias("n_best"), plus("total", "more_total").alias("count_sum"), "groups_sha256"
        ),
        "alignments",
    )
    total = measures.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * 2000 > F.lit(total)
    keyed = rows.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"))
    found = ["doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256"]
    hot_texts = F.broadcast(measures.filter(often))  # fewer than 2,000 rows
    return (
        keyed.join(hot_texts, "key").select(found).unionByName(
            keyed.join(F.broadcast(measures.filter(often).select("key")), "key", "left_anti").join(measures.filter(~often), "key").select(found)
        )
    )
