"""Best-fit packing of token sequences by a distributed grouping genetic algorithm.

Pieces of equal length are interchangeable, so a packing is a list of bins of lengths. Pieces are
dealt by hash over blocks of bounded size. Each block is solved by several islands, tasks
of their own: a population of packings evolves by a crossover that injects whole well-filled
bins of one parent into the other, removes the bins that hold the same pieces a second time,
and puts the displaced pieces back: some take the places of smaller ones where that fills a loose bin better,
the rest go by best fit. After each round the elite of every island moves to the
next island of its block. The emptiest bins of the solved blocks are then opened again and packed
together one level up, in fewer blocks, until a single block is left.

Only lengths travel through the islands; documents meet their bins by a join on
(block, length, rank).
"""

from __future__ import annotations

import json
import random
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices, stored

# --- tokens and pieces ------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: how the byte-level pre-tokenizer of the file splits text before the merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """ids of whole texts as little-endian 32-bit bytes, as tokenizers gives them for the file.

    Where the file's merges are in the order of their ids (checked when it is loaded), the merge ranks
    are the ids and tiktoken's faster merge loop yields the same ids; a text that holds an added
    (special) token, and any text of another kind of file, is left to tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self.ranked(spec)

    @staticmethod
    def ranked(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
        try:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            merged = [vocab["".join(m)] for m in model["merges"]]
        except KeyError:
            return None
        if any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(ranks):
            return None
        return tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            slow = self.fast is None or any(a in t for a in self.added)
            ids = self.tok.encode(t, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(t)
            out.append(array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes())
        return out


LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col="doc_id", text_col="text"):
    """doc_id, piece, start, length, ids_crc32: a document longer than ``capacity`` is cut into pieces
    of ``capacity`` tokens, the first of which may be shorter. A null text has only the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteEncoder(tokenizer_path)
        for b in slices(batches):
            cols: list[list[int]] = [[], [], [], [], []]
            for i, ids in zip(b.column("doc_id").to_pylist(), tok.batch([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    for c, v in zip(cols, (i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        c.append(v)
                    at, k = at + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


# --- one island -----------------------------------------------------------------------------

Bins = list[list[int]]


def best_fit(sizes: list[int], bins: Bins, capacity: int) -> Bins:
    """Put each size (in the given order) into the fullest bin that holds it, else into a new one.

    Bins are found by residual through a bit mask of the residuals that occur.
    """
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, b in enumerate(bins):
        r = capacity - sum(b)
        by_residual[r].append(i)
        mask |= 1 << r
    mask &= ~1
    for s in sizes:
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            i = by_residual[r].pop()
            if not by_residual[r]:
                mask &= ~(1 << r)
            bins[i].append(s)
            r -= s
        else:
            i, r = len(bins), capacity - s
            bins.append([s])
        by_residual[r].append(i)
        if r:
            mask |= 1 << r
    return bins


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the one whose filling is most uneven (full bins plus loose ones)."""
    return -len(bins), sum(sum(b) ** 2 for b in bins) / (capacity * capacity * max(1, len(bins)))


def crossover(a: Bins, b: Bins, capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """A random share of b's well-filled bins injected into a, no piece twice: the child's bins and the displaced pieces."""
    full = [x for x in b if sum(x) >= capacity - 1] or sorted(b, key=sum)[-max(1, len(b) // 4) :]
    injected = rng.sample(full, rng.randint(1, len(full)))
    doubled = Counter(s for x in injected for s in x)
    child, displaced = [list(x) for x in injected], []
    for x in sorted(a, key=sum):  # loose bins give up their pieces first
        if any(doubled[s] for s in x):
            for s in x:
                if doubled[s]:
                    doubled[s] -= 1
                else:
                    displaced.append(s)
        else:
            child.append(list(x))
    return child, displaced


def mutate(bins: Bins, rng: random.Random) -> tuple[Bins, list[int]]:
    """Open the loosest bins and a few others: the bins left and the pieces of the opened ones."""
    order = sorted(bins, key=sum)
    k = max(1, len(order) // 50)
    opened = order[:k] + rng.sample(order[k:], min(k, len(order) - k))
    gone = {id(x) for x in opened}
    return [x for x in bins if id(x) not in gone], [s for x in opened for s in x]


def fullest(loose: list[int], most: int) -> tuple[int, ...]:
    """One or two of the ascending ``loose`` pieces with the greatest sum up to ``most``."""
    at = bisect_right(loose, most) - 1
    if at < 0:
        return ()
    best, total = (loose[at],), loose[at]
    low, high = 0, at
    while low < high and total < most:
        s = loose[low] + loose[high]
        if s > most:
            high -= 1
        else:
            if s > total:
                best, total = (loose[low], loose[high]), s
            low += 1
    return best


def exchange(bins: Bins, loose: list[int], capacity: int, tried: int = 8) -> list[int]:
    """Put one or two loose pieces for one or two smaller ones of a bin where that fills it better; what is loose then.

    Large loose pieces find no room later, small ones do: each exchange makes a bin fuller and the loose pieces
    smaller. Of a bin with many pieces the ``tried`` largest are considered.
    """
    loose = sorted(loose)
    for x in bins:
        room = capacity - sum(x)
        if not room or not loose:
            continue
        x.sort(reverse=True)
        some = range(min(len(x), tried))
        best, swap = 0, None
        for gone in [(i,) for i in some] + list(combinations(some, 2)):
            out = sum(x[i] for i in gone)
            taken = fullest(loose, out + room)
            if sum(taken) - out > best:
                best, swap = sum(taken) - out, (gone, taken)
                if best == room:
                    break
        if swap:
            gone, taken = swap
            for s in taken:
                del loose[bisect_left(loose, s)]
            for i in reversed(gone):
                insort(loose, x.pop(i))
            x.extend(taken)
    return loose


def offspring(a: Bins, b: Bins, capacity: int, rng: random.Random, bins_tried: int = 48, loose_tried: int = 192) -> Bins:
    """A child of two packings; the exchange looks at a bounded number of the loosest bins and displaced pieces."""
    child, displaced = crossover(a, b, capacity, rng)
    child, opened = mutate(child, rng)
    displaced += opened
    rng.shuffle(displaced)
    some, rest = displaced[:loose_tried], displaced[loose_tried:]
    loosest = [x for x in sorted(child, key=sum) if sum(x) < capacity][:bins_tried]
    rest += exchange(loosest, some, capacity)
    return best_fit(sorted(rest, reverse=True), child, capacity)


def evolve(population: list[Bins], sizes: list[int], capacity: int, generations: int, size: int, seed: int) -> list[Bins]:
    """The population after some generations, best first; an empty one starts from best-fit orders.

    Parents are the better ones of random pairs out of the whole population; a child takes the place of the worst.
    """
    rng = random.Random(seed)
    down = sorted(sizes, reverse=True)
    while len(population) < size:
        order = down if not population else sorted(down, key=lambda s: -s * rng.uniform(0.8, 1.0))
        population.append(best_fit(order, [], capacity))
    least = -(-sum(sizes) // capacity)
    rank = lambda x: fitness(x, capacity)
    population.sort(key=rank, reverse=True)
    chosen = lambda: min(rng.randrange(len(population)), rng.randrange(len(population)))
    for _ in range(generations):
        if len(population[0]) <= least:
            break  # as few bins as the total length allows
        i, j = chosen(), chosen()
        if i == j:
            j = (i + 1) % len(population)
        population[-1] = offspring(population[i], population[j], capacity, rng)
        population.sort(key=rank, reverse=True)
    return population


def to_bytes(bins: Bins) -> bytes:
    """Lengths bin after bin, a 0 behind each bin."""
    return np.array([v for x in bins for v in (*x, 0)], "<u4").tobytes()


def from_bytes(b: bytes) -> Bins:
    out: Bins = [[]]
    for v in np.frombuffer(b, "<u4").tolist():
        if v:
            out[-1].append(v)
        else:
            out.append([])
    return out[:-1]


# --- blocks, islands and levels ------------------------------------------------------------------

ISLAND = "block long, island int, bins long, best binary, population array<binary>, sizes binary"


def _solve(
    items: DataFrame, blocks: int, capacity: int, islands: int, rounds: int, generations: int, size: int, level: int
) -> DataFrame:
    """(block, best): the best packing of each block after all rounds of all its islands."""

    def sizes_of(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.repeat(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "sizes": [flat.astype("<u4").tobytes()]})

    counts = items.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    start = counts.groupBy("block").applyInPandas(sizes_of, "block long, sizes binary")
    state = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.withColumn("population", F.expr("array_repeat(X'', 0)"))

    def island(turn: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for block, isle, sizes, population in zip(pdf["block"], pdf["island"], pdf["sizes"], pdf["population"]):
                lengths = np.frombuffer(sizes, "<u4").tolist()
                seed = zlib.crc32(f"{level} {turn} {block} {isle}".encode())
                got = evolve([from_bytes(p) for p in population], lengths, capacity, generations, size, seed)
                packed = [to_bytes(x) for x in got]
                out.append((block, isle, len(got[0]), packed[0], packed, sizes))
            return pd.DataFrame(out, columns=["block", "island", "bins", "best", "population", "sizes"])

        return step

    for turn in range(rounds):
        # an explicit number of tasks: merged ones would evolve their islands one after the other
        dealt = state.repartition(blocks * islands, "block", "island")
        state = stored(dealt.groupBy("block", "island").applyInPandas(island(turn), ISLAND), f"islands-{level}-{turn}")
        if turn + 1 < rounds:  # the elite of each island takes the worst one's place on the next island
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
            state = state.join(elite, ["block", "island"]).withColumn(
                "population", F.concat(F.slice("population", 1, size - 1), F.array("guest"))
            )
    return state.groupBy("block").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))


PLACES = "block long, length long, rank int, bin long, offset long, open boolean"


def _places(capacity: int, level: int, reopened: int):
    """Rows (length, rank) -> bin and offset of a block's packing; its loosest bins are marked open."""

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        bins = sorted(from_bytes(pdf["best"].iloc[0]), key=sum)
        n_open = min(reopened, sum(sum(x) < capacity for x in bins))
        length = np.array([s for x in bins for s in x], np.int64)
        count = np.array([len(x) for x in bins])
        where = np.repeat(np.arange(len(bins)), count)
        ends = np.cumsum(length)
        begin = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])[:-1]]
        out = pd.DataFrame({
            "block": block, "length": length, "bin": (level << 56) + (block << 24) + where,
            "offset": ends - length - begin[where], "open": where < n_open,
        })
        out["rank"] = out.groupby("length").cumcount() + 1
        return out[["block", "length", "rank", "bin", "offset", "open"]]

    return places


def pack_pieces(
    pieces: DataFrame,
    capacity: int = 1024,
    items_per_block: int = 8192,
    islands: int = 3,
    rounds: int = 2,
    generations: int = 8,
    population: int = 5,
    merge: int = 16,
) -> DataFrame:
    """``pieces`` with sequence_id and offset. Rows of equal (doc_id, piece) are pieces of their own.

    ``pieces`` is read several times: pass a stored table. Sequence ids are negative for pieces that
    fill a sequence alone and positive otherwise.
    """
    reopened = max(1, items_per_block // (8 * merge))  # bins of a block that go one level up, at most
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = stored(pieces.filter(F.col("length") < capacity).withColumn("row", F.monotonically_increasing_id()), "pack-items")
    n = rest.count()
    blocks, level, done = max(1, -(-n // items_per_block)), 0, [whole]
    while True:
        last = blocks == 1
        items = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)))
        best = _solve(items, blocks, capacity, islands, rounds, generations, population, level)

        place = best.groupBy("block").applyInPandas(_places(capacity, level, 0 if last else reopened), PLACES)
        rank = F.row_number().over(Window.partitionBy("block", "length").orderBy("row"))
        placed = stored(items.withColumn("rank", rank).join(place, ["block", "length", "rank"]), f"placed-{level}")
        done.append(
            placed.filter(~F.col("open")).select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")
        )
        if last:
            break
        rest, level = placed.filter("open").select(*pieces.columns, "row"), level + 1
        blocks = -(-blocks // merge)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col="doc_id", text_col="text", **options):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of ``docs``.

    Null and empty texts are one piece with the end id alone. Null ids and repeated rows are packed like
    others. An empty table gives an empty table. Extra columns are not read.
    """
    pieces = stored(cut_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack_pieces(pieces, capacity, **options)
