"""Near-duplicate detection with an LSH forest of MinHash signatures.

1. Each text becomes its set of 5-word shingles (64-bit hashes) and a signature. Equal sets form one
   class; only classes are compared.
2. Every tree of the forest is one sort order of the classes by a part of the signature. Classes whose first
   ``min_depth`` minima agree in a tree share a bucket; only buckets of two or more are kept.
3. First scan: in each order a class looks at the next ``window`` rows of its bucket, and the nearest by estimated
   similarity is a candidate; the full sets confirm or reject them, best candidate of each class first. This joins
   most of a group cheaply and decides nothing else.
4. Second scan: within every bucket all pairs of classes of different components are compared, however many
   rows the bucket has. Large buckets are cut into blocks, and each pair of blocks is one piece of work; pairs of blocks
   of the same component are left out. Sketches mark the rows that have a candidate in their piece; these rows come
   once more with their full sets, and pairs are confirmed inside the piece, the likeliest first. A piece
   joins its components as it goes and returns only links that join two of them, at most one less than it
   has rows: nothing grows with the pairs but the comparisons. A pair that shares buckets in several trees is
   compared in the first of them alone. All pairs found are confirmed or lie in one component by then, so
   nothing is left that a further scan could find.

Links are facts (full sets decide). Candidates are confirmed from an estimate of the threshold less
``slack`` on; the sketch's standard error at 0.75 is at most 0.025, so 0.1 is 4 of them. A pair at exactly 0.75 is missed by all 12 trees of depth 2
with probability 0.4375 ** 12 = 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_text, slices, stored, words_of

SHINGLE = 5
TREES, DEPTH = 12, 8
FUNCTIONS = TREES * DEPTH
BIN_BITS = 9
BINS = 1 << BIN_BITS
_SEEDS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- sets and signatures ----------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles; word hashes are kept in a bounded cache."""

    def __init__(self, cache_words: int = 200_000):
        self.cache: dict[bytes, int] = {}
        self.limit = cache_words

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        out = [cache.get(w) for w in words]
        for i, h in enumerate(out):
            if h is None:
                out[i] = cache[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(out, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes: 5-word shingles, or the whole sequence of fewer words as one."""
        h = self.word_hashes(words_of(text))
        n = min(SHINGLE, len(h))
        if not n:
            return h
        key = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            key = _mixed(key * _STEP + h[k : len(h) - n + 1 + k])
        return np.unique(key)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the FUNCTIONS minima."""
    least = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):  # bounded memory for very long texts
        part = shingles[None, at : at + 2048] * _SEEDS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2")


def sketch(shingles: np.ndarray) -> bytes:
    """Least hash of each of BINS equal ranges of hashes, as 2 bits: 0 for an empty range, else 1 to 3.

    Two planes of BINS bits each. A small set has nearly every hash alone in its range, so estimates of small sets are nearly exact.
    """
    spread = np.sort(_mixed(shingles ^ _STEP))
    at, first = np.unique(spread >> np.uint64(64 - BIN_BITS), return_index=True)
    value = (_mixed(spread[first]) % np.uint64(3)).astype(np.uint8) + 1
    planes = np.zeros((2, BINS), np.uint8)
    planes[0, at] = value >> 1
    planes[1, at] = value & 1
    return np.packbits(planes, axis=1).tobytes()


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of each pair of rows of two arrays of sketches (uint64, the planes one after the other).

    Of the ranges that either set reaches, the share in which both have the same least hash; of unequal
    least hashes a third agree by chance, which is taken off.
    """
    half = x.shape[1] // 2
    held_x, held_y = x[:, :half] | x[:, half:], y[:, :half] | y[:, half:]
    differ = x ^ y
    count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    both = count(held_x & held_y)
    agree = count(held_x & held_y & ~(differ[:, :half] | differ[:, half:]))
    return np.maximum(0, (agree - both / 3) * 1.5) / np.maximum(1, count(held_x | held_y))


SETS = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, sketch binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Shingler()
    for b in slices(batches):
        n, f1, f2, sig, sk = [], [], [], [], []
        for t in b.column("text").to_pylist():
            s = make.shingles(t)
            n.append(len(s))
            f1.append(xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) if len(s) else None)
            f2.append(xxhash.xxh64_intdigest(s.tobytes(), 2) - (1 << 63) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
            sk.append(sketch(s) if len(s) else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array(c, k) for c, k in zip((n, f1, f2, sig, sk), kinds)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_shingles", "f1", "f2", "sig", "sketch"])


# --- candidates from the forest --------------------------------------------------------------------

BLOCK = 256
PLACES = "tree short, prefix binary, bucket long, node long"
PAIRS = "a long, b long, est float"


def _places(nodes: DataFrame, min_depth: int) -> DataFrame:
    """One row per class and tree in which another class shares its bucket: tree, prefix, bucket, node, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u2").reshape(-1, FUNCTIONS)
            for t in range(TREES):
                own = np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH])
                bucket = np.full(len(own), np.uint64(t + 1))
                for k in range(min_depth):  # two buckets under one number only cost comparisons
                    bucket = _mixed(bucket * _STEP + own[:, k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t), pa.int16()), pa.array([r.tobytes() for r in own], pa.binary()), pa.array(bucket.view(np.int64)), b.column("node")],
                    names=["tree", "prefix", "bucket", "node"],
                )

    every = nodes.select("sig", "node").mapInArrow(run, PLACES)
    shared = every.groupBy("bucket").count().filter("count > 1").select("bucket")
    size = 2 * DEPTH  # bytes of a tree's minima
    keys = F.concat(*[F.substring("sig", t * size + 1, 2 * min_depth) for t in range(TREES)]).alias("keys")
    return stored(every.join(shared, "bucket").join(nodes.select("node", "n", "sketch", keys), "node"), "forest")


def _similar_size(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    size_i, size_j = rows["n"][i], rows["n"][j]
    return 4 * np.minimum(size_i, size_j) >= 3 * np.maximum(size_i, size_j)


def nearest(rows: dict[str, np.ndarray], new: int, window: int, least: float):
    """(a, b, estimate) of the nearest later row within the window and bucket of each row.

    rows: columns in sort order; the first len - ``new`` rows came before and only look at new ones.
    """
    n = len(rows["node"])
    est = np.zeros((n, window), np.float32)
    for s in range(1, min(window, n - 1) + 1):
        i = np.arange(max(0, n - new - s), n - s)
        j = i + s
        ok = (rows["bucket"][i] == rows["bucket"][j]) & _similar_size(rows, i, j)
        i, j = i[ok], j[ok]
        if len(i):
            est[i, s - 1] = estimates(rows["sketch"][i], rows["sketch"][j])
    best = est.argmax(axis=1)
    value = est[np.arange(n), best]
    hit = np.flatnonzero(value >= least)
    a, b = rows["node"][hit], rows["node"][hit + 1 + best[hit]]
    return np.minimum(a, b), np.maximum(a, b), value[hit]


def every_pair(rows: dict[str, np.ndarray], least: float):
    """(i, j, estimate) of the pairs of rows of one piece that lie in different components, on both sides if the
    piece has two, and share no earlier tree's bucket."""
    n = len(rows["node"])
    end = np.searchsorted(rows["piece"], rows["piece"], side="right")  # sorted by piece
    earlier = np.arange(TREES)[None, :]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    i = np.arange(n)
    for s in range(1, n):
        i = i[i + s < end[i]]
        if not len(i):
            break
        ok = (rows["comp"][i] != rows["comp"][i + s]) & ((rows["side"][i] == 0) | (rows["side"][i] != rows["side"][i + s]))
        x = i[ok & _similar_size(rows, i, i + s)]
        if len(x):
            x = x[~((rows["keys"][x] == rows["keys"][x + s]) & (earlier < rows["tree"][x][:, None])).any(axis=1)]
            e = estimates(rows["sketch"][x], rows["sketch"][x + s])
            out.append((x[e >= least], x[e >= least] + s, e[e >= least].astype(np.float32)))
    return tuple(np.concatenate(c) for c in zip(*out))


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def spanning_links(rows: dict[str, np.ndarray], least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: confirmed links that join all components of each piece that links of its pairs join."""
    i, j, est = every_pair(rows, least)
    top: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    piece, comp, node, items = rows["piece"].tolist(), rows["comp"].tolist(), rows["node"], rows["items"]
    a, b = [], []
    for k in np.argsort(-est, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        u, v = find((piece[x], comp[x])), find((piece[y], comp[y]))
        if u != v and similar(items[x], items[y], percent):
            top[u] = v
            a.append(node[x])
            b.append(node[y])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    binary = {"sketch": (np.uint64, 2 * BINS // 64), "keys": (np.uint32, TREES)}
    out = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c not in binary and c != "items"}
    for c, (kind, width) in binary.items():
        if c in b.schema.names:
            out[c] = np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1)
            assert c != "sketch" or out[c].shape[1] == width
    if "items" in b.schema.names:
        out["items"] = np.empty(b.num_rows, object)
        out["items"][:] = [np.frombuffer(x, np.uint64) for x in b.column("items").to_pylist()]
    return out


def _piecewise(work, batches: Iterator[pa.RecordBatch], rows: int) -> Iterator:
    """``work`` of the columns of whole pieces; batches are sorted by piece."""
    held = None
    for b in slices(batches, rows):
        new = _columns(b)
        new = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        cut = int(np.searchsorted(new["piece"], new["piece"][-1]))  # the last piece may go on
        if cut:
            yield work({c: v[:cut] for c, v in new.items()})
        held = {c: v[cut:] for c, v in new.items()}
    if held is not None:
        yield work(held)


def _pair_batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float32()))], names=["a", "b", "est"])


def neighbours(places: DataFrame, window: int, least: float) -> DataFrame:
    """Distinct (a, b, est), a < b: the nearest row of each in its window. Windows end with their partition; ``pieces`` needs none of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches, 4096):
            new = _columns(b)
            joined = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            # rows of the previous slice look again: their window was cut at its end
            yield _pair_batch(nearest(joined, b.num_rows, window, least))
            held = {c: x[-window:] for c, x in joined.items()}

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "prefix", "node"]
    rows = places.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("bucket", "node", "n", "sketch")
    return rows.mapInArrow(run, PAIRS).groupBy("a", "b").agg(F.max("est").alias("est"))


PIECES = "piece long, side int, tree short, node long, comp long, n long, sketch binary, keys binary"


def pieces(places: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, dealt out as pieces of bounded size.

    The rows of a bucket are cut into blocks of about BLOCK rows; a component with more rows than that in the bucket has blocks
    of its own, which are not compared with one another. Each pair of blocks is a piece, dealt out by itself.
    """
    columns = ["bucket", "tree", "node", "n", "sketch", "keys"]
    rows = stored(places.join(comp, "node", "left").select(*columns, F.coalesce("comp", "node").alias("comp")), "forest-rows")
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("held"))
    mixed = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("bucket")
    large = F.col("held") > BLOCK
    counts = counts.join(mixed, "bucket").select("bucket", "comp", "held", large.alias("large"), F.when(large, F.col("comp")).otherwise(0).alias("own"))
    counts = stored(counts, "bucket-components")
    sizes = counts.groupBy("bucket", "large", "own").agg(F.ceil(F.sum("held") / BLOCK).cast("long").alias("blocks"))
    block = ["bucket", "large", "own", "block"]
    blocks = sizes.select("bucket", "large", "own", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")).alias("block"))
    x, y = (blocks.select("bucket", F.struct("large", "own", "block").alias(c)) for c in "xy")
    same = F.col("x.large") & F.col("y.large") & (F.col("x.own") == F.col("y.own"))
    pairs = x.join(y, "bucket").filter((F.col("x") <= F.col("y")) & ~same)
    pairs = pairs.select("bucket", F.xxhash64("bucket", "x", "y").alias("piece"), "x", "y")
    alone = pairs.filter("x = y").select("bucket", "piece", F.lit(0).alias("side"), "x.*")
    ends = [pairs.filter("x <> y").select("bucket", "piece", F.lit(k + 1).alias("side"), f"{c}.*") for k, c in enumerate("xy")]
    of_piece = alone.unionByName(ends[0]).unionByName(ends[1])
    rows = rows.join(counts.join(sizes, ["bucket", "large", "own"]).drop("held"), ["bucket", "comp"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks") + 1).join(of_piece, block)
    return rows.select("piece", "side", "tree", "node", "comp", "n", "sketch", "keys")


def promising(dealt: DataFrame, least: float) -> DataFrame:
    """The rows that have a candidate in their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            i, j, _ = every_pair(rows, least)
            at = np.union1d(i, j)
            plain = [("piece", pa.int64()), ("side", pa.int32()), ("tree", pa.int16()), ("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64())]
            data = [pa.array(rows[c][at], t) for c, t in plain]
            data += [pa.array([x.tobytes() for x in rows[c][at]], pa.binary()) for c in ("sketch", "keys")]
            return pa.RecordBatch.from_arrays(data, names=[c for c, _ in plain] + ["sketch", "keys"])

        yield from _piecewise(marked, batches, 4096)

    return dealt.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, PIECES)


def linked(rows: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b): links that join what the pairs within each piece join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = spanning_links(rows, least, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        yield from _piecewise(joined, batches, 256)

    dealt = rows.join(sets.select("node", "items"), "node").repartition("piece").sortWithinPartitions("piece")
    return stored(dealt.mapInArrow(run, "a long, b long"), "links")


# --- confirmation and components ------------------------------------------------------------------


def _id_bits(nodes: DataFrame, bits: int = 1 << 23) -> tuple[int, dict[int, bytes]]:
    """Bitmap of hashed ids: a filter of fixed size (1 MB) that lets through every id of ``nodes``."""
    h = F.pmod(F.xxhash64("node"), F.lit(bits))
    rows = nodes.select(F.bitmap_bucket_number(h).alias("k"), F.bitmap_bit_position(h).alias("p"))
    return bits, {r["k"]: bytes(r["m"]) for r in rows.groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()}


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, f1, f2, items): the whole shingle set of each node, made anew from the texts."""
    bits, maps = _id_bits(nodes)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    own = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.bitmap_bucket_number(h).alias("k"), F.bitmap_bit_position(h).alias("p")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for b in slices(batches):
            ks, ps = b.column("k").to_pylist(), b.column("p").to_pylist()
            at = [i for i, (k, p) in enumerate(zip(ks, ps)) if k in maps and maps[k][p >> 3] >> (p & 7) & 1]
            b = b.take(pa.array(at, pa.int64()))
            sets = [make.shingles(t) for t in b.column("text").to_pylist()]
            fs = [pa.array([xxhash.xxh64_intdigest(s.tobytes(), i) - (1 << 63) for s in sets], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *fs, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "f1", "f2", "items"]
            )

    made = own.mapInArrow(run, "node long, f1 long, f2 long, items binary")
    return stored(made.join(nodes.select("node", "f1", "f2"), ["node", "f1", "f2"], "left_semi").dropDuplicates(["node", "f1", "f2"]), "full-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    x, y = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return stored(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the links, comp the smallest node reachable.

    Alternating star contraction: each node points at the smallest id around it until
    nothing changes; a logarithmic number of rounds whatever the shape.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "stars")
    shape = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    while (now := shape(edges)) != before:
        before = now
        # large star: neighbours above u go to the smallest id around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "stars")
    comp = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comp.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    window: int = 16,
    min_depth: int = 2,
    slack: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Texts without a word (null ones too) have an empty set, are linked with nothing and are their
    own component. Rows without an id are linked with nothing, have no component and are kept. Rows
    that repeat an id and text share everything, so all of them are kept or none is. An empty
    table gives an empty table; extra columns are not read.
    """
    own = id_text(docs, id_col, text_col)
    sets = stored(own.mapInArrow(_signed, SETS), "shingle-sets")
    usable = sets.filter(F.col("doc_id").isNotNull() & F.col("f1").isNotNull())
    classes = stored(
        usable.groupBy("f1", "f2").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("members")
        ), "classes",
    )
    spark = docs.sparkSession
    least = percent / 100 - slack

    places = _places(classes, min_depth)
    comp = spark.createDataFrame([], "node long, comp long")
    todo = stored(neighbours(places, window, least), "candidates")
    near = _ends(todo)
    whole = _full_sets(own, classes.join(near, "node", "left_semi"))
    if not todo.isEmpty():
        # the best candidate of each class first: these links join most of a group
        ranked = F.struct(F.col("est"), -F.col("a"), -F.col("b"))
        ends = todo.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", ranked.alias("rank"))
        best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), "rank").alias("p")).select("p.a", "p.b").distinct()
        best = stored(best, "best-candidates")
        comp = _joined(comp, _confirmed(best, whole, percent))
        rest = todo.select("a", "b").join(best, ["a", "b"], "left_anti")
        comp = _joined(comp, _confirmed(_between(rest, comp), whole, percent))
    rows = stored(promising(pieces(places, comp), least), "promising")
    more = stored(rows.select("node").distinct().join(near, "node", "left_anti"), "near-classes")
    if not more.isEmpty():
        whole = whole.unionByName(_full_sets(own, classes.join(more, "node", "left_semi")))
    comp = _joined(comp, linked(rows, whole, least, percent))

    copies = classes.filter("members > 1").select("f1", "f2", F.col("node").alias("first_id"))
    rows = sets.drop("sig", "sketch").join(copies, ["f1", "f2"], "left").withColumn("node", F.coalesce("first_id", "doc_id"))
    alone = F.col("f1").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("comp", "node"))
    out = rows.join(comp, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links; the earlier ones count as links of each node to its component."""
    if links.isEmpty():
        return comp
    return stored(components(links.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "components")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    here = lambda c: F.coalesce(f"c{c}", c)
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(here("a") != here("b")).select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns stay.

    Of rows that repeat an id whose document stays, one remains. Rows without an id stay.
    """
    found = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "near-duplicates")
    own = free_name(docs, "found")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct()
    # the same plan at every size: whole rows are dealt out by id once, as they are once the ids are many
    out = docs.join(gone.hint("merge"), docs[id_col].cast("long") == F.col(own), "left_anti")
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    again = repeated.select(F.col("doc_id").alias(own))
    key = out[id_col].cast("long") == F.col(own)
    return out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates([id_col]))
