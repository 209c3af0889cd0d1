"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and one end mark per text. The root of the tree is the smoothed
unigram distribution over all training tokens. A longer context becomes a node when it and
its next symbols are frequent enough and its next-symbol distribution diverges from that of its
longest kept suffix (count times Kullback-Leibler divergence against a bound). Distributions
are discounted; what the discount frees goes to the suffix's distribution, so each sums to 1.
A token is scored in the longest suffix that is a node.

Size: contexts and (context, next) pairs of ``least`` occurrences and more belong to the model, whatever the
corpus. Up to ``held_tokens`` training tokens the tree is held whole (``Tree``). Of a larger corpus the same
model is a set of distributed tables (``_tables``): n-grams are 64-bit keys, and the score of a text is a
sum over its n-grams of one value each, so it is a lookup and a sum. The tasks hold only the
values of the commonest words (at most ``0.5/word_share``) and n-grams (``2/pair_share``), which saves
shuffling these, and a bitmap of fixed size that tells most n-grams without a value; the keys of all others are dealt to the
tasks that have a range of the values. Pairs to count, keys and gains are shuffled as arrays of a bucket each.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_text, remainder, shuffles_dropped, slices, stored, words_of

END = b""  # no word is empty
RARE = -1
START = -2  # the context before the first token


# --- counts ---------------------------------------------------------------------------------


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    for b in slices(batches):
        for t in b.column("text").to_pylist():
            seen.update(words_of(t))
        seen[END] += b.num_rows
        if len(seen) > 200_000:  # bounded memory: partial counts go to the shuffle
            yield from out()
            seen.clear()
    yield from out()


class Tree:
    """Nodes as sorted arrays: per order the contexts (keys) and the (context, next) pairs."""

    def __init__(self, words: list[bytes], root: np.ndarray, unknown: float):
        self.words, self.root, self.unknown = words, root, unknown
        self.orders: list[dict[str, np.ndarray]] = []
        self.paths: list[np.ndarray] = []  # frequent contexts of each order, from which longer ones are counted

    def base(self) -> int:
        return len(self.words) + 1  # word numbers, and START behind them

    def context_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == START, len(self.words), ids)

    def walk(self, ids: np.ndarray, before: np.ndarray, logp: np.ndarray, upto: int | None = None) -> np.ndarray:
        """log10 probabilities of ``ids`` after the contexts in ``before`` (latest symbol first).

        logp comes in with the root's value (0 for a rare word, whose root value is added later).
        """
        path = np.zeros(len(ids), np.int64)  # number of the context of the order reached, as in self.paths
        live = np.ones(len(ids), bool)
        for k, order in enumerate(self.orders if upto is None else self.orders[:upto]):
            sym = self.context_ids(before[k])
            live &= sym >= 0
            path, live = find(self.paths[k], path * self.base() + sym, live)
            node, at = find(order["node"], path, live)
            pair, hit = find(order["pair"], node * self.base() + ids, at & (ids >= 0))
            lower = logp + order["log_rest"][node]
            logp = np.where(at, np.where(hit, order["logp"][pair], lower), logp)
        return logp


def find(keys: np.ndarray, wanted: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key in the sorted keys (0 where absent) and whether it is there."""
    at, hit = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    look = np.flatnonzero(live) if len(keys) else live[:0]
    if not len(look):
        return at, hit
    if keys[0] == 0 and keys[-1] == len(keys) - 1:  # the keys are the numbers 0, 1, ...
        inside = wanted[look] < len(keys)
        at[look], hit[look] = np.where(inside, wanted[look], 0), inside
        return at, hit
    w = wanted[look]
    i = np.searchsorted(keys, w)
    i[i == len(keys)] = 0
    same = keys[i] == w
    at[look], hit[look] = np.where(same, i, 0), same
    return at, hit


class Reader:
    """Texts as word numbers of the tree."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}

    def read(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All tokens of the texts in one row, their numbers, and where each text starts (and the end)."""
        tokens: list[bytes] = []
        starts = [0]
        for t in texts:
            tokens += words_of(t)
            tokens.append(END)
            starts.append(len(tokens))
        get = self.number.get
        return tokens, np.fromiter([get(w, RARE) for w in tokens], np.int64, len(tokens)), np.array(starts)


def contexts(flat: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each depth the symbol that many places before each token.

    Directly before a text lies START; further back there is no context (RARE).
    """
    within = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
    before = np.full((depth, len(flat)), RARE, np.int64)
    for k in range(depth):
        back = within > k
        before[k, back] = flat[np.flatnonzero(back) - k - 1]
        before[k, within == k] = START
    return before


def _pair_counts(tree: Tree, order: int):
    """(path, next) counts of one order, keys path * base + next; paths are numbered in the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, keys, n = Reader(tree.words), [], np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge():
            nonlocal keys, n, held
            k = np.concatenate([keys, *held])
            w = np.concatenate([n, np.ones(len(k) - len(keys), np.int64)])
            keys, at = np.unique(k, return_inverse=True)
            n, held = np.bincount(at, weights=w, minlength=len(keys)).astype(np.int64), []

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for b in slices(batches):
            _, flat, starts = reader.read(b.column("text").to_pylist())
            before = contexts(flat, starts, order)
            path, live = np.zeros(len(flat), np.int64), flat >= 0
            for k in range(order):
                sym = tree.context_ids(before[k])
                live &= sym >= 0
                path, live = find(tree.paths[k], path * tree.base() + sym, live)
            held.append((path * tree.base() + flat)[live])
            if sum(map(len, held)) > 1_000_000:
                merge()
                if len(keys) > 1_000_000:
                    yield from out()
                    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        merge()
        yield from out()

    return run


def grow(
    docs: DataFrame, vocab: DataFrame, tokens: int, distinct: int, depth: int, word_share: float, pair_share: float,
    divergence: float, least: int, discount: float,
) -> Tree:
    """The tree of the training documents (a table of (doc_id, text))."""
    floor = max(least, int(np.ceil(word_share * tokens)))
    top = vocab.filter(F.col("n") >= floor).toPandas()
    top = top.assign(word=[bytes(w) for w in top["word"]]).sort_values(["n", "word"], ascending=[False, True])
    words, count = top["word"].tolist(), top["n"].to_numpy(np.int64)
    size = tokens + 0.1 * (distinct + 1)
    tree = Tree(words, np.log10((count + 0.1) / size), float(np.log10(0.1 / size)))
    # Every frequent word, and the start of a text, is a context of order 1; its path number is its place here.
    total = np.append(count, docs.count())
    base = tree.base()
    symbols = np.arange(base)  # latest symbol first
    paths, symbol_rows = symbols, symbols[:, None]
    for order in range(1, depth + 1):
        if not len(paths):
            break
        tree.paths.append(paths)
        pairs = docs.mapInArrow(_pair_counts(tree, order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        low = max(least, int(np.ceil(pair_share * tokens)))
        pairs = pairs.filter(F.col("n") >= low).toPandas().sort_values("key")
        key, n = pairs["key"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
        path, nxt = key // base, key % base
        # log10 probabilities of each pair in the context's longest kept suffix (all of lower order)
        rows = symbol_rows[path]
        before = np.where(rows == len(words), START, rows).T
        lower = tree.walk(nxt, before, tree.root[nxt], upto=order - 1)
        own = (n - discount) / total[path]
        rest = 1 - np.bincount(path, weights=own, minlength=len(paths))
        logp = np.log10(own + rest[path] * 10.0**lower)
        share = n / total[path]
        kl = np.bincount(path, weights=share * (np.log(share) - lower * np.log(10)), minlength=len(paths))
        node = np.flatnonzero((kl * total > divergence) & (np.bincount(path, minlength=len(paths)) > 0) & (rest > 0))
        at, inside = find(node, path, np.ones(len(path), bool))
        tree.orders.append({
            "node": node, "log_rest": np.log10(np.append(rest[node], 1.0) if not len(node) else rest[node]),
            "pair": (at * base + nxt)[inside], "logp": logp[inside],
        })
        # Contexts one longer: a frequent pair (older..., newer) read as context, its oldest symbol added last.
        if order < depth:
            longer = _lengthen(symbol_rows, path, nxt, n, paths, base, words)
            paths, symbol_rows, total = longer
    return tree


def _lengthen(rows, path, nxt, n, paths, base, words):
    """Contexts (path, next) as contexts of the next order: keys as ``Tree.walk`` builds them.

    The new context's symbols, latest first, are (next, *symbols of the path). Its key is
    number-of-its-first-``order``-symbols * base + oldest symbol, so it needs the number of
    (next, *all but the oldest); one whose shorter form is no frequent context is left out.
    """
    end = words.index(END) if END in words else -9
    new = np.concatenate([nxt[:, None], rows[path]], axis=1)
    index = {tuple(r): i for i, r in enumerate(rows.tolist())}
    short = np.array([index.get(tuple(r[:-1]), -1) for r in new.tolist()], np.int64)
    ok = (short >= 0) & (nxt != end)
    keys = short * base + new[:, -1] if len(new) else np.zeros(0, np.int64)
    keys, new, n = keys[ok], new[ok], n[ok]
    order = np.argsort(keys, kind="stable")
    return keys[order], new[order], n[order]


# --- the model as tables ----------------------------------------------------------------------

BITS = 27  # of a bitmap: 16 MB, whatever the number of keys
TURNS = (17, 29, 43, 53)  # rotation of the pairs' keys by order
BEGIN = -0x61C8864680B583EB  # key of START


LONG = 64  # bytes of a word that are hashed as numbers
GAP = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
WITHIN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last step of splitmix64: one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(data: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit keys of the words from ``first`` to before ``stop`` in ``data``, which goes on for 8 bytes after the last."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    n = stop - first
    keys = _mixed(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(n <= LONG)
    for at in range(0, LONG, 8):
        if at:
            live = live[n[live] > at]
        keys[live] = _mixed(keys[live] ^ (eights[first[live] + at] & WITHIN[np.minimum(n[live] - at, 8)]))
    for i in np.flatnonzero(n > LONG).tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(data[first[i] : stop[i]], digest_size=8).digest(), "little")
    return keys.view(np.int64)


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens of the texts in one row, and where each text starts (and the end)."""
    coded = [t.encode() if t else b"" for t in texts]
    data = b"\n".join(coded).lower() + b"\n"
    gap = GAP[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    first, stop = edges[::2], edges[1::2]
    upto = np.searchsorted(first, np.cumsum([len(c) + 1 for c in coded]))
    starts = np.append(0, upto + np.arange(1, len(texts) + 1))
    keys = np.full(starts[-1], END_KEY)
    word = np.ones(len(keys), bool)
    word[starts[1:] - 1] = False
    keys[word] = word_keys(data + bytes(8), first, stop)
    return keys, starts


END_KEY = word_keys(bytes(8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]


def turned(keys: np.ndarray, by: int) -> np.ndarray:
    u = keys.view(np.uint64)
    return ((u << np.uint64(by)) | (u >> np.uint64(64 - by))).view(np.int64)


def pairs_of(flat: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each order the keys of context, of the pair one order lower and of the pair, and the last token's place.

    The context of order k and its next symbol share all but their ends: they are two n-grams of k symbols one place
    apart, so the key of the pair is made of theirs.
    """
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[starts[:-1]] = BEGIN
    at, context, low = np.arange(len(flat)), before, flat
    within = at - np.repeat(starts[:-1], np.diff(starts))
    for order in range(1, depth + 1):
        key = context ^ turned(low, TURNS[order - 1])
        yield context, low, key, at
        # one order up: this pair as context of the pair one place on, in the same text
        on = np.flatnonzero(within[at] >= order)
        at, context, low = at[on], key[on - 1], key[on]


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the column ``key``; a key that is not there may be found in it, one that is there always is."""
    words = keys.groupBy(F.expr(f"cast((key & {(1 << BITS) - 1}L) div 64 as int)").alias("i")).agg(
        F.expr("bit_or(shiftleft(1L, cast(key & 63L as int)))").alias("w")
    )
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["i"].to_numpy()] = found["w"].to_numpy()
    return out


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bitmap[(keys & ((1 << BITS) - 1)) >> 6] >> (keys & 63)) & 1 == 1


def _common(table: DataFrame, most: float) -> Column:
    """Whether a row of ``table`` is one of the greatest ``n``, of which there are at most ``most``."""
    step = F.floor(F.log2("n") * 8)
    rows = sorted(table.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    least, held = float("inf"), 0
    for r in rows:
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    return step >= F.lit(least)


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column("word").to_pylist()
        stop = np.cumsum([len(w) for w in words], dtype=np.int64)
        keys = word_keys(b"".join(words) + bytes(8), np.append(0, stop)[: len(words)], stop)
        yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("n")], names=["key", "n"])


BLOCKS = "bucket int, ctx binary, low binary, n binary"


def _count_pairs(order: int, lower: np.ndarray, buckets: int, held: int = 1_500_000):
    """Counts of the pairs of one order of which both n-grams of the order below are in the bitmap.

    Most pairs occur once or twice, and millions of rows of them cost more than their bytes. So a row has the pairs of
    one bucket (a sixteenth of a range of contexts), as arrays sorted by context, which the shuffle's codec shortens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0
        bits = np.uint64(buckets.bit_length())

        def out():
            context, low = (np.concatenate(c) for c in zip(*rows))
            at, n = _counted(_pair_keys(order, context, low))
            context, low = context[at], low[at]
            bucket = _bucket(context ^ (low & (-1 << 60)), buckets)
            by = np.argsort((bucket << (np.uint64(64) - bits)) | (context.view(np.uint64) >> bits))
            bucket, *columns = _blocks(bucket[by], context[by], low[by], n[by].astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, *columns], names=["bucket", "ctx", "low", "n"])

        for b in slices(batches):
            flat, starts = token_keys(b.column("text").to_pylist())
            *_, (context, low, _, _) = pairs_of(flat, starts, order)
            ok = (_marked(lower, context) | (context == BEGIN)) & _marked(lower, low)
            rows.append((context[ok], low[ok]))
            waiting += int(ok.sum())
            if waiting > held:
                yield from out()
                rows, waiting = [], 0
        if waiting:
            yield from out()

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width of the unsigned keys."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _blocks(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The numbers of the buckets, by which the columns are sorted, and the columns as bytes, one block a bucket."""
    bucket = bucket.astype(np.int32)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    blocks = ([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for x in columns)
    return [pa.array(bucket[cuts[:-1]]), *(pa.array(b, pa.binary()) for b in blocks)]


def _pair_keys(order: int, context: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (context ^ turned(low, TURNS[order - 1])).view(np.uint64)


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of the keys, and how often it occurs (``n`` times at each place)."""
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return by[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[by], first)


def _sum_pairs(order: int, least: int):
    """The pairs of ``least`` occurrences and more of the blocks of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [[b"".join(b.column(c).to_pylist()) for c in ("ctx", "low", "n")] for b in batches if b.num_rows]
        if not blocks:
            return
        context, low, n = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*blocks), (np.int64, np.int64, np.int32)))
        at, n = _counted(_pair_keys(order, context, low), n.astype(np.int64))
        at, n = at[n >= least], n[n >= least]
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[some]), pa.array(low[some]), pa.array(n[i : i + 100_000])], names=["ctx", "low", "n"]
            )

    return run


def frequent_pairs(train: DataFrame, known: DataFrame, order: int, tokens: int, least: int) -> DataFrame:
    """(ctx, low, n) of the pairs of one order with ``least`` occurrences and more; ``known`` has the n-grams one order lower."""
    parts = 1 + tokens // 1_000_000  # a task sums at most about a million pairs
    blocks = train.mapInArrow(_count_pairs(order, _bitmap(known.select("key")), max(1000, 4 * parts)), BLOCKS)
    return blocks.repartition(parts, "bucket").mapInArrow(_sum_pairs(order, least), "ctx long, low long, n long")


def _tables(
    train: DataFrame, vocab: DataFrame, tokens: int, size: float, depth: int, divergence: float, least: int, discount: float
) -> tuple[list[DataFrame], float]:
    """Tables (key, n, value) of the n-grams of 1, 2, ... symbols, and the value of a text's start.

    An n-gram's value is what its last symbol gains in the longest context that the n-gram has, over the next
    shorter one, and what the n-gram as a context leaves to others: log10 of it. Words (with their
    ``word``) have only the latter. Summed over a text and added to the score of its words alone, they
    give its score in the longest contexts.
    """
    spark = train.sparkSession
    ten = float(np.log(10))
    begin = spark.createDataFrame([(BEGIN, train.count())], "key long, n long")
    words = stored(vocab.mapInArrow(_word_keys, "key long, n long"), "word-keys")
    root = F.log10((F.col("n") + 0.1) / F.lit(size))
    table = words.select("key", "n", root.alias("lp"), F.lit(0.0).alias("gain"))
    table = table.unionByName(begin.select("key", "n", F.lit(None).cast("double").alias("lp"), F.lit(0.0).alias("gain")))
    out = []
    for order in range(1, depth + 1):
        known = table.filter(F.col("n") >= least)
        pairs = frequent_pairs(train, known, order, tokens, least)
        pairs = stored(pairs.join(known.select(F.col("key").alias("low"), F.col("lp").alias("lower")), "low"), f"pairs-{order}")
        n, total = F.col("n"), F.col("total")
        nodes = (
            pairs.groupBy("ctx")
            .agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("k"), F.sum(n * (F.log(n) - F.col("lower") * ten)).alias("d"))
            .join(known.select(F.col("key").alias("ctx"), n.alias("total")), "ctx")
            .withColumn("rest", 1 - (F.col("s") - F.col("k") * discount) / total)
            .filter((F.col("d") - F.col("s") * F.log(total) > divergence) & (F.col("rest") > 0))
            .select("ctx", "total", "rest")
        )
        nodes = stored(nodes, f"nodes-{order}")
        left = nodes.select(F.col("ctx").alias("key"), F.log10("rest").alias("left"))
        own = table.join(left, "key", "left").filter("gain != 0 or left is not null")
        out.append(own.select("key", "n", (F.col("gain") + F.coalesce("left", F.lit(0.0))).alias("value")))
        if order == 1:
            start = left.filter(F.col("key") == BEGIN).first()
            out = [words.join(left, "key", "left").select("key", "n", F.coalesce("left", F.lit(0.0)).alias("value"))]
        low, turn = F.col("low"), TURNS[order - 1]
        key = F.col("ctx").bitwiseXOR(F.shiftleft(low, turn).bitwiseOR(F.shiftrightunsigned(low, 64 - turn)))
        lp = F.log10((n - discount) / total + F.col("rest") * F.pow(F.lit(10.0), F.col("lower")))
        lp = F.when(total.isNull(), F.col("lower")).otherwise(lp)
        rows = pairs.join(nodes, "ctx", "left").select(key.alias("key"), "n", "lower", "rest", lp.alias("lp"))
        gain = F.coalesce(F.col("lp") - F.col("lower") - F.log10("rest"), F.lit(0.0))
        table = stored(rows.select("key", "n", "lp", gain.alias("gain")), f"order-{order}")
    out.append(table.filter("gain != 0").select("key", "n", F.col("gain").alias("value")))
    return out, start["left"] if start else 0.0


DOC_PARTS = "row long, doc_id long, n_tokens long, n_frequent long, base double, score double"
FAR = "bucket int, keys binary, rows binary, base_gain binary, gain binary"


def _sought(keys: np.ndarray, wanted: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``find``, for long ``keys``: the places are looked for in the order of the wanted keys."""
    look = np.flatnonzero(live)
    look = look[np.argsort(wanted[look])]
    at, hit = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at[look], hit[look] = find(keys, wanted[look], np.ones(len(look), bool))
    return at, hit


def _table_parts(
    words: pd.DataFrame, ngrams: list[pd.DataFrame], valued: np.ndarray, size: float, start: float, buckets: int, held: int = 1_000_000
):
    """Per text the sums over common words and n-grams, other words as unknown ones; and the keys of the others that may have a value.

    The keys come in rows of their own, as blocks of keys and of the rows of their texts.
    """
    names = [f.split()[0] for f in f"{DOC_PARTS}, {FAR}".split(", ")]
    types = [*[pa.int64()] * 4, *[pa.float64()] * 2, pa.int32(), *[pa.binary()] * 4]

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in zip(names, types)], names=names)

    own = words["key"].to_numpy(np.int64)
    root = np.log10((words["n"].to_numpy(np.float64) + 0.1) / size)
    left = words["value"].to_numpy(np.float64)
    unknown = float(np.log10(0.1 / size))
    tops = [(t["key"].to_numpy(np.int64), t["value"].to_numpy(np.float64)) for t in ngrams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, rows = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            by = np.argsort(keys.view(np.uint64))
            bucket, keys, rows = _blocks(_bucket(keys[by], buckets), keys[by], rows[by])
            return batch(len(bucket), bucket=bucket, keys=keys, rows=rows)

        for b in slices(batches):
            flat, starts = token_keys(b.column("text").to_pylist())
            ids, known = _sought(own, flat, np.ones(len(flat), bool))
            base = np.where(known, root[ids], unknown) if len(root) else np.full(len(flat), unknown)
            rare = np.flatnonzero(~known)
            score = base.copy()
            score[known] += left[ids[known]]
            score[starts[:-1]] += start
            far, places = [flat[rare]], [rare]
            for order, ((keys, values), (context, _, key, at)) in enumerate(zip(tops, pairs_of(flat, starts, len(tops))), 1):
                found = _marked(valued, key)
                if order == len(tops) > 1:  # a value is here a gain, and a context that gives gains is in the table too
                    found[found] = _marked(valued, context[found])
                i, hit = _sought(keys, key, found)
                score[at[hit]] += values[i[hit]]
                rest = np.flatnonzero(found & ~hit)
                far.append(key[rest])
                places.append(at[rest])
            sums = [pa.array(np.add.reduceat(x, starts[:-1])) for x in (known.astype(np.int64), base, score)]
            far, places = np.concatenate(far), np.concatenate(places)
            waiting.append((far, row + np.searchsorted(starts, places, side="right") - 1))
            yield batch(
                b.num_rows, row=pa.array(np.arange(row, row + b.num_rows)), doc_id=b.column("doc_id"), n_tokens=pa.array(np.diff(starts)),
                n_frequent=sums[0], base=sums[1], score=sums[2],
            )
            row += b.num_rows
            if sum(len(w[0]) for w in waiting) > held:
                yield out()
        if waiting:
            yield out()

    return run


def _gain_blocks(buckets: int):
    """The gains (key, base_gain, gain) as blocks of the buckets to which the texts' keys go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            table = pa.Table.from_batches(got)
            key, *gains = (table.column(c).to_numpy() for c in ("key", "base_gain", "gain"))
            by = np.argsort(key.view(np.uint64))
            bucket, *columns = _blocks(_bucket(key[by], buckets), key[by], *(g[by] for g in gains))
            columns.insert(1, pa.nulls(len(bucket), pa.binary()))
            yield pa.RecordBatch.from_arrays([bucket, *columns], names=["bucket", "keys", "rows", "base_gain", "gain"])

    return run


ROW_GAINS = "task int, rows binary, base_gain binary, gain binary, known binary"


def _gains_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the texts' keys gain, of whole buckets, summed by the row of the text: a block for each task that read texts."""
    far, others = ([], []), ([], [], [])
    for b in batches:
        for keys, rows, *gains in zip(*(b.column(c).to_pylist() for c in ("keys", "rows", "base_gain", "gain"))):
            for to, x in zip(others if rows is None else far, (keys, *gains) if rows is None else (keys, rows)):
                to.append(x)
    wanted, rows = (np.frombuffer(b"".join(x), np.int64) for x in far)
    keys, base, gain = (np.frombuffer(b"".join(x), t) for x, t in zip(others, (np.int64, np.float64, np.float64)))
    by = np.argsort(keys)
    i, hit = _sought(keys[by], wanted, np.ones(len(wanted), bool))
    if not hit.any():
        return
    i = by[i[hit]]
    rows, *sums = _by_row(rows[hit], base[i], gain[i], (base[i] != 0).astype(np.int64))  # every known word gains
    yield pa.RecordBatch.from_arrays(_blocks(rows >> 40, rows, *sums), names=["task", "rows", "base_gain", "gain", "known"])


def _by_row(rows: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows and the sums of the columns."""
    order = np.argsort(rows)
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return [rows[first], *(np.add.reduceat(c[order], first) for c in columns)]


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of whole tasks as one row a text."""
    blocks = [[b"".join(c.to_pylist()) for c in b.columns[1:]] for b in batches if b.num_rows]
    if not blocks:
        return
    types = np.int64, np.float64, np.float64, np.int64
    columns = _by_row(*(np.frombuffer(b"".join(c), t) for c, t in zip(zip(*blocks), types)))
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["row", "r_base", "r_score", "r_known"])


# --- scores ---------------------------------------------------------------------------------

PARTS = "row long, doc_id long, n_tokens long, n_frequent long, base double, score double, rare array<struct<word:binary,n:long>>"


def _score_parts(tree: Tree):
    """Per text the sums over frequent words and, for the others, the words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, depth = Reader(tree.words), len(tree.orders)
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            tokens, flat, starts = reader.read(b.column("text").to_pylist())
            known = flat >= 0
            root = np.zeros(len(flat))
            root[known] = tree.root[flat[known]]
            logp = tree.walk(flat, contexts(flat, starts, depth), root)
            sums = [np.add.reduceat(x, starts[:-1]) for x in (known.astype(np.int64), root, logp)]
            at = np.flatnonzero(~known)
            cuts = np.searchsorted(at, starts)
            offsets, words, times = [0], [], []
            for i, j in zip(cuts, cuts[1:]):
                c = Counter([tokens[k] for k in at[i:j]])
                words += c.keys()
                times += c.values()
                offsets.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows)), b.column("doc_id"), pa.array(np.diff(starts)),
                    *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                ],
                names=["row", "doc_id", "n_tokens", "n_frequent", "base", "score", "rare"],
            )
            row += b.num_rows

    return run


def score_documents(
    docs: DataFrame,
    held_out: Column | None = None,
    depth: int = 2,
    word_share: float = 2e-6,
    pair_share: float = 1e-6,
    divergence: float = 8.0,
    least: int = 3,
    discount: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_tokens: int = 1_000_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Training rows are those where ``held_out`` (default: crc32 of the id as text, mod 10, is 0) is
    false. A null text is empty and has just its end. Null ids and repeated rows are counted and scored
    like others. With no training token every probability is that of an unknown word. An empty table
    gives an empty table; extra columns are not read.
    """
    held = remainder(F.col("doc_id"), 10) == 0 if held_out is None else held_out
    own = id_text(docs, id_col, text_col)
    train = own.filter(~held)
    none = F.lit(0)
    with shuffles_dropped(docs.sparkSession):
        vocab = stored(
            train.mapInArrow(_token_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"),
            "vocabulary",
        )
        tokens, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        size = tokens + 0.1 * (distinct + 1)
        if tokens <= held_tokens:
            tree = grow(train, vocab, tokens, distinct, depth, 0.0, 0.0, divergence, least, discount)
            parts = stored(own.mapInArrow(_score_parts(tree), PARTS), "score-parts")
            rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("k"))
            chance = F.col("k") * F.log10((F.coalesce("n", none) + 0.1) / F.lit(size))
            looked = rare.join(vocab, "word", "left").select(
                "row", chance.alias("r_base"), chance.alias("r_score"), F.when(F.col("n") > 0, F.col("k")).alias("r_known")
            )
        else:
            (vocab, *ngrams), start = _tables(train, vocab, tokens, size, depth, divergence, least, discount)
            vocab = stored(vocab, "word-values")
            values = stored(functools.reduce(DataFrame.unionByName, [t.withColumn("of", F.lit(i)) for i, t in enumerate(ngrams)]), "values")
            common, usual = _common(values, 2 / pair_share), _common(vocab, 0.5 / word_share)
            top = values.filter(common).toArrow().to_pandas().sort_values("key")
            tops = [top[top["of"] == i] for i in range(len(ngrams))]
            words = vocab.filter(usual).select("key", "n", "value").toArrow().to_pandas().sort_values("key")
            tasks = 1 + tokens // 5_000_000  # of a few million keys each
            buckets = max(1000, 4 * tasks)
            scored = _table_parts(words, tops, _bitmap(values.select("key")), size, start, buckets)
            both = stored(own.mapInArrow(scored, f"{DOC_PARTS}, {FAR}"), "score-parts")
            parts = both.filter("bucket is null").select("row", "doc_id", "n_tokens", "n_frequent", "base", "score")
            # the other words, as what they gain over an unknown one, and the other n-grams
            gain = F.log10((F.col("n") + 0.1) / F.lit(0.1))
            others = vocab.filter(~usual).select("key", gain.alias("base_gain"), (gain + F.col("value")).alias("gain"))
            others = others.unionByName(values.filter(~common).select("key", F.lit(0.0).alias("base_gain"), F.col("value").alias("gain")))
            far = both.filter("bucket is not null").select("bucket", "keys", "rows", "base_gain", "gain")
            far = far.unionByName(others.mapInArrow(_gain_blocks(buckets), FAR)).repartition(tasks, "bucket")
            looked = far.mapInArrow(_gains_by_row, ROW_GAINS).repartition(tasks, "task")
            looked = looked.mapInArrow(_sum_rows, "row long, r_base double, r_score double, r_known long")

    sums = looked.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("r_base", "r_score", "r_known")))
    return parts.drop("rare").join(sums, "row", "left").select(
        "doc_id", held.alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce("r_known", none)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("r_score", none)).alias("score"),
    )
