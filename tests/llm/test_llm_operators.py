"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import (
    chat, decontaminate, language, near_duplicates, packing, quality, rules, sharding, suffix_tree, tokens,
)
from stridelake.llm.common import words_of
from stridelake.llm.queries import LLM_QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, shard int, node long, n_tokens string"
WORD = "the of and in to was for that with stone river garden window letter morning paper".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORD) + str(r.integers(0, 40)) for _ in range(n))


def edge_rows():
    long = prose(1, 9000)
    copy = prose(2, 120)
    near = copy.replace(copy.split()[7], "changed", 1)
    texts = [
        None, "", " \n\t", "one", "one two three", copy, copy, near, long, long + " end", "x" * 60_000, "éß中文 \U0001f600",
        "a\nb\na\nb\n\n", "12 34 56", "<|endoftext|> <s> </s>", prose(3, 400),
    ]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 0.5, 1, 2, "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, copy, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# --- 1 ---------------------------------------------------------------------------------------


def test_token_counts_equal_whole_texts(spark, edge, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = tokens.count_tokens(edge, tokenizer_path("piece_bpe_32k.model"), chunk_chars=500, overlap_chars=8)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in edge_rows())
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert got.filter("n_chunks > 1").count() > 0
    assert tokens.count_tokens(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_chunks_are_spliced_and_overlaps_widened():
    enc = tokens.ChunkEncoder(tokenizer_path("piece_bpe_32k.model"), 60, 8)
    r = np.random.default_rng(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "\U0001f600", "▁", "zq", " of", " there", "1"]
    widened = 0
    for k in range(200):
        text = "".join(r.choice(parts) for _ in range(r.integers(1, 400)))
        text = text.replace(" ", "") if k % 9 == 0 else text
        n, _, w = enc.count(text)
        assert n == len(enc.sp.encode(text))
        widened += w
    assert widened


# --- 2 ---------------------------------------------------------------------------------------


def test_leaks(spark, edge, none):
    items = [prose(100 + i, 30) for i in range(20)]
    edited = items[3].split()
    edited[5] = "replaced"
    edited.insert(15, "inserted")
    del edited[22]
    half = " ".join(items[6].split()[:8])
    texts = {
        0: prose(7, 200) + " " + items[0] + " " + prose(8, 50), 1: " ".join(edited), 2: prose(9, 500), 3: half, 4: None,
        5: "", 6: items[1].upper() + ". " + items[2].replace(" ", ",  "),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "short one"), (92, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, items_per_block=7).collect()}
    assert got == {(0, 0), (1, 3), (6, 1), (6, 2)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5]
    kept = decontaminate.drop_leaks(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_parts_of_long_items(spark):
    items = [prose(300 + i, n) for i, n in enumerate((200, 59, 38, 200))]
    w = [x.split() for x in items]
    third = [f"other{k}" if k % 6 in (3, 4) and k < 36 or k == 17 else x for k, x in enumerate(w[2])]  # one in three, in pairs
    texts = [w[0][60:150], w[1][:29], third, w[3][100:112]]
    texts = [" ".join([prose(400 + i, 60), *x, prose(500 + i, 60)]) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)}  # twelve words of 200 are no excerpt
    assert all(x < 0.5 for x in got.values())
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()] == [3]


def test_leaks_of_short_and_unspaced_items(spark):
    chinese, thai = "北京的秋天天气很好我们去公园散步看红叶", "วันนี้อากาศดีมากเราไปเดินเล่น"
    items = ["The capital of Peru?", "zebra", chinese, thai, "永遠", "capital of Chile"]
    edited = chinese.replace("公园", "山上")
    texts = ["What is the CAPITAL of peru", f"昨天{edited}很多", f"ก {thai} ข", "zebras of Peru the capital", "zebra", "永 遠", f"the capital of\nPeru {chinese}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 2), (2, 3), (4, 1), (5, 4), (6, 0), (6, 2)}
    assert (got[0, 0]["score"], got[0, 0]["first_word"], got[0, 0]["end_word"]) == (1.0, 2, 6)


def test_alignment_equals_plain_smith_waterman():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                step = decontaminate.MATCH if x == y else decontaminate.MISS
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
        return h.max()

    r = np.random.default_rng(3)
    for _ in range(100):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(-1, 5, r.integers(1, 20))
        assert decontaminate.align(a[None, :], b[None, :])[0][0] == plain(a, b)


# --- 3 ---------------------------------------------------------------------------------------


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    enc, tok = packing.ByteEncoder(path), Tokenizer.from_file(path)
    assert enc.fast is not None
    r = np.random.default_rng(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "\U0001f600", "<|endoftext|>", "'s", "12", "\t", "\0", "!?", " ", "中", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.integers(0, 30))) for _ in range(3000)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.batch(texts) == want


def test_packing(spark, edge, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = edge.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack_documents(docs, path, capacity=64, items_per_block=8, merge=2).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts_of(docs).items()}
    for i, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values("piece")
        assert pieces["piece"].tolist() == list(range(len(pieces)))
        assert pieces["length"].sum() == len(ids[i]) and (pieces["length"].iloc[1:] == 64).all()
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum()[:-1]]
        for s, n, crc in zip(pieces["start"], pieces["length"], pieces["ids_crc32"]):
            assert zlib.crc32(ids[i][s : s + n].tobytes()) == crc
    assert set(got["doc_id"]) == set(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 64 and s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
    assert packing.pack_documents(none, path).count() == 0
    assert packing.pack_documents(edge, path).filter("doc_id is null").count() == 2


def triplets(n, seed):
    """Lengths that fill n bins of 1000 exactly, three a bin: hard for best fit."""
    r = np.random.default_rng(seed)
    a = r.integers(380, 491, n)
    b = np.array([r.integers(250, (1000 - x) // 2 + 1) for x in a])
    return [int(x) for x in np.concatenate([a, b, 1000 - a - b])]


def test_evolution_beats_best_fit(spark):
    for n, seed in ((40, 1), (80, 2), (200, 3)):
        sizes = triplets(n, seed)
        plain = packing.best_fit(sorted(sizes, reverse=True), [], 1000)
        best = packing.evolve([], sizes, 1000, 8, 5, seed)[0]
        assert sorted(s for b in best for s in b) == sorted(sizes) and max(map(sum, best)) <= 1000
        assert len(best) <= n + 0.1 * n < len(plain)
    sizes = triplets(300, 4)
    pieces = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack_pieces(pieces, 1000, items_per_block=300, merge=4).toPandas()
    assert len(got) == 900 and (got.groupby("sequence_id")["length"].sum() <= 1000).all()
    assert got["sequence_id"].nunique() < len(packing.best_fit(sorted(sizes, reverse=True), [], 1000)) - 10


def test_crossover_and_exchange_keep_every_piece_once():
    import random

    for seed in range(60):
        r = random.Random(seed)
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 80))]
        a, b = (packing.best_fit(sorted(sizes, key=lambda s: r.random()), [], 100) for _ in range(2))
        child = packing.offspring(a, b, 100, r, bins_tried=5, loose_tried=9)
        assert sorted(s for x in child for s in x) == sorted(sizes) and max(map(sum, child)) <= 100
        loose = sorted(r.randint(1, 60) for _ in range(12))
        most = r.randint(0, 130)
        got = packing.fullest(loose, most)
        pairs = [0, *(x for x in loose if x <= most), *(x + y for i, x in enumerate(loose) for y in loose[i + 1 :] if x + y <= most)]
        assert sum(got) == max(pairs)


def test_packing_is_close_to_the_bound(spark):
    r = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(1, 600, 3000))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack_pieces(pieces, 1024, items_per_block=500, merge=4).toPandas()
    assert len(got) == 3000 and (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert got["sequence_id"].nunique() <= 1.01 * np.ceil(sum(x[3] for x in rows) / 1024) + 1


# --- 4 ---------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    pairs = collections.Counter((a, b) for ids in of.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    base = prose(50, 100).split()
    r = np.random.default_rng(6)
    for k in range(40):  # a group of near copies, some of them only linked through others
        w = list(base)
        for at in r.choice(len(w), int(r.integers(0, 5)), replace=False):
            w[at] = f"edit{k}"
        rows.append((100_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_a_hub(spark):
    """Copies that are similar to one text only (0.77, among themselves 0.62), far more than a window holds."""
    hub = prose(60, 44)
    added = lambda k: " ".join(f"own{k}at{i}" for i in range(12))
    rows = [(k, f"{hub} {added(k)}") for k in range(2500) if k != 1200] + [(1200, hub)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates.near_duplicates(df).groupBy("component_id").count().collect()
    assert [(x["component_id"], x["count"]) for x in got] == [(0, 2500)]


def test_pieces_return_spanning_links_only():
    """All pairs of a piece are candidates; the links returned are one less than the rows, whatever the pairs."""
    make = near_duplicates.Shingler()
    base = prose(70, 200).split()

    def rows(n, edits):
        texts = [" ".join(base[:k % 190] + [f"x{k}y{e}" for e in range(edits)] + base[k % 190 + edits :]) for k in range(n)]
        sets = [make.shingles(t) for t in texts]
        items = np.empty(2 * n, object)
        items[:] = sets + sets  # two pieces
        sketches = np.stack([np.frombuffer(near_duplicates.sketch(x), np.uint64) for x in sets])
        twice = lambda x: np.concatenate([x, x])
        node = np.arange(n)
        return {
            "piece": np.repeat([5, 9], n), "side": np.zeros(2 * n, int), "tree": twice(np.zeros(n, int)), "node": twice(node),
            "comp": twice(node), "n": twice(np.array([len(x) for x in sets])), "sketch": twice(sketches),
            "keys": np.zeros((2 * n, near_duplicates.TREES), np.uint32), "items": items,
        }

    for n in (40, 120):
        close, far = rows(n, 1), rows(n, 25)
        i, _, _ = near_duplicates.every_pair(close, 0.65)
        a, b = near_duplicates.spanning_links(close, 0.65, 75)
        assert len(i) > n * n / 2 and len(a) == 2 * (n - 1) and (a < b).all()
        assert len(near_duplicates.spanning_links(far, 0.2, 75)[0]) < 2 * n
        close["tree"][:] = 3  # the pairs share an earlier tree's bucket, where they are compared
        assert not len(near_duplicates.every_pair(close, 0.65)[0])
        close["tree"][:], close["comp"][:] = 0, 1
        assert not len(near_duplicates.spanning_links(close, 0.65, 75)[0])


def test_one_of_each_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2), (1, "a b c d e f", 3, 4)], "doc_id long, text string, _gone int, _again int")
    got = near_duplicates.one_of_each(df)
    assert got.columns == df.columns and [r["doc_id"] for r in got.collect()] == [1]


def test_near_duplicates_edges(spark, edge, none):
    got = near_duplicates.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows())
    by = {x["doc_id"]: x for x in got}
    assert [by[i]["component_id"] for i in (0, 1, 2, 5, 6, 7)] == [0, 1, 2, 5, 5, 5]
    assert by[0]["n_shingles"] == 0 and by[3]["n_shingles"] == 1
    assert by[8]["component_id"] == 8 and by[9]["component_id"] == 8
    assert all(x["kept"] and x["component_id"] is None for x in got if x["doc_id"] is None)
    one = near_duplicates.one_of_each(edge)
    assert one.columns == edge.columns
    ids = [x["doc_id"] for x in one.collect()]
    assert ids.count(5) == 1 and not {6, 7, 9} & set(ids) and ids.count(None) == 2
    assert near_duplicates.near_duplicates(none).count() == 0


# --- 5 ---------------------------------------------------------------------------------------


def test_base_scores_equal_brute_force_and_context_helps(spark, documents):
    got = suffix_tree.score_documents(documents).toPandas().set_index("doc_id")
    rows = texts_of(documents)
    toks = {i: [*words_of(t), b""] for i, t in rows.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        assert got.loc[i, "n_tokens"] == len(ws) and got.loc[i, "n_known"] == sum(c[w] > 0 for w in ws)
        assert got.loc[i, "held_out"] == held[i] and got.loc[i, "train_tokens"] == n
        assert abs(got.loc[i, "base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()


def test_next_symbol_distributions_sum_to_one(spark, documents):
    from stridelake.llm.common import id_text, stored

    train = id_text(documents)
    vocab = stored(train.mapInArrow(suffix_tree._token_counts, "word binary, n long").groupBy("word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    n, v = vocab.agg({"n": "sum"}).first()[0], vocab.count()
    tree = suffix_tree.grow(train, vocab, n, v, 2, 1e-4, 1e-5, 2.0, 3, 0.6)
    assert len(tree.orders) == 2 and all(len(o["node"]) for o in tree.orders)
    words = np.arange(len(tree.words))
    rare = 1 - (10**tree.root).sum()  # root mass of all other words and of unknown ones
    for before in ([0, 1], [1, 0], [suffix_tree.START, suffix_tree.RARE], [2, 0], [0, suffix_tree.START]):
        ctx = np.array(before)[:, None].repeat(len(words), 1)
        p = 10 ** tree.walk(words, ctx, tree.root[words])
        free = 10 ** tree.walk(np.array([suffix_tree.RARE]), ctx[:, :1], np.zeros(1))[0]
        assert abs(p.sum() + free * rare - 1) < 1e-9


def test_tables_give_the_scores_of_the_held_tree(spark, documents, edge, none):
    for docs in (documents, edge, edge.unionAll(edge)):
        by = ["doc_id", "score", "n_tokens"]
        held = suffix_tree.score_documents(docs).toPandas().sort_values(by).reset_index(drop=True)
        for shares in ({}, {"word_share": 1e-3, "pair_share": 1e-3}):  # how much the tasks hold changes nothing
            got = suffix_tree.score_documents(docs, held_tokens=0, **shares).toPandas().sort_values(by).reset_index(drop=True)
            assert len(got) == len(held) and (got["n_known"] == held["n_known"]).all()
            for c in ("base_score", "score"):
                assert np.allclose(np.sort(got[c]), np.sort(held[c]), atol=1e-6)
    assert suffix_tree.score_documents(none, held_tokens=0).count() == 0


def test_pairs_and_far_gains_are_shuffled_as_blocks(spark):
    texts = [*(f"a{i % 7} b{i % 11} c{i} a{i % 7}" for i in range(400)), "", None, "x" * 100 + " tail\u00a0one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys, starts = suffix_tree.token_keys(texts)
    tokens = [w for t in texts for w in [*words_of(t), b""]]
    assert len(set(zip(tokens, keys.tolist()))) == len(set(tokens)) == len(set(keys.tolist()))
    assert np.diff(starts).tolist() == [len(words_of(t)) + 1 for t in texts]
    count = collections.Counter(keys.tolist())
    pairs: collections.Counter = collections.Counter()
    for i, j in zip(starts, starts[1:]):
        pairs.update(zip([suffix_tree.BEGIN, *keys[i:j].tolist()], keys[i:j].tolist()))
    known = spark.createDataFrame([(k,) for k, n in count.items() if n >= 3], "key long")
    got = {(r.ctx, r.low): r.n for r in suffix_tree.frequent_pairs(docs, known, 1, 5_000_000, 3).collect()}
    assert got == {p: n for p, n in pairs.items() if n >= 3}
    blocks = docs.mapInArrow(suffix_tree._count_pairs(1, suffix_tree._bitmap(known), 4), suffix_tree.BLOCKS)
    assert blocks.count() <= 3 * 4 < len(got)
    plan = suffix_tree.score_documents(docs, held_tokens=0, word_share=1e-1, pair_share=1e-1)._jdf.queryExecution().toString()
    assert "_gains_by_row" in plan and "Generate explode" not in plan  # no row a looked up key


def test_shuffle_files_go_with_their_query(spark):
    from stridelake.llm.common import shuffles_dropped

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_a_large_corpus_keeps_rare_contexts(spark):
    # 5 million training tokens: the shares alone would ask for 10 occurrences of a word and 5 of a pair
    rows = [(i, "a b " * 250_000) for i in range(1, 12)] + [(100 + i, "seldom seen words") for i in range(4)] + [(200, "words seen seldom")]
    held = F.col("doc_id") >= 200
    got = {r.doc_id: r for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()}
    assert got[1].train_tokens == 11 * 500_001 + 16
    assert got[100].score > got[100].base_score + 10 and abs(got[100].score - got[103].score) < 1e-9
    assert abs(got[200].base_score - got[100].base_score) < 1e-6 and got[200].score < got[100].score - 10


def test_lm_edges(edge, none):
    got = suffix_tree.score_documents(edge).collect()
    assert len(got) == len(edge_rows()) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert suffix_tree.score_documents(none).count() == 0


# --- 6 ---------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and (got["predicted"] == got["quality"]).mean() > 0.95


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.boost(x, y, trees=30)
    want = []
    for row in x:
        total = t.base
        for k in range(len(t.leaf)):
            node = 0
            while node < 2**t.depth - 1:
                node = 2 * node + 1 + int(row[t.feature[k, node]] > t.cut[k, node])
            total += t.leaf[k, node - (2**t.depth - 1)]
        want.append(total)
    assert np.allclose(t.raw(x), want) and ((t.score(x) > 0.5) == y).mean() > 0.9


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(edge, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(edge, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.classify(none, labels).count() == 0


def test_repeated_ids_teach_once(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents.select("doc_id", "text")
    many = docs.crossJoin(spark.range(7)).drop("id")
    keep = docs["doc_id"] >= 0
    a, b = quality.train(docs, labels, keep), quality.train(many, labels, many["doc_id"] >= 0)
    x = np.random.default_rng(1).random((200, len(quality.FEATURES)))
    assert a.score(x).tolist() == b.score(x).tolist()


# --- 7 ---------------------------------------------------------------------------------------


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {j for ps in at.values() if len(ps) > 1 for p in ps for j in range(p, p + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_brute_force(spark, edge, none, documents):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (documents, edge):
        want = collections.Counter((r["doc_id"], *brute_rules(r["text"])) for r in df.collect())
        got = rules.quality_rules(df).collect()
        assert collections.Counter((r["doc_id"], *(r[c] for c in cols)) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert rules.quality_rules(none).count() == 0


def test_fences_adapt_to_the_group(spark):
    table = lambda i: " | ".join(prose(i, 60).split())
    rows = [(i, table(i) if i % 2 else prose(i, 60), "en", "table" if i % 2 else "plain") for i in range(60)]
    rows.append((100, table(100), "en", "plain"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in rules.quality_rules(df, min_rows=20).filter("kept").collect()}
    assert kept == set(range(60))


def test_fences_are_tighter_than_any_constant_in_a_plain_source(spark):
    lines = lambda i, same: "\n".join([prose(1000 * i + k, 6) for k in range(14 - same)] + ["a line"] * same)
    rows = [(i, lines(i, 0), "en", "plain") for i in range(60)]
    rows += [(100, lines(100, 5), "en", "plain"), (101, lines(101, 0) + " " + "#" * 40, "en", "plain")]  # shares 0.29 and 0.08
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = {r["doc_id"]: r for r in rules.text_statistics(df).collect()}
    assert 0.2 < stats[100]["dup_line_share"] < 0.3 and 0.05 < stats[101]["symbol_share"] < 0.1
    got = rules.quality_rules(df, min_rows=20).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(60)) and not any(r["base_failed"] for r in got if r["doc_id"] < 100)


def test_kept_equals_exact_quartiles(spark):
    """Fences from exact quartiles of the group, else of the language, else of all usable documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F_expr("if(doc_id % 9 = 0, null, concat('s', doc_id % 4))")).withColumn("lang", F_expr("if(doc_id % 31 = 0, null, lang)"))
    stats = rules.text_statistics(docs).toPandas()
    usable = stats[~stats["base_failed"]]
    group = lambda df, **key: df[np.logical_and.reduce([df[c].isna() if v is None else df[c] == v for c, v in key.items()])] if key else df
    quartile = lambda x, p: np.sort(x)[max(0, int(np.ceil(p * len(x))) - 1)]
    want = {}
    for r in stats.to_dict("records"):
        lang, source = (v if isinstance(v, str) else None for v in (r["lang"], r["source"]))
        levels = [group(usable, lang=lang, source=source), group(usable, lang=lang)]
        own = next((g for g in levels if len(g) >= 60), usable)
        ok = not r["base_failed"]
        for name, (low, high, spread) in rules.LIMITS.items():
            a, b = quartile(own[name], 0.25), quartile(own[name], 0.75)
            wide = 3 * max(b - a, spread)
            ok = ok and not (low and r[name] < a - wide) and not (high and r[name] > b + wide)
        want[r["doc_id"]] = ok
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs, min_rows=60).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


# --- 8 ---------------------------------------------------------------------------------------


def test_sharding(spark, documents, edge, none):
    hot = spark.range(600).selectExpr("id + 500000 as doc_id", f"'{prose(1, 30)}' as text")
    df = documents.select("doc_id", "text").unionByName(hot)
    got = sharding.shard_documents(df, n_shards=10, rows_per_block=300).toPandas()
    assert len(got) == df.count() and got["shard"].between(0, 9).all()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    load = got.groupby("shard")["size"].sum()
    assert load.max() < 1.05 * load.mean() and load.min() > 0.95 * load.mean()
    text = texts_of(df)
    assert all(zlib.crc32(text[i].encode()) == c and len(text[i].encode()) + 16 == s for i, c, s in zip(got["doc_id"], got["text_crc32"], got["size"]))
    assert sharding.shard_documents(edge).count() == len(edge_rows())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_splits_repeated_rows_and_null_ids(spark):
    for i in ("cast(null as bigint)", "7L"):
        df = spark.range(8000).selectExpr(f"{i} as doc_id", f"'{prose(1, 30)}' as text").repartition(4)
        got = sharding.shard_documents(df, n_shards=8, rows_per_block=3000).toPandas()
        rows = got.groupby("shard").size()
        assert len(rows) == 8 and rows.max() < 1.1 * rows.min() and len(got) == 8000
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_place_units_follows_the_dot_product():
    """Each unit, largest first, goes where its demand times the residual capacity is highest; all three sums end near even."""
    r = np.random.default_rng(11)
    demand = np.stack([r.integers(20, 3000, 600), r.integers(1, 500, 600), r.integers(1, 4, 600)], 1).astype(float)
    shard = sharding.place_units(demand, 10)
    for c, most in ((0, 1.01), (1, 1.25), (2, 1.25)):
        load = np.bincount(shard, weights=demand[:, c], minlength=10)
        assert load.max() < most * load.mean()
    few = np.array([[9.0, 1, 1], [8, 1, 1], [2, 1, 1], [1, 1, 1]])
    assert len({*sharding.place_units(few, 4).tolist()}) == 4


# --- 9 ---------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    pdf = got.toPandas()
    assert len(pdf) > 100 and (pdf["lang"] == pdf["lang_pred"]).mean() > 0.97


def test_viterbi_equals_exhaustive_and_labels_spans(spark):
    r = np.random.default_rng(8)
    model = language.LanguageModel(["a", "b", "c"], np.zeros((language.BUCKETS, 3), np.float32), np.ones((len(language.NAMES), 3), bool), switch=1.5)
    lab = language.Labeller(model)
    lab.rows = r.normal(size=(50, 3)).astype(np.float32)
    texts = [r.integers(0, 50, n) for n in (6, 1, 0, 4)]
    import itertools

    for ids, got in zip(texts, lab.viterbi(texts)):
        cost = lambda p: sum(lab.rows[i, k] for i, k in zip(ids, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023,E731
        best = max(itertools.product(range(3), repeat=len(ids)), key=cost)
        assert abs(cost(best) - cost(got.tolist())) < 1e-4

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = language.train(docs, docs["doc_id"] >= 0)
    by = {x["lang"]: x["text"] for x in docs.filter("lang in ('en', 'fr') and n_chars between 800 and 2000").collect()}
    spans = language.Labeller(m).spans(by["en"] + "\n" + by["fr"])
    assert {s[2] for s in spans} == {"en", "fr"} and spans[0][2] == "en" and spans[-1][2] == "fr"


def test_numerals_are_no_letters(spark):
    docs = [(i, "the river and the garden" if i % 2 else "der fluss und der garten", "en" if i % 2 else "de") for i in range(40)]
    odd = ["½ ²", "① ② ③", "Ⅷ", "12 34", "½the", "²", "²und der fluss³"]
    df = spark.createDataFrame(docs + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    assert [got[100 + i][0] for i in range(7)] == ["und"] * 4 + ["en", "und", "de"]
    assert got[100] == ("und", 0.0) and language.words_in("a½b Ⅷc _d1e") == ["a", "b", "c", "d", "e"]


def test_many_languages_keep_their_numbers():
    k = 300
    model = language.LanguageModel([f"l{i}" for i in range(k)], np.zeros((language.BUCKETS, k), np.float32), np.ones((len(language.NAMES), k), bool))
    lab = language.Labeller(model)
    lab.rows = np.full((3, k), -5, np.float32)
    lab.rows[0, 129], lab.rows[1, 299], lab.rows[2, 7] = 90, 90, 90
    assert [x.tolist() for x in lab.viterbi([np.array([0, 0, 1]), np.array([2]), np.array([], int)])] == [[129, 129, 299], [7], []]


def test_span_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, docs["doc_id"] >= 0)
    by = {x["lang"]: x["text"] for x in docs.filter("lang in ('en', 'fr') and n_chars between 800 and 2000").collect()}
    texts = [(1, by["en"] + "\n" + by["fr"]), (2, None), (3, ""), (4, "12 ½"), (None, by["fr"]), (5, "İ " + by["en"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in language.span_labels(df, model).collect()}
    assert [x[2] for x in (got[1][0], got[1][-1])] == ["en", "fr"] and got[2] == got[3] == got[4] == []
    assert all(a[1] <= b[0] for x in got.values() for a, b in zip(x, x[1:]))
    assert language.span_labels(df.limit(0), model).count() == 0


def test_language_edges(edge, none):
    got = {r["doc_id"]: r for r in language.identify(edge).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 13)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(none).count() == 0


# --- 10 --------------------------------------------------------------------------------------


def brute_chats(rows):
    conv = collections.defaultdict(set)
    for c, *rest in rows:
        conv[c].add(tuple(rest))
    first = lambda x: (x is not None, x if x is not None else 0)
    seq = {c: [x[1:] for x in sorted(v, key=lambda x: tuple(map(first, x)))] for c, v in conv.items()}
    keep = []
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seq.values())
        smaller = any(o == s and (d is not None, ) > (c is not None, ) or (o == s and d is not None and c is not None and d < c) for d, o in seq.items())
        if not longer and not smaller:
            keep.append((c, len(s), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in s)))
    return set(keep)


def test_chats(spark):
    r = np.random.default_rng(9)
    rows = []
    for c in range(60):
        turns = [("user" if k % 2 == 0 else "assistant", f"t{r.integers(0, 2)}") for k in range(r.integers(1, 6))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(100, None, "user", None), (100, 3, None, "x"), (100, 3, "user", "x"), (100, 3, "user", "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df.selectExpr("*", "1 as k", "2 as c")).collect()
    assert {(x["conv_id"], x["n_turns"], x["rendered"]) for x in got} == brute_chats(rows)
    assert sum(x["n_logged"] for x in got) <= 62
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    parts = chat.format_chats(long).orderBy("part").collect()
    want = "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(3000))
    assert len(parts) == 6 and "".join(p["rendered"] for p in parts) == want


# --- all ---------------------------------------------------------------------------------------


def test_names_and_native_plans(spark, edge):
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


def test_native_operators_have_no_python_in_any_stage(spark, edge, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().toString()) or df
    for module in (rules, chat):
        monkeypatch.setattr(module, "stored", lambda df, name="t": plan(df))  # what would be written
    plan(rules.quality_rules(edge))
    plan(chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert len(plans) >= 5 and not [p for p in plans if re.search("Python|Pandas|Arrow|MapPartitions", p)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first and 0 < out.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_on_edge_cases(spark, edge, none):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables, stage by stage."""
    import corpus_pipeline

    names = ["_gone", "found_0", "language_0", "quality_0", "leak_0", "tid", "bucket", "node"]
    docs = edge.select("doc_id", "text", "lang", *[spark_lit(n) for n in names])
    want = {"language": {5, 6, 7, 8}, "quality": set(), "near-duplicates": {0, 1, 2, 3, 5, 8}, "decontamination": {0, 1, 2, 5, 8}}
    never = {"language": {0, 1, 2, 13}, "quality": set(), "near-duplicates": {6, 7, 9}, "decontamination": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        assert want[name] <= ids and not never[name] & ids and len(rows) <= docs.count(), name
        empty = stage(spark, none, SF)
        assert empty.columns == none.columns and empty.count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def spark_lit(name):
    from pyspark.sql import functions as F

    return F.lit(1).alias(name)


def F_expr(sql):  # noqa: N802
    from pyspark.sql import functions as F

    return F.expr(sql)
