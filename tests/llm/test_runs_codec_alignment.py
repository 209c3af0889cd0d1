"""Operators 11 to 13 against brute force and the libraries, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest

from stridelake.llm import alignment, piece_codec, runs
from stridelake.llm.queries import LLM_QUERIES, tokenizer_path

from test_llm_operators import edge_rows, prose

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, n long, pairs string, g int, words string, ids string, tid int, best int"
ODD = ["a▁b", " ", "  ", "a ", " a  b ", "\n \n  x\t y ", "　 a\x1c b\x85 c", "z's don't 'll", "a a a a", "\x00 x", "it 's\r\n"]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    loops = [(200 + i, " ".join((prose(i, p).split() * 9)[: 9 * p - 1])) for i, p in enumerate((1, 2, 3, 7, 40))]
    return [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(ODD)] + loops


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 2, "x", "x", 3, 4) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 --------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if i > s and size >= max(least, 2 * q):
                if not any(w[s : s + size - d] == w[s + d : s + size] for d in range(1, q)):
                    out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_array_equals_definition():
    r = np.random.default_rng(3)
    for _ in range(150):
        w = np.unique(r.integers(0, r.integers(1, 5), r.integers(1, 30)), return_inverse=True)[1].tolist()
        n = len(w)
        lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
        assert runs.lyndon_array(w) == [max(j - i for j in range(i + 1, n + 1) if lyndon(w[i:j])) for i in range(n)]
    assert runs.lyndon_array([]) == []


def test_runs_equal_brute_force():
    r = np.random.default_rng(4)
    seen = 0
    for k in range(250):
        least = int(r.choice([2, 5, 12]))
        texts = []
        for _ in range(r.integers(1, 6)):
            n = int(r.integers(0, 90))
            x = [b"%d" % c for c in r.integers(0, r.integers(1, 6), n)]
            if n > 4 and r.random() < 0.6:
                p, a = int(r.integers(1, n // 2 + 1)), int(r.integers(0, n))
                x = [x[a + (i - a) % p] if i >= a and a + p <= n else x[i] for i in range(n)]
            texts.append(x)
        for x, got in zip(texts, runs.runs_of_texts(texts, least)):
            want = brute_runs(x, least)
            assert [tuple(g) for g in got.tolist()] == want
            dropped = {i for s, size, q in want for i in range(s + q, s + size)}
            assert runs.collapse(x, got) == [w for i, w in enumerate(x) if i not in dropped]
            seen += len(want)
    assert seen > 500


def planted(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if i is None else str(i)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def run_row(i, text):
    w = planted(i, text)
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {k for s, size, q in found for k in range(s + q, s + size)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
    milli = best[1] * 1000 // best[2] if found else None
    return i, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)


def test_run_query_equals_brute_force(spark, docs, none, rows, tmp_path):
    more = [(1000 + i, prose(i, 60)) for i in range(150)]
    short = [r for r in rows if len(r[1] or "") < 20_000 or "x" * 100 in r[1]]
    data = spark.createDataFrame(short + more, "doc_id long, text string")
    data.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in LLM_QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    want = [run_row(*r) for r in short + more]
    assert sum(r[1] > 0 for r in want) > 12 and None in [r[0] for r in want]
    assert collections.Counter(got) == collections.Counter(want)
    assert runs.detect_runs(none).count() == 0 and runs.with_periods(none).count() == 0
    few = runs.detect_runs(docs, words_at_once=50).select("doc_id", "runs").collect()
    assert collections.Counter(map(str, few)) == collections.Counter(map(str, runs.detect_runs(docs).select("doc_id", "runs").collect()))


# --- 12 --------------------------------------------------------------------------------------


def test_search_equals_the_library():
    enc = piece_codec.PieceEncoder(B, words_kept=50, pairs_kept=200)  # both memories overflow
    r = np.random.default_rng(6)
    parts = [p.replace("▁", " ") for p in enc.id] + ["\U0001f600", "\x00", "\n", "ﬁ", "▁", "   ", "ꙮ"] * 300
    for _ in range(3000):
        text = "".join(r.choice(parts, r.integers(0, 14)))
        assert piece_codec.listed(enc.encode(enc.sp.normalize(text))) == enc.sp.encode(text)
    for text in ("x" * 20_000, "ab" * 10_000, " " * 3000, "-" * 3000 + "=", "\n" * 500, prose(5, 3000)):
        assert piece_codec.listed(enc.encode(enc.sp.normalize(text))) == enc.sp.encode(text)


def test_search_takes_pieces_back():
    enc = piece_codec.PieceEncoder(B)
    back = 0
    for a, b in [("▁hel", "lo"), ("▁a", "nd"), ("▁s", "chools")]:
        back += not enc.compatible(enc.id[a], enc.id[b]) if b in enc.id else 0
    assert back and enc.compatible(enc.id["▁the"], enc.id["▁and"])
    assert enc.shorter(enc.id["▁the"]) == enc.id["▁th"]


def test_codec_query(spark, docs, none, rows):
    sp = piece_codec.PieceEncoder(B).sp
    got = piece_codec.encode_documents(docs, B).collect()
    want = []
    for i, t in rows:
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        want.append((i, np.array(ids, "<u4").tobytes(), sp.decode(ids)))
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == collections.Counter(want)
    assert piece_codec.encode_documents(none, B).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in LLM_QUERIES["op12_piece_codec"](spark, SF).collect():
        ids = [1, *sp.encode(texts[r["doc_id"]] or ""), 2]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(sp.decode(ids))


# --- 13 --------------------------------------------------------------------------------------


def brute_groups(text):
    """[(A ids, B ids)] between neighbouring common token ends, by the tokenizers on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    table = alignment.Aligner(A, B)

    def groups(t):
        if not t:
            return []
        a, b, raw = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
        x, y = [table.bytes_a[i] for i in a], [table.bytes_b[i] for i in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return []
        x, y = np.cumsum([len(v) for v in x]).tolist(), np.cumsum([len(v) for v in y]).tolist()
        out, ia, ib = [], 0, 0
        for e in sorted(set(x) & set(y)):
            ja, jb = x.index(e) + 1, y.index(e) + 1
            out.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        return out

    return [groups(t) for t in text]


def brute_alignments(rows):
    found = brute_groups([t for _, t in rows])
    count = collections.Counter(p for g in found for p in {(a, b) for x, y in g for a in x for b in y})
    best = collections.defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    for (i, _), g in zip(rows, found):
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(text) if g else "",
        )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark, docs, none, rows):
    rows = [(i, t[:3000] if t else t) for i, t in rows] + [(900 + i, "the same text") for i in range(70)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter(brute_alignments(rows))
    for hot in (500_000, 60, 0):  # all pairs from arrays, some by the join, all by the join
        got = alignment.align_documents(data, A, B, hot_pairs=hot)
        assert got.columns == COLUMNS
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert alignment.align_documents(docs, A, B).count() == docs.count()
    assert alignment.align_documents(none, A, B).count() == 0


def test_alignment_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = collections.Counter(tuple(r) for r in LLM_QUERIES["op13_token_alignment"](spark, SF).collect())
    assert got == collections.Counter(brute_alignments(rows))


def test_equal_texts_are_aligned_once(spark, rows):
    data = spark.createDataFrame(rows + rows, "doc_id long, text string")
    got = alignment.aligned_texts(data, A, B).collect()
    texts = [t or "" for _, t in rows + rows]
    assert {bytes(r["key"]): r["n"] for r in got} == {
        hashlib.sha256(t.encode()).digest(): n for t, n in collections.Counter(texts).items()
    }


def test_chunks_are_forgotten():
    small, large = alignment.Aligner(A, B, chunks_kept=3), alignment.Aligner(A, B)
    texts = [prose(i, 40) for i in range(30)] + ODD
    one = [small.texts([t]) for t in texts]
    sums, groups, _ = large.texts(texts)
    assert [x[1][0] for x in one] == groups and [x[0][0].tolist() for x in one] == sums.tolist()
