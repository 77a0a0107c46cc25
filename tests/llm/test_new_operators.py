"""Alignment, nearest neighbours and periodic runs against brute-force versions, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tilewright.llm import alignment, neighbours, periodic_runs
from tilewright.llm.bpe import byte_alphabet

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", "the", "tion", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "▁", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "\x00", "\r", "　", "1", "23", "!?", "😀", "ﬁ", "é", "﻿", "A", "===="]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


# alignment
def plain_alignment(texts):
    """Per text: A ids, B ids, groups, links; by offsets and sets."""
    tok, sp = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    tok.encode_special_tokens = True
    back = {c: b for b, c in byte_alphabet().items()}
    out = []
    for t in texts:
        a, b = ([], []) if not t else (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t))
        as_bytes = [bytes(back[c] for c in tok.id_to_token(i)) for i in a], [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or any(b"".join(x) != (" " + t).encode() for x in as_bytes):
            a, b, as_bytes = [], [], ([], [])
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in as_bytes]
        links = [(i, k) for i, e in zip(a, ends[0], strict=True) for k, f in (zip(b, ends[1], strict=True) if len(a) < 50 else [(b[ends[1].index(e)], e)] if e in ends[1] else []) if e == f]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ni, nj = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
            i, j = ni, nj
        out.append((len(a), len(b), groups, links))
    return out


def plain_profile(ids, texts):
    aligned = plain_alignment(texts)
    count = Counter(x for *_, links in aligned for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, na, nb, len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), digest(";".join(g)) if g else "") for i, (na, nb, g, x) in zip(ids, aligned, strict=True)]


def test_alignment(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += [None, "", " ", "\n", " \n", "\n ", "a\n", "word " * 900, "x" * 3000, "same text", "same text"]
    ids = [None if i == 7 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_a int, pair string").repartition(5)
    key = lambda r: tuple(str(x) for x in r)
    for chars in (500, alignment.BLOCK_CHARS):
        got = alignment.link_profile(docs, BYTE, PIECE, block_chars=chars)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_profile(ids, texts), key=key)
    assert alignment.link_profile(docs.where("false"), BYTE, PIECE).count() == 0


def test_alignment_lists(spark):
    texts = ["The alignment of tokens", None, "a▁b", "  two  blanks\n"]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE, PIECE).collect()}
    for i, (n_a, n_b, groups, links) in enumerate(plain_alignment(texts)):
        r = got[i]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["a_ends"])) == (n_a, n_b, len(groups))
        assert [(r["a_ids"][x], r["b_ids"][y]) for x, y in zip(r["a_ends"], r["b_ends"], strict=True)] == links


def test_piece_model_that_reaches_over_blanks():
    """The parts are used only where no piece holds a blank after something else."""
    m = alignment.PieceModel(PIECE)
    assert m.parts.findall(" a  b\nc ") == [" a", "  b", "\nc", " "]
    assert m.encode_batch(["a▁b", "", "ok"])[0] is None and m.encode_batch([""]) == [m.before and np.array(m.before, "<u4").tobytes()]


# nearest neighbours
def plain_nearest(rows, queries, k):
    """Rows (id, vector); every query against every row, one pair at a time."""
    fit = lambda v: v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in queries:
        if q is None or not fit(v):
            continue
        found = [(-float(neighbours.cosines(np.array([v], float), np.array([x], float))[0]), i) for i, x in rows if i is not None and i != q and fit(x)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(900, 1400)]  # a third of all rows are equal
    rows += [(i, [0.5 * x for x in (1, 2, 3, 4, 5, 6, 7, 8)]) for i in range(1400, 1410)]
    rows += [(3, rng.normal(size=8).tolist()), (3, rows[3][1]), (950, rows[950][1])]  # repeated ids
    rows += [(None, [1.0] * 8), (2000, None), (2001, [0.0] * 8), (2002, [1.0, None, *[1.0] * 6]), (2003, [float("nan")] * 8), (2004, [float("inf"), *[1.0] * 7]), (2005, [1.0, 2.0]), (2050, [0.0] * 8)]
    return rows


def test_neighbours_exact(spark, vectors):
    """Factor 1 gives the result of comparing all pairs, with one shard and with many, equal rows split over several."""
    schema = "vec_id long, embedding array<double>, shard string, v int"
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], schema).repartition(4)
    queries = [r for r in vectors if r[0] is None or r[0] % 50 == 0 or r[0] == 3]
    asked = spark.createDataFrame([(*r, "x", 1) for r in queries], schema)
    want = plain_nearest(vectors, queries, 5)
    for how in ({}, {"shard_bytes": 64 * 70, "sample_bytes": 64 * 300}):
        got = sorted(tuple(r) for r in neighbours.nearest(df, asked, factor=1.0, **how).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == [w[3] for w in want]


def test_neighbours_recall(spark):
    """Without any structure, in 64 dimensions, the hardest case: at least 0.9, and five rows for each query."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), shard_bytes=64 * 8 * 400).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit[::50] @ unit.T
    s[np.arange(120), np.arange(0, 6000, 50)] = -2
    true = {(50 * q, int(i)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for i in row}
    assert len(got) == 600 and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) / 600 >= 0.9


def test_neighbours_small(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 2.0])], schema)
    assert [tuple(r) for r in neighbours.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 0.0), (0, 2, 1, -1.0)]
    assert neighbours.nearest(few.where("false"), few).count() == 0
    assert neighbours.nearest(few, few.where("false")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, None)], schema), few).count() == 0


# periodic runs
def plain_runs(w, least):
    """By period: maximal stretches whose words equal those a period later, and no smaller period."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size = i + p - s
            if size >= max(least, 2 * p) and not any(w[s : s + size - q] == w[s + q : s + size] for q in range(1, p)):
                out.append((s, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_word_runs():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 8, 30])
        w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 6)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)] + [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(0, 20))]
        least = rng.choice([2, 4, 5, 12])
        assert [tuple(r) for r in periodic_runs.word_runs(w, least).tolist()] == plain_runs(w, least)


def test_long_run():
    w = [b"a", b"b", b"c"] * 30_000
    assert periodic_runs.word_runs(w).tolist() == [[0, 90_000, 3]]


def plain_query(doc_id, text):
    w = "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é", "word"]) + rng.choice([" ", "\n", "  ", "\t", "\x0b", "\r\n", "\x0c"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n ", "one", "a　b\xa0c\x85d " * 20, "\x1c x " * 30, "w " * 9000, "same " * 20, "same " * 20]
    rows = [(None if i == 5 else i // 2, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(3)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    key = lambda r: tuple(str(x) for x in r)
    got = periodic_runs.query(spark, f"file://{tmp_path}")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_query(r[0], r[1]) for r in rows), key=key)
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns
    by_text = {r["text"] for r in kept.where("doc_id >= 150").collect()}
    assert {None, "", " \n ", "one", "w", "same"} <= by_text
    assert periodic_runs.find_runs(docs.where("false")).count() == 0 and periodic_runs.collapse_runs(docs.where("false")).count() == 0


def test_darts_of_a_batch_are_bounded():
    """What is thrown together stays small, and a signature doesn't depend on it."""
    import tracemalloc

    from tilewright.llm import near_dedup

    n = near_dedup.SIGNED
    elements = np.random.default_rng(1).integers(0, 1 << 63, near_dedup.SIGNED_CHARS // 5, dtype=np.uint64)
    doc, k = np.sort(np.arange(len(elements)) % n), near_dedup.BANDS * near_dedup.ROWS
    tracemalloc.start()
    whole = near_dedup.dart_signatures(elements, np.ones(len(elements)), doc, n, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    some = doc == 3
    assert np.array_equal(near_dedup.dart_signatures(elements[some], np.ones(some.sum()), np.zeros(some.sum(), int), 1, k)[0], whole[3])
