"""Each operator against a brute-force version, and its defined cases."""

import base64
import gzip
import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from tilewright.llm import bpe, chat, decontaminate, fingerprint, language_id, line_dedup, near_dedup, token_counts, token_store, warc
from tilewright.llm.common import Shingler, new_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "é ß Ω ς Σίσυφος", "a" * 700, "x<|endoftext|>y <|startoftext|>", "\x1c\x1d a\x85b\xa0c", "日本語 text", "don't 'STOP' 12³ ½", "don't 'STOP' 12³ ½", "🙂" * 300, "w " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a repeated id, a null id and extra columns of clashing names."""
    rows = [(i, t, "en", 1, 2, "k") for i, t in enumerate(ODD)] + [(None, "no id", None, 1, 2, "k"), (3, "same id again", "de", 1, 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines int, _id int, key string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def ordered(docs):
    return sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))


def test_token_store(spark, odd, none):
    got = [tuple(r)[:4] for r in token_store.read_documents(token_store.write_token_store(odd, new_path(spark, "t"), WORD, 1, seq_len=64)).collect()]
    tok, start, want = Tokenizer.from_file(WORD), 0, []
    for r in ordered(odd):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_store.read_documents(token_store.write_token_store(none, new_path(spark, "t"), WORD, 1)).count() == 0


def test_token_shard_masks(spark, odd):
    m = token_store.write_token_store(odd, new_path(spark, "t"), WORD, 1, seq_len=64, shards=1).collect()
    shard = token_store.TokenShard(m[0]["path"])
    assert sum(int(shard.sequence(i)[1].sum()) for i in range(len(shard))) == m[0]["n_tokens"]
    flat = np.concatenate([shard.sequence(i)[0] for i in range(len(shard))])
    d = shard.docs.read_all()
    for x, s, n in zip(shard.slices(d["start"].to_numpy(), d["n_tokens"].to_numpy()), d["start"].to_pylist(), d["n_tokens"].to_pylist(), strict=True):
        assert (x == flat[s : s + n]).all()
    mapped = pa.memory_map(m[0]["path"].removeprefix("file://") + ".tokens.arrow")
    shard.file, size, base = pa.ipc.open_file(mapped), mapped.size(), mapped.read_buffer(1).address
    for x in shard.sequence(0):  # both point into the mapped file, not into memory of their own
        assert base <= x.ctypes.data < base + size and not x.flags.owndata


def test_token_shard_of_many_batches(tmp_path):
    w = token_store.ShardWriter(str(tmp_path), 0, "a", "<u2", 4)
    rng, want = np.random.default_rng(1), []
    for _ in range(40):
        docs = [rng.integers(0, 60_000, int(n)).astype("<u2") for n in rng.integers(1, 900, 5)]
        w.add([1] * 5, [x.tobytes() for x in docs])
        want += docs
    w.close()
    shard = token_store.TokenShard(f"{tmp_path}/shard-000000")
    d = shard.docs.read_all()
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(shard.slices(d["start"].to_numpy(), d["n_tokens"].to_numpy()), want, strict=True))
    assert [shard.file.get_batch(i).num_rows for i in range(shard.file.num_record_batches - 1)] == [token_store.BATCH_SEQUENCES] * (shard.file.num_record_batches - 1)
    total, mask = sum(map(len, want)), np.concatenate([shard.sequence(i)[1] for i in range(len(shard))])
    assert len(mask) == -(-total // 4) * 4 and mask.dtype == np.uint8 and (mask[:total] == 1).all() and not mask[total:].any()


@pytest.mark.parametrize("n", [1, 4, 5, 8])
def test_token_shard_of_few_tokens(tmp_path, n):
    w = token_store.ShardWriter(str(tmp_path), 0, "a", "<u2", 4)
    w.add([7], [np.arange(n, dtype="<u2").tobytes()])
    w.close()
    shard = token_store.TokenShard(f"{tmp_path}/shard-000000")
    ids, mask = (np.concatenate([shard.sequence(i)[k] for i in range(len(shard))]) for k in (0, 1))
    assert (ids[:n] == np.arange(n)).all() and mask.tolist() == [1] * n + [0] * (-n % 4)


def test_token_counts(odd, none):
    vocab = ["▁", "▁a", "a", "aa", "aaa", "▁w", "te", "xt", "▁text", "e", "t", "x"]
    scores = token_counts.zipf_scores(vocab)

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            options = [(-(best[e - 1][0] + size * token_counts.BYTE_SCORE), best[e - 1][1] + size)]
            options += [(-(best[b][0] + scores[word[b:e]]), best[b][1] + 1) for b in range(e) if word[b:e] in scores]
            s, n = min(options)
            best.append((-s, n))
        return best[-1][1]

    want = sorted((str(r["doc_id"]), len((r["text"] or "").split()), sum(brute("▁" + w) for w in (r["text"] or "").split())) for r in odd.collect())
    assert sorted((str(r[0]), r[1], r[2]) for r in token_counts.count_tokens(odd, vocab).collect()) == want
    assert token_counts.count_tokens(none, vocab).count() == 0


def test_token_counts_with_a_real_vocabulary(spark):
    """Words of documents, random strings and rare scripts against the plain recurrence over all pieces."""
    vocab = token_counts.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    scores, longest = token_counts.zipf_scores(vocab), max(map(len, vocab))

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            options = [(-(best[e - 1][0] + size * token_counts.BYTE_SCORE), best[e - 1][1] + size)]
            options += [(-(best[b][0] + scores[word[b:e]]), best[b][1] + 1) for b in range(max(0, e - longest), e) if word[b:e] in scores]
            s, n = min(options)
            best.append((-s, n))
        return best[-1][1]

    rng = random.Random(6)
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() for w in (r["text"] or "").split()})[:1500]
    words += ["".join(rng.choice("aeioustrn日本語éß😀▁<>0x") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    words = [w for w in words if len(w.split()) == 1]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, vocab).collect()}
    assert all(got[i] == brute("▁" + w) for i, w in enumerate(words))


def test_language_of_rows_without_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and n_chars between 200 and 3000")
    model = language_id.train(docs, language_id.fold() != 2)
    one = docs.limit(1).collect()[0]
    rows = spark.createDataFrame([(None, one["text"]), (1, one["text"]), (2, one["text"])], "doc_id long, text string")
    got = language_id.identify(rows, model).collect()
    assert len({(r["lang_pred"], r["score"]) for r in got}) == 1 and len(got) == 3
    held = {r["doc_id"]: r["held_out"] for r in rows.select("doc_id", (language_id.fold() == 2).alias("held_out")).collect()}
    assert held[None] is None and {held[1], held[2]} <= {True, False}


def test_bpe(odd, none):
    tok = Tokenizer.from_file(BYTE)

    def want(text):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(odd, BYTE).collect()) == sorted((str(r["doc_id"]), *want(r["text"])) for r in odd.collect())
    assert bpe.digests(none, BYTE).count() == 0


def test_bpe_rounds_equal_heap_and_library():
    rng, b, tok = random.Random(5), bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    words = ["".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["a" * n for n in range(1, 40)]
    raw = [w.encode() for w in words]
    rounds = b._rounds(raw)
    assert rounds == [b._heap(w) for w in raw]
    assert [np.frombuffer(x, "<u4").tolist() for x in rounds] == [tok.encode(w).ids for w in words]


def test_bpe_characters_of_all_planes():
    b, tok = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    points = [*range(0x80, 0xD800, 5), *range(0xE000, 0x10000, 5), *range(0x10000, 0x20000, 11), *range(0x20000, 0x110000, 311), 0x3E8F5, 0x180E, 0x200B, 0x1F600]
    texts = [f"a {chr(c)}'s {chr(c)}{chr(c)} 1{chr(c)}  {chr(c)}" for c in points]
    for part in range(0, len(texts), 2000):
        some = texts[part : part + 2000]
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_batch(some)] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


def test_warc(spark):
    big = "<p>" + "é" * 100
    rows = [(5, big, 1), (2, big, 1), (7, "short", 1), (8, "short", 1), (9, None, 1), (None, big, 1), (2, big, 1), (11, "z" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, payload int").repartition(3)
    got = warc.read_archives(spark, warc.write_archives(warc.classify(pages), new_path(spark, "w"))).collect()
    want = []
    for i, t, _ in rows:
        p = (t or "").encode()
        refers = 2 if len(p) >= 100 and t == big and i != 2 else None
        want.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))
    assert warc.read_archives(spark, warc.write_archives(warc.classify(pages.limit(0)), new_path(spark, "w"))).count() == 0


def test_warc_records_are_whole(spark):
    rows = [(1, "a" * 200, "http://a/1"), (2, "a" * 200, "http://a/ 2"), (1, "b", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").repartition(1)
    raw = b"".join(gzip.open(p.removeprefix("file://"), "rb").read() for p in warc.write_archives(warc.classify(pages), new_path(spark, "w")))
    heads = [h for h in re.findall(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)+", raw)]
    assert sum(b"WARC-Type: warcinfo" in h for h in heads) >= 1 and len({re.search(rb"WARC-Record-ID: (.+)\r", h)[1] for h in heads}) == len(heads)
    assert {re.search(rb"WARC-Target-URI: (.+)\r", h)[1] for h in heads if b"warcinfo" not in h} == {b"http://a/1", b"http://a/2", b"urn:page:1"}
    assert [b"WARC-Refers-To-Target-URI: http://a/1\r" in h for h in heads if b"revisit\r" in h] == [True]


Z = lambda b: zlib.compress(b, wbits=31)


def test_warc_reader_refuses_damage():
    good = warc.record(1, b"hello", hashlib.sha256(b"hello").hexdigest(), None, record_id="urn:a", url="http://a")
    assert [r[5] for r in warc.read_records(io.BytesIO(Z(good) + Z(good)), keep_payload=True)] == [b"hello"] * 2
    for bad in (Z(good.replace(b"hello", b"hellO")), Z(good[:-6]), Z(good)[:-4], Z(good) + Z(good)[:-20], Z(good)[:40] + b"xx" + Z(good)[42:]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_reader_of_other_archives():
    """Record types that aren't asked for, digests of other kinds, chunked bodies, no lengths."""

    def one(kind, body, *fields):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:x>", *fields, f"Content-Length: {len(body)}"]
        return Z(("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n")

    http, text = "Content-Type: application/http; msgtype=response", b"some text"
    sha1 = "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(text).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nsome\r\n5\r\n text\r\n0\r\n\r\n"
    raw = one("warcinfo", b"a: b\r\n") + one("request", b"GET / HTTP/1.1\r\n\r\n", http) + one("response", b"HTTP/1.1 200 OK\r\n\r\n" + text, http, sha1) + one("response", chunked, http, sha1)
    raw += one("response", b"HTTP/1.1 204 No\r\n\r\n", http) + one("metadata", b"x") + one("response", text) + one("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Payload-Digest: sha1:ABC")
    got = [r[1:4] + (r[5],) for r in warc.read_records(io.BytesIO(raw), keep_payload=True)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [(9, sha(text), "response", text), (9, sha(text), "response", text), (0, sha(b""), "response", b""), (9, sha(text), "response", text), (None, "sha1:ABC", "revisit", None)]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(one("response", b"HTTP/1.1 200 OK\r\n\r\nother", http, sha1))))
    assert [r[3] for r in warc.read_records(io.BytesIO(raw), kinds={"metadata"})] == ["metadata"]


def test_line_dedup(spark, odd, none):
    line = "  A Line Of Forty Characters, Or Rather More Of Them \t"
    rows = [(i, f"own {i}\n{line if i % 2 else line.lower()}\nshort\n", None) for i in range(6)] + [(i, "é" * 40, None) for i in range(10, 14)] + [(20, None, "x"), (21, f"{line}\n{line}", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string").repartition(4)
    for most in (1 << 20, 0):  # filters that are broadcast, and hashes that are joined
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, broadcast_bytes=most).collect()}
        assert got[0] == ("own 0\nshort\n", 4, 1) and got[21] == (f"{line}\n{line}", 2, 0) and got[10][2] == 0 and got[20] == ("", 1, 0)
    out = line_dedup.drop_lines(odd)
    assert out.dtypes == odd.dtypes and out.exceptAll(odd.fillna("", ["text"])).isEmpty()
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize(("most", "parts", "bits"), [(32 << 20, 4, 16), (32 << 20, 7, 2), (0, 4, 2), (0, 3, 16)])
def test_many_repeated_lines(spark, most, parts, bits):
    """Each of 20,000 lines in 5 documents loses 4, in both ways and with any partitions; filters of two bits a hash hit
    falsely for half of the hashes."""
    docs = [[] for _ in range(300)]
    for i in range(20_000):
        for j in range(5):
            docs[(i * 7 + j * 61) % 300].append(f"line number {i} that is longer than forty characters")
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(docs)], "doc_id long, text string").repartition(parts)
    got = line_dedup.dedup_lines(df, broadcast_bytes=most, bits_each=bits).agg({"n_lines": "sum", "n_dropped": "sum"}).first()
    assert (got["sum(n_lines)"], got["sum(n_dropped)"]) == (100_000, 80_000)


def test_lines_of_rows_without_id_are_dealt_out(spark):
    """A third of all rows without id don't meet in one task: the join back is by id and text."""
    line = "a line that is longer than forty characters, everywhere"
    docs = spark.createDataFrame([(i if i % 3 else None, f"{line}\nown {i}") for i in range(3000)], "doc_id long, text string")
    keys = line_dedup.dropped_keys(docs, id_col="doc_id", text_col="text", min_chars=40, min_docs=5, broadcast_bytes=1 << 20, bits_each=16)
    assert keys.count() == 2999 and keys.groupBy("_id", "_hash").count().agg({"count": "max"}).first()[0] == 1
    assert line_dedup.dedup_lines(docs).where("n_dropped = 1").count() == 2999


def test_session_keeps_its_batches(spark, odd):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert spark.conf.get(rows) == "10000"
    line_dedup.drop_lines(odd).count()
    assert spark.conf.get(rows) == "10000"


def test_line_filters_keep_their_rate_at_any_size():
    rng = np.random.default_rng(8)
    for n in (3_000, 30_000, 300_000):
        held, other = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
        grown, fixed = line_dedup.Growing(first=1000), line_dedup.Bloom(line_dedup.filter_bits(n))
        for part in np.array_split(held, 7):
            grown.add(part)
        fixed.add(held)
        assert grown.has(held).all() and fixed.has(held).all()
        assert fixed.has(other).mean() < 0.004 and grown.has(other).mean() < 0.012
        assert sum(x.bits for x in grown.layers) < 16 * line_dedup.BITS_EACH * n


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.query(spark, "/root/testdata/sf0.001").toPandas().merge(docs.select("doc_id", "lang").toPandas())
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.train(docs, language_id.fold() != 2)
    rows = {(r[0], r[1]) for r in language_id.identify(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= rows
    assert language_id.identify(odd, language_id.train(none, language_id.fold() != 2)).where("lang_pred <> 'und'").count() == 0


def test_bins_stand_for_n_grams(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").limit(30).collect():
        t = " " + " ".join(r["text"].lower().split()) + " "
        n = len({t[i : i + k] for k in range(1, language_id.LONGEST + 1) for i in range(len(t) - k + 1)})
        assert 0.97 * n <= len(language_id.bins(r["text"])) <= n


def grams(text):
    return set(language_id.bins(text).tolist())


def brute_model(labelled, each=40, ridge=1e-2):
    """Kernel ridge on Nystrom features with sets of n-gram bins and a dense dual solve; a function of texts."""
    kernel = lambda xs, ys: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in ys] for x in xs])
    names, marks, count, rows = sorted({y for _, y in labelled}), [], {}, []
    for t, y in labelled:
        count[y] = count.get(y, 0) + 1
        marks += [grams(t)] if count[y] <= each else []
        at = max(0, (len(t) - language_id.SNIPPET) // 2)
        rows += [(p, y) for p in (t, t[at : at + language_id.SNIPPET]) if any(map(str.isalpha, p))]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    white = (vectors / np.sqrt(np.maximum(values, 1e-300)))[:, values > 1e-6 * values.max()]
    phi = kernel([grams(t) for t, _ in rows], marks) @ white
    target = np.array([[1.0 if y == n else -1.0 for n in names] for _, y in rows])
    c, lam = phi - phi.mean(0), ridge * len(rows) / phi.shape[1]
    dual = np.linalg.solve(c @ c.T + lam * np.eye(len(rows)), target - target.mean(0))

    def predict(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        out = target.mean(0) + ((kernel([grams(text)], marks) @ white)[0] - phi.mean(0)) @ c.T @ dual
        prior = target.mean(0)[out.argmax()]
        return names[int(out.argmax())], float(np.clip((out.max() - prior) / (1 - prior), 0, 1))

    return predict


def test_language_model_equals_dense_kernel_ridge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(60).collect()
    labelled = [(r["text"], r["lang"]) for r in docs]
    model, brute = language_id.fit([t for t, _ in labelled], [y for _, y in labelled], landmarks_each=12), brute_model(labelled, each=12)
    texts = [t for t, _ in labelled] + ["the cat sat on the mat", "der Hund und die Katze", "日本語", "x", "4 5", None, "the cat sat on the mat"]
    names, scores = model.predict(texts)
    for t, n, s in zip(texts, names, scores, strict=True):
        want, score = brute(t)
        assert abs(s - score) < 0.002 and (n == want or score < 0.05)


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(i, ("wort und das ist " * 3000) if i % 2 else "the word is there and this", "de" if i % 2 else "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, language_id.F.lit(True), most_chars=500)
    assert model.languages == ["de", "en"] and model.predict(["und das ist"])[0] == ["de"]
    assert language_id.keep_identified(docs, model, languages=["de"]).count() == 6
    assert language_id.keep_identified(docs, model, min_score=1.1).count() == 0


def groups(texts, least=0.8):
    sh, parent = Shingler(), {i: i for i in texts}
    sets = {i: set(sh.distinct(t).tolist()) for i, t in texts.items()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least if sets[a] and sets[b] else not sets[a] and not sets[b] and (texts[a] or "") == (texts[b] or "")
            if same:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}


def test_near_dedup(spark, odd, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, base = {}, [word() for _ in range(120)]
    for i in range(60):  # one group of near copies, some of them on the edge
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        texts[i] = " ".join(t)
    texts |= {i: " ".join(word() for _ in range(40)) for i in range(100, 130)} | {200: None, 201: "", 202: "...", 203: "one two", 204: "One, two!"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == groups(texts)
    assert near_dedup.classes(odd).count() == odd.count() and near_dedup.classes(none).count() == 0
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == sorted(set(groups(texts).values()))


def test_near_dedup_null_and_repeated_ids(spark):
    """Rows are documents of their own whatever their ids; a class has the smallest id, and one row of it stays."""
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, "one two three four five six"), (7, "alpha beta gamma delta epsilon"), (7, "alpha beta gamma delta epsilon"), (7, "other words than those of the namesake"), (4, "seven eight nine ten eleven twelve"), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _row int, _kept int").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs).collect()), key=str)
    assert got == sorted([(None, None), (None, 4), (None, None), (7, 7), (7, 7), (7, 7), (4, 4), (9, 8), (8, 8)], key=str)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[6], rows[8]], key=str)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])  # three blocks without strips; about 75 blocks in strips of five
def test_near_dedup_finds_pairs_inside_a_family_just_below(spark, monkeypatch, block):
    """Documents that share a long passage (similarity 0.75), among them pairs of 0.80 to 0.82."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, texts, ids = [word() for _ in range(261)], {}, rng.sample(range(10_000), 600)
    for k in range(0, 600, 2):
        more = [word() for _ in range(rng.choice((11, 12, 13)))] if k < 200 else []
        for i in ids[k : k + 2]:
            texts[i] = " ".join(passage + more + [word() for _ in range(43 - len(more))])
    want = groups(texts)
    assert len(set(want.values())) == 500
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == want


def test_prefix_keys_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, pool = int(rng.integers(1, 120)), np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        rng.shuffle(pool)
        for cut_a, add_b in ((0, n // 4), (n // 9, n // 9), (n // 5, 0)):
            a, b = np.unique(pool[: n - cut_a]), np.unique(pool[: n + add_b] if not cut_a else pool[cut_a : n + add_b])
            common = np.intersect1d(a, b)
            if len(common) and len(common) / (len(a) + len(b) - len(common)) >= 0.8:
                for shared in (common, np.union1d(a, b)):  # with and without shingles that no other class has
                    assert len(np.intersect1d(*(near_dedup.prefix_keys(len(x), np.intersect1d(x, shared), 0.8) for x in (a, b))))


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    sig = near_dedup.dart_signatures(np.concatenate([e, e]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_dart_signatures_are_of_the_document_alone():
    """A document's signature is the same alone and among others, however few or many shingles these have."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 0, 250, 20_000, 1, 40)]
    flat = lambda s: (np.concatenate(s), np.ones(sum(map(len, s))), np.repeat(np.arange(len(s)), [len(x) for x in s]), len(s))
    together = near_dedup.dart_signatures(*flat(sets), 144)
    assert all((together[i] == near_dedup.dart_signatures(*flat([s]), 144)[0]).all() for i, s in enumerate(sets))
    assert [bool(row.all()) for row in together] == [len(s) > 0 for s in sets]


def test_decontaminate(spark, odd, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = {i: [word() for _ in range(rng.randint(5, 60))] for i in range(20)} | {90: ["Two", "words"]}
    docs = {}
    for i in range(40):
        t = [word() for _ in range(rng.randint(0, 3000))]
        for k in rng.sample(range(20), 3 if i % 3 else 12):
            p = list(items[k])
            if i % 2:
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(t))
            t[at:at] = p
        docs[i] = t
    docs[99] = ["x", "two,", "WORDS", "y"]
    sh = Shingler()
    want = set()
    for i, t in docs.items():
        for k, p in items.items():
            q = set(sh.distinct(" ".join(p)).tolist())
            own = set(sh.ordered(" ".join(t)).tolist()) | ({int(x) for n in range(len(t) - 1) for x in Shingler(2).ordered(" ".join(t[n : n + 2]))} if len(p) < 5 else set())
            if len(q & own) >= 0.8 * len(q):
                want.add((i, k))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(95, None), (96, "")], "item_id long, text string")
    for how in ({}, {"most": 3}, {"broadcast_bytes": 0}):  # by coordinates, by rare shingles, without a filter
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(d, b, **how).collect()} == want and (99, 90) in want
    assert decontaminate.find_items(odd, b).count() == 0 and decontaminate.find_items(none, b).count() == 0 and decontaminate.find_items(d, b.limit(0)).count() == 0
    # repeated items give a row each; rows without an id or with the same one are dropped each by itself
    twice = b.union(b.where("item_id = 3"))
    assert decontaminate.find_items(d, twice).where("item_id = 3").count() == 2 * sum(k == 3 for _, k in want)
    rows = [(None, " ".join(items[1]), 1), (None, "clean", 2), (5, "clean too", 3), (5, "x " + " ".join(items[2]), 4), (5, "x " + " ".join(items[2]), 4)]
    same = spark.createDataFrame(rows, "doc_id long, text string, _bad int")
    kept = decontaminate.drop_contaminated(same, b)
    assert kept.columns == same.columns and sorted(r["_bad"] for r in kept.collect()) == [2, 3]


def test_decontaminate_a_dump_of_the_benchmark(spark):
    """A document that holds all items, some of five words: bounded coordinates, the rest by rare shingles."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    items = [words[i * 7 : i * 7 + (5 if i % 3 else 7)] for i in range(4_000)]
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(words[:28_000])), (2, "nothing of it"), (3, " ".join(items[17]))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(d, b).collect()}
    assert got == {(1, i) for i in range(4_000)} | {(3, 17)}


def test_fingerprint(spark, odd, none):
    texts = [f"First line {i} of it. Second one here!\nThird line with {i * 7} words in it\n" * 3 for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in fingerprint.compare_edited(docs, buckets=5).collect()}
    for i, t in enumerate(texts):
        half, nxt = len(t) // 2, texts[(i + 1) % 30]
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest() and rows[i]["n_chars"] == len(t)
    assert sum(r["near_edited"] for r in rows.values()) > sum(r["near_next"] for r in rows.values())
    other = spark.createDataFrame([(1, "b b\na a"), (2, "a a\nb b"), (3, "a a\nb b\nb b")], "doc_id long, text string")
    fp = {r["doc_id"]: r["fp"] for r in fingerprint.fingerprint(other).collect()}
    assert fp[1] == fp[2] != fp[3]
    from pyspark.sql import functions as F

    assert {r["doc_id"]: r["fp"] for r in fingerprint.fingerprint(docs).collect()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    one = spark.createDataFrame([(fp[3], fingerprint_of(spark, "b b"))], "a array<long>, b array<long>")
    assert one.select(fingerprint.combine(F.col("a"), F.col("b"), -1).alias("x")).first()["x"] == fp[1]
    assert fingerprint.compare_edited(odd).count() == odd.count() and fingerprint.compare_edited(none).count() == 0


def brute_fingerprint(text):
    """Count, packed one-bit lanes and 32-bit lanes of a text's pieces, each lane summed by its modulus."""
    found = [m for p in re.split(r"\n|(?<=[.!?])[ \t\n\x0b\f\r]+", text or "") for m in re.findall(r"\S+(?:\s+\S+){0,4}", p, re.ASCII)]
    h = [[xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(p.encode(), 42)) for p in found] for s in (0, 1)]
    lane = lambda seed, bit: sum(x >> bit & 1 for x in h[seed]) % 2**31
    wide = [lane(s, k) | lane(s, k + 31) << 31 for s in (0, 1) for k in range(31)]
    return [len(found), *wide, *(sum(x >> 32 * (j % 2) & 0xFFFFFFFF for x in h[j // 2]) % 2**32 for j in range(4))]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (np.array([2 * (w >> k & (2**31 - 1)) - f[0] for k in (0, 31) for w in f[1:63]], float) for f in (a, b))
    return float(np.clip(x @ y / max((x @ x) * (y @ y), 1e-9) ** 0.5, 0, 1))


def test_fingerprint_equals_brute_force(spark):
    """Lanes, text form and likeness recomputed; ties, repeated texts, empty and very long ones."""
    texts = ["One two three four five six. Seven!\nEight nine", "", None, "a b c " * 5000, "One two three four five six. Seven!\nEight nine", "é ß\n" * 50, "...", "x"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _fp int").repartition(3)
    for buckets in (1, 4):
        rows = {r["doc_id"]: r for r in fingerprint.compare_edited(docs, buckets=buckets).collect()}
        for i, t in enumerate(texts):
            t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
            half = len(t) // 2
            own, edited, after = map(brute_fingerprint, (t, t[: len(t) - half] + nxt[:half], nxt))
            hexed = lambda f: "".join(f"{x:08x}" for x in f[63:]) + f"{f[0]:x}-" + "".join(f"{x:016x}" for x in f[1:63])
            assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (hexed(own), hexed(edited))
            assert abs(rows[i]["near_edited"] - brute_likeness(own, edited)) < 1e-9 and abs(rows[i]["near_next"] - brute_likeness(own, after)) < 1e-9


def test_fingerprints_of_rows_without_id_are_dealt_out(spark):
    """A third of all rows without id, and a sixth with one id: no range has twice its share, and each row's next one is the
    next by id, then by the hash of the text."""
    ids = [None if i % 3 == 0 else 500 if i % 6 == 1 else i for i in range(3000)]
    texts = [f"Text number {i} of some." for i in range(3000)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) % 2**64 >> 1, r[1])
    order = sorted(zip(ids, texts, strict=True), key=key)
    rows = fingerprint.with_next(docs, 16).where("_guest = 0").collect()
    assert {(r["doc_id"], r["text"], r["_next"]) for r in rows} == {(*a, b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)} and len(rows) == 3000
    sizes = Counter(r["_bucket"] for r in rows)
    assert max(sizes.values()) < 2 * 3000 / 16
    assert fingerprint.compare_edited(docs, buckets=16).count() == 3000


def most_in_a_task(df):
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id().alias("p")).count().agg({"count": "max"}).first()[0]


@pytest.fixture
def skew(spark):
    """AQE splits what is a third of this test's rows; nothing is broadcast."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "adaptive.coalescePartitions.enabled": "false", "shuffle.partitions": "12"}
    was = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k, v in was.items():
        spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_hot_payload_is_split(spark, skew):
    pages = spark.createDataFrame([(i, "x" * 300 if i % 3 == 0 else f"{i} " * 80) for i in range(6000)], "page_id long, html string").repartition(12)
    assert most_in_a_task(warc.classify(pages)) < 2 * 6000 / 12


def test_hot_bucket_is_split(spark, skew):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.col("id").alias("rep"), F.array(F.struct(F.lit(1).alias("i"), F.col("id").alias("h"))).alias("used"), F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") / 9).cast("long")).alias("key")).repartition(12)
    assert most_in_a_task(near_dedup.mixed(rows, None)) < 2 * 60_000 / 12


def test_rows_without_id_fill_several_shards(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"{i} text") for i in range(3000)], "doc_id long, text string")
    shards = token_store.write_token_store(docs, new_path(spark, "t"), WORD, 1, shards=12).collect()
    assert sum(r["n_docs"] for r in shards) == 3000 and max(r["n_docs"] for r in shards) < 2 * 3000 / 12


def fingerprint_of(spark, text):
    return fingerprint.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fp"]


def test_chat(spark):
    talk = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x, "z") for i, x in enumerate(t)]
    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "x") + talk(4, "a", "b", "c") + talk(5, "b") + [(6, None, None, None, "z"), (None, 0, "user", "q", "z")] + talk(7, *["long"] * 3000) + [(8, 0, "b", "2", "z"), (8, 0, "a", "1", "z"), (8, 0, "a", "0", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.render(df).collect()}
    assert set(got) == {2, 3, 5, 6, 7, 8, None} and got[7][0] == 3000
    assert got[7][1] == "".join(f"<|im_start|>{'assistant' if i % 2 else 'user'}\nlong<|im_end|>\n" for i in range(3000))
    assert got[8][1] == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ("a0", "a1", "b2"))
    assert got[3][1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n" and got[6][1] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.render(df.limit(0)).count() == 0
