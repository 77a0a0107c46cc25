"""The pipeline against a version in plain Python, stage by stage, and its defined cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_operators import brute_model, groups
from tokenizers import Tokenizer

import corpus_pipeline
from tilewright.llm import language_id

STRIP = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _keys string, _kept int, _bad int, n_lines string, n_dropped int, _row int"
EXTRA = (1, "k", 2, 3, "own", 4, 5)


def corpus(spark):
    """Documents of two languages with copies, repeated lines, benchmark passages, other scripts, nulls and repeats."""
    rng = random.Random(11)
    real = [r["text"].split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 400 and 4000 and lang in ('en', 'de')").orderBy("doc_id").limit(60).collect()]
    langs = [r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 400 and 4000 and lang in ('en', 'de')").orderBy("doc_id").limit(60).collect()]
    items = {i: " ".join(rng.sample(real[i], min(30, len(real[i])))) for i in range(5)}
    line = "This line of more than forty characters is in many documents."
    texts = []
    for i, w in enumerate(real):
        t = " ".join(w)
        if i % 4 == 0:
            t = f"{t}\n{line if i % 8 else line.upper()}\nend {i}"
        if i % 11 == 3:
            t += " " + items[i % 5]
        texts.append((i, t, langs[i]))
    for i in range(0, 30, 3):  # near copies, exact ones, and rows with one id
        w = texts[i][1].split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts += [(100 + i, " ".join(w), langs[i]), (200 + i, texts[i][1], langs[i])]
    texts += [texts[7], (None, texts[9][1], langs[9]), (None, "ein Text ohne Nummer und das ist der Rest davon, nicht mehr", "de"), (300, None, None), (301, "", "en"), (302, "12345 !!", "en")]
    texts += [(303, "日本語のテキストです。" * 20, None), (304, "deadbeef0123456789" * 40, None), (305, "w " * 30_000, "en"), (306, " ".join(sum(real[:20], [])), "en")]
    rows = [(i, t, y, "s", len(t or ""), *EXTRA) for i, t, y in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows, items


def brute_language(rows):
    """All labelled rows of the training folds are fewer than the sample's bound, so all are learned from."""
    import zlib

    train = [(t, y) for i, t, y, *_ in rows if y is not None and t and any(map(str.isalpha, t)) and (i is not None and zlib.crc32(str(i).encode()) % 4 != 2)]
    predict = brute_model(train, each=1000)
    return [r for r in rows if (p := predict(r[1])) and p[0] != "und" and p[1] >= language_id.MIN_SCORE]


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    low = -(1 << 63)
    holders = {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, set()).add(low if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t, *more in rows:
        text = "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), low if i is None else i) == (low if i is None else i))
        out.append((i, text, *more[:2], len(text), *more[3:]))
    return out


def brute_near(rows):
    of = groups({k: r[1] for k, r in enumerate(rows)})
    best = {}
    for k, r in enumerate(rows):
        best[of[k]] = min(best.get(of[k], (True, 0, "", 0)) if of[k] in best else (r[0] is None, r[0] or 0, r[1], k), (r[0] is None, r[0] or 0, r[1], k))
    return [r for k, r in enumerate(rows) if best[of[k]][3] == k]


def shingles(text, sizes):
    import re

    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


def brute_benchmark(rows, items):
    sets = [s for t in items.values() if (s := shingles(t, [5]))]
    return [r for r in rows if not any(len(s & shingles(r[1], [5])) >= 0.8 * len(s) for s in sets)]


def brute_tokens(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    docs, rows, items = corpus(spark)
    base = f"{spark.conf.get('spark.checkpoint.dir')}/planted"
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, items


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_stages_equal_plain_python(spark, planted):
    base, rows, items = planted
    brute = [brute_language, brute_lines, brute_near, lambda r: brute_benchmark(r, items), brute_tokens]
    before, docs = rows, spark.read.parquet(f"{base}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute, strict=True):
        after = plain(before)
        got = stage(spark, docs, base).collect()
        same(got, after)
        assert name == "bpe" or (after != before and len(after) > 30)
        if name == "language_id":
            assert {r[0] for r in before} - {r[0] for r in after} == {300, 301, 302, 303, 304}
        before, docs = after, spark.createDataFrame(after, SCHEMA) if name != "bpe" else None
    same(corpus_pipeline.run(spark, base).collect(), before)


def test_stages_on_an_empty_table(spark, planted):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, planted[0])
        assert out.count() == 0 and (name == "bpe" or out.dtypes == docs.dtypes)
