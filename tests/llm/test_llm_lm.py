"""Language-model scores against a plain version that counts in dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest

from samples import make_docs, odd_rows, texts
from voltrail.llm import lm_score

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + ["</s>\n"]


def fold(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10


def counts(rows, folds):
    uni, bi = Counter(), Counter()
    for doc, text in rows:
        if fold(doc) in folds:
            own = tokens(text)
            uni.update(own)
            bi.update(zip(["<s>\n", *own], own))
    texts_ = sum(fold(d) in folds for d, _ in rows)
    return uni, bi, {**uni, "<s>\n": texts_}


def level(n):
    return n.bit_length()


def plain_weights(rows):
    uni, bi, ctx = counts(rows, set(range(2, 10)))
    total, size = max(sum(uni.values()), 1), len(uni)
    data = []
    for doc, text in rows:
        if fold(doc) == 1:
            own = tokens(text)
            for h, w in zip(["<s>\n", *own], own):
                c = ctx.get(h, 0)
                data.append((level(c), bi[h, w] / max(c, 1), uni[w] / total, 1 / (size + 1)))
    weights = {}
    for _ in range(lm_score.ROUNDS):
        expected = {}
        for lev, *p in data:
            w = weights.get(lev, weights.get("pooled", [1 / 3] * 3))
            parts = [a * b for a, b in zip(w, p)]
            e = expected.setdefault(lev, [0, 0, 0])
            for i in range(3):
                e[i] += parts[i] / sum(parts)
        pooled = [sum(e[i] for e in expected.values()) + 1 for i in range(3)]
        after = {lev: [(x + 1) / (sum(e) + 3) for x in e] for lev, e in expected.items()}
        after["pooled"] = [x / sum(pooled) for x in pooled]
        change = max(abs(a - b) for k in after for a, b in zip(after[k], weights.get(k, weights.get("pooled", [1 / 3] * 3))))
        weights = after
        if change < lm_score.TOLERANCE:
            break
    return weights


def plain_scores(rows):
    uni, bi, ctx = counts(rows, set(range(1, 10)))
    n, v = sum(uni.values()), len(uni)
    weights = plain_weights(rows)
    out = []
    for doc, text in rows:
        own = tokens(text)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        score = 0.0
        for h, w in zip(["<s>\n", *own], own):
            c = ctx.get(h, 0)
            a, b, u = weights.get(level(c), weights["pooled"])
            score += math.log10(a * bi[h, w] / max(c, 1) + b * uni[w] / max(n, 1) + u / (v + 1))
        out.append((str(doc), fold(doc) == 0, len(own), sum(uni[w] > 0 for w in own), n, base, score))
    return sorted(out)


def check(df, rows):
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                 for r in df.collect())
    want = plain_scores(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("chunk,bucket", [(16 << 20, 1_000_000), (2000, 100)])
def test_scores(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "BUCKET_NGRAMS", bucket)
    rows = [(i, t) for i, t in enumerate(texts(120))] + odd_rows(500)
    check(lm_score.score_texts(make_docs(spark, rows)), rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(lm_score.score_texts(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_model_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm_score.score_texts(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert sums[0] > sums[1]


def test_without_training_texts(spark):
    held = [(i, "some words") for i in range(200) if fold(i) == 0]
    check(lm_score.score_texts(make_docs(spark, [])), [])
    rows = lm_score.score_texts(make_docs(spark, held)).collect()
    assert len(rows) == len(held) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
