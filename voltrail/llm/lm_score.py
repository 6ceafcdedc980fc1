"""Language-model scores by deleted interpolation of bigrams, unigrams and the uniform distribution.

P(w | h) = a * c(h, w) / c(h) + b * c(w) / N + c * 1 / (V + 1). The weights a, b, c depend on how often the context h was
seen: one set per power of two. They are learned by expectation-maximisation on a deleted part of the training texts:
its tokens are predicted from the counts of the other training texts. A text's first context is its start.

How it runs: texts are packed into chunks of about `CHUNK_BYTES` bytes, each with its vocabulary, and written once. A
chunk asks for the counts of its distinct unigrams and bigrams; requests go to the bucket that owns a range of 64-bit
n-gram hashes, which adds up all chunks and answers in the order asked. So an n-gram moves once per chunk and not once
per occurrence, a frequent word is one entry per chunk, and no task holds more than a chunk or a bucket. Buckets and
chunks grow in number with the corpus, not in size.

Tokens: the words of the text with A-Z lower-cased, then one end. Texts train unless crc32 of their id as text leaves no
remainder by 10; remainder `DELETED` is the deleted part. Words and bigrams go by 64-bit hashes: among a billion distinct
ones the odds of any collision are about one in forty.

Defined results: null or empty text is the end alone. A null id counts as empty text, so it is held out. Repeated rows
are texts of their own. Without training texts N is 0 and every token has the uniform weight. An empty table gives no
rows. Extra columns are ignored. Texts of any length are scored whole; one longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm import blobs
from voltrail.llm.blobs import pack, pack_sorted, unpack, unpack_sorted
from voltrail.session import send_to_tasks, written

FOLDS, HELD_OUT, DELETED = 10, 0, 1
CHUNK_BYTES = 8 << 20
BUCKET_NGRAMS = 1_000_000
ROUNDS, TOLERANCE = 20, 1e-3
ADD = 0.1
NO_ID = -(2**63)
END, START = 0, 1
UNIGRAM, BIGRAM = 0, 1
LEVELS = 64

CHUNKS = "chunk long, docs binary, folds binary, lengths binary, tokens binary, words binary, n_tokens long"
REQUESTS = "kind int, bucket long, chunk long, keys binary, train binary, deleted binary"
ANSWERS = "kind int, bucket long, chunk long, train binary, deleted binary, total long, distinct_keys long, deleted_total long, kept_keys long"
COUNTED = "chunk long, docs binary, folds binary, lengths binary, c1 binary, c2 binary, em array<struct<c2:long,ch:long,c1:long,n:long>>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Chunk:
    """Texts under construction: token numbers by first appearance; 0 is the end and 1 the start."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict(count(2).__next__)
        self.docs, self.folds, self.lengths, self.tokens, self.size = [], [], [], array("i"), 0

    def add(self, doc: int, fold: int, text: bytes) -> None:
        before = len(self.tokens)
        self.tokens.extend(map(self.words.__getitem__, text.lower().split()))
        self.tokens.append(END)
        self.docs.append(doc)
        self.folds.append(fold)
        self.lengths.append(len(self.tokens) - before)
        self.size += len(text)

    def row(self, chunk: int) -> dict:
        tokens = np.frombuffer(self.tokens, np.int32)
        hashes = np.fromiter(map(word_hash, (b"\n", b"\t", *self.words)), np.uint64, len(self.words) + 2)
        # Frequent words get small numbers, which compress better; end and start keep theirs.
        often = np.argsort(-np.bincount(tokens, minlength=len(hashes))[2:], kind="stable") + 2
        number = np.empty(len(hashes), np.int32)
        number[:2], number[often] = (0, 1), np.arange(2, len(hashes), dtype=np.int32)
        return {
            "chunk": chunk, "docs": pack(np.array(self.docs, np.int64)), "folds": pack(np.array(self.folds, np.int32)),
            "lengths": pack(np.array(self.lengths, np.int32)), "tokens": pack(number[tokens]),
            "words": np.concatenate([hashes[:2], hashes[often]]).tobytes(), "n_tokens": len(tokens),
        }


def pack_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    numbers = count(TaskContext.get().partitionId() << 32)
    chunk = Chunk()
    for batch in batches:
        for doc, fold, text in zip(batch["doc_id"].tolist(), batch["fold"].tolist(), batch["text"]):
            chunk.add(doc, fold, text.encode("utf-8", "surrogatepass"))
            if chunk.size >= CHUNK_BYTES:
                yield pd.DataFrame([chunk.row(next(numbers))])
                chunk = Chunk()
    if chunk.docs:
        yield pd.DataFrame([chunk.row(next(numbers))])


class Tokens:
    """A chunk's tokens with their contexts and n-gram keys."""

    def __init__(self, row):
        self.docs, self.folds = unpack(row["docs"], np.int64), unpack(row["folds"], np.int32)
        self.lengths = unpack(row["lengths"], np.int32)
        self.ids = unpack(row["tokens"], np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.fold = np.repeat(self.folds, self.lengths)

    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.firsts] = START
        return before

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending keys, and for each token the place of its key. The start is no token but stands among the keys."""
        order = np.argsort(self.words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return self.words[order], place[self.ids]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        h, w = self.words[self.contexts()], self.words[self.ids]
        key = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x632BE59BD9B4E019) + (h << np.uint64(6)))
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(key ^ (key >> np.uint64(32)), return_inverse=True)


def ask(rows: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Per chunk and bucket the keys that it needs, with its own counts in the training and in the deleted texts."""
    for batch in rows:
        for _, row in batch.iterrows():
            tokens = Tokens(row)
            train, deleted = tokens.fold != HELD_OUT, tokens.fold == DELETED
            for kind, (keys, place) in ((UNIGRAM, tokens.unigrams()), (BIGRAM, tokens.bigrams())):
                counts = [np.bincount(place[which], minlength=len(keys)).astype(np.uint32) for which in (train, deleted)]
                owner = _bucket(keys, bits)
                cuts = np.flatnonzero(np.diff(owner)) + 1
                parts = zip(*(np.split(x, cuts) for x in (owner, keys, *counts)))
                yield pd.DataFrame([
                    (kind, int(o[0]), row["chunk"], pack_sorted(k), pack(t), pack(d)) for o, k, t, d in parts if len(k)
                ], columns=["kind", "bucket", "chunk", "keys", "train", "deleted"])


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of each chunk's keys, in its order; the bucket's sums stand on its first row."""
    keys = [unpack_sorted(k) for k in group["keys"]]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for column in ("train", "deleted"):
        own = np.concatenate([unpack(x, np.uint32) for x in group[column]])
        sums.append(np.bincount(place, own, minlength=len(found)).astype(np.int64))
    train, deleted = sums
    ends = np.cumsum([len(k) for k in keys])[:-1]
    places = np.split(place, ends)
    out = group[["kind", "bucket", "chunk"]].copy()
    out["train"] = [pack(train[p].astype(np.uint64)) for p in places]
    out["deleted"] = [pack(deleted[p].astype(np.uint64)) for p in places]
    first = np.arange(len(group)) == 0
    for name, value in (("total", train.sum()), ("distinct_keys", (train > 0).sum()), ("deleted_total", deleted.sum()),
                        ("kept_keys", (train > deleted).sum())):
        out[name] = np.where(first, int(value), 0)
    return out


def level(context_count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the logarithm of the count to base 2."""
    return np.where(context_count > 0, np.frexp(context_count.astype(np.float64))[1], 0)


def _context_counts(c1: np.ndarray, tokens_firsts: np.ndarray, texts: int) -> np.ndarray:
    """A word is the context of as many tokens as it occurs; the start of as many as there are texts."""
    out = np.empty_like(c1)
    out[1:] = c1[:-1]
    out[tokens_firsts] = texts
    return out


def counted(chunk: pd.DataFrame, answers: pd.DataFrame, texts: int, deleted_texts: int) -> pd.DataFrame:
    """The chunk with the corpus counts of its tokens, and the distinct count triples of its deleted texts."""
    row = chunk.iloc[0]
    tokens = Tokens(row)
    use = tokens.fold == DELETED
    got = {}
    for kind, ngrams in ((UNIGRAM, tokens.unigrams), (BIGRAM, tokens.bigrams)):
        _, place = ngrams()
        own = answers[answers["kind"] == kind].sort_values("bucket")
        for column in ("train", "deleted"):
            counts = np.concatenate([unpack(x, np.uint64) for x in own[column]]).astype(np.int64)
            # Of the deleted part's bigrams only those of its own texts matter.
            got[kind, column] = counts[place[use] if (kind, column) == (BIGRAM, "deleted") else place]
        del place, counts
    c1, c2 = got[UNIGRAM, "train"], got[BIGRAM, "train"]
    kept1 = c1 - got.pop((UNIGRAM, "deleted"))
    ch = _context_counts(kept1, tokens.firsts, texts - deleted_texts)
    triples, n = np.unique(
        np.stack([c2[use] - got[BIGRAM, "deleted"], ch[use], kept1[use]], 1), axis=0, return_counts=True)
    return pd.DataFrame({
        "chunk": [row["chunk"]], "docs": [row["docs"]], "folds": [row["folds"]], "lengths": [row["lengths"]],
        "c1": [pack(c1.astype(np.uint64))], "c2": [pack(c2.astype(np.uint64))],
        "em": [[dict(zip(("c2", "ch", "c1", "n"), map(int, (*t, k)))) for t, k in zip(triples.tolist(), n.tolist())]],
    })


def score_chunks(rows: Iterator[pd.DataFrame], texts: int, total: int, vocabulary: int, weights: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in rows:
        for _, row in batch.iterrows():
            lengths = unpack(row["lengths"], np.int32)
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            c1, c2 = (unpack(row[c], np.uint64).astype(np.int64) for c in ("c1", "c2"))
            ch = _context_counts(c1, firsts, texts)
            w = weights[level(ch)]
            p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] / (vocabulary + 1)
            base = np.log10((c1 + ADD) / (total + ADD * (vocabulary + 1)))
            yield pd.DataFrame({
                "doc_id": unpack(row["docs"], np.int64), "held_out": unpack(row["folds"], np.int32) == HELD_OUT,
                "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat((c1 > 0).astype(np.int64), firsts),
                "base_score": np.add.reduceat(base, firsts), "score": np.add.reduceat(np.log10(p), firsts),
            })


def learn_weights(triples: DataFrame, total: int, vocabulary: int) -> np.ndarray:
    """LEVELS + 1 rows of three weights by expectation-maximisation over the deleted texts' count triples.

    Each weight starts a step with one made-up token, so none becomes 0. Levels without tokens keep the pooled weights.
    """
    at = F.when(F.col("ch") > 0, F.length(F.bin("ch"))).otherwise(0)
    rows = written(triples.groupBy("c2", "ch", "c1").agg(F.sum("n").alias("n")).select(
        at.alias("level"), "n", (F.col("c2") / F.greatest("ch", F.lit(1))).alias("p2"),
        (F.col("c1") / F.lit(max(total, 1))).alias("p1")), "lm-triples")
    uniform = 1.0 / (vocabulary + 1)
    weights = np.full((LEVELS + 1, 3), 1 / 3)
    for _ in range(ROUNDS):
        table = F.array(*[F.array(*map(F.lit, map(float, w))) for w in weights])
        w = F.get(table, F.col("level"))
        parts = [F.get(w, F.lit(0)) * F.col("p2"), F.get(w, F.lit(1)) * F.col("p1"), F.get(w, F.lit(2)) * uniform]
        shares = rows.select("level", "n", *[p.alias(f"x{i}") for i, p in enumerate(parts)])
        whole = F.col("x0") + F.col("x1") + F.col("x2")
        sums = shares.groupBy("level").agg(*[F.sum(F.col("n") * F.col(f"x{i}") / whole).alias(f"x{i}") for i in range(3)]).collect()
        expected = np.zeros_like(weights)
        for row in sums:
            expected[row["level"]] = row["x0"], row["x1"], row["x2"]
        pooled = expected.sum(0) + 1
        seen = expected.sum(1) > 0
        after = np.where(seen[:, None], expected + 1, pooled)
        after /= after.sum(1, keepdims=True)
        change, weights = np.abs(after - weights).max(), after
        if change < TOLERANCE:
            break
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    for module in (__name__, blobs.__name__):
        send_to_tasks(module)
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    texts = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), fold.alias("fold"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = written(texts.mapInPandas(pack_chunks, CHUNKS), "lm-chunks")
    sizes = texts.agg(
        F.count_if(F.col("fold") != HELD_OUT), F.count_if(F.col("fold") == DELETED)).first()
    n_train, n_deleted = sizes
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, tokens / BUCKET_NGRAMS))))
    requests = chunks.mapInPandas(lambda rows: ask(rows, bits), REQUESTS)
    answers = written(requests.groupBy("kind", "bucket").applyInPandas(answer, ANSWERS), "lm-answers")
    stats = answers.where(F.col("kind") == UNIGRAM).agg(
        F.sum("total"), F.sum("distinct_keys"), F.sum("deleted_total"), F.sum("kept_keys")).first()
    total, vocabulary, deleted_total, kept_vocabulary = (x or 0 for x in stats)
    joined = chunks.groupBy("chunk").cogroup(answers.select("chunk", "kind", "bucket", "train", "deleted").groupBy("chunk"))
    known = written(joined.applyInPandas(lambda c, a: counted(c, a, n_train, n_deleted), COUNTED), "lm-counted")
    weights = learn_weights(known.select(F.explode("em").alias("t")).select("t.*"), total - deleted_total, kept_vocabulary)
    scores = known.drop("em").mapInPandas(
        lambda rows: score_chunks(rows, n_train, total, vocabulary, weights), SCORES)
    return scores.withColumn("train_tokens", F.lit(total).cast("long")).withColumn(
        "doc_id", F.nullif("doc_id", F.lit(NO_ID)))
