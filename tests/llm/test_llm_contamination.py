"""Decontamination: planted passages are found, whole or reworded, and clean texts are left alone."""

import random
import zlib

import numpy as np
import pytest

from samples import make_docs, odd_rows, texts
from voltrail.llm import decontaminate, latent
from voltrail.llm.decontaminate import common_subsequence, find_contamination

ITEMS = "item_id long, text string, extra int"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 8, rng.integers(1, 40)), rng.integers(0, 8, rng.integers(0, 60))
        assert common_subsequence(a, b) == plain_lcs(a.tolist(), b.tolist())


def words(rng, n):
    return [f"q{rng.randrange(4000)}" for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 7])
def test_planted_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
    rng = random.Random(6)
    items = [words(rng, rng.randint(12, 70)) for _ in range(20)]
    rows, planted = [], {}
    for n, item in enumerate(items):
        around = texts(2, n, (0, 200))
        kind = n % 3
        own = list(item)
        if kind == 1:
            own = [w.upper() + "," if i % 5 else w for i, w in enumerate(own)]
        if kind == 2:
            for i in range(3, len(own), 6):
                own[i] = "reworded"
        rows.append((n, f"{around[0]} {' '.join(own)} {around[1]}"))
        planted[n] = n
    rows += [(100 + i, " ".join(words(rng, 150))) for i in range(60)] + odd_rows(500)
    table = [(n, " ".join(item), 1) for n, item in enumerate(items)] + [(90, None, 1), (None, "x y z a b c", 1), (91, "of the", 1)]
    found = {r["doc_id"]: r for r in find_contamination(make_docs(spark, rows), spark.createDataFrame(table, ITEMS)).collect()}
    exact = [n for n in planted if n % 3 != 2]
    assert all(found[n]["item_ids"] == [n] and not found[n]["kept"] for n in exact)
    assert all(found[n]["item_ids"] == [n] for n in planted)
    assert not any(found[i]["contaminated"] for i in found if i is None or i >= 100)


def test_answers_count(spark):
    item = " ".join(words(random.Random(1), 30))
    docs = make_docs(spark, [(1, f"{item} answer: fortytwo"), (2, f"{item} answer: unknown"), (3, "nothing here at all, not a thing")])
    table = spark.createDataFrame([(7, f"{item} answer: fortytwo", 1)], ITEMS)
    found = {r["doc_id"]: r["contaminated"] for r in find_contamination(docs, table).collect()}
    assert found == {1: True, 2: False, 3: False}


def test_given_documents(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    items = [(r["item_id"], r["text"].lower()) for r in read("benchmark").collect()]
    holds = {r["doc_id"]: {i for i, t in items if t in r["text"].lower()} for r in read("documents").collect()}
    found = {r["doc_id"]: set(r["item_ids"]) for r in find_contamination(read("documents"), read("benchmark")).collect()}
    assert all(want <= found[doc] for doc, want in holds.items())
    extra = sum(bool(found[doc]) and not want for doc, want in holds.items())
    assert extra <= 0.01 * len(holds)


def test_empty_tables(spark):
    docs = make_docs(spark, [(1, "some text of a few words")])
    none = spark.createDataFrame([], ITEMS)
    assert [r["kept"] for r in find_contamination(docs, none).collect()] == [True]
    one = spark.createDataFrame([(1, "some text of a few words", 1)], ITEMS)
    assert find_contamination(make_docs(spark, []), one).count() == 0


def test_many_items(spark):
    """The latent space keeps little of so many items; their verbatim copies are found by their words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts_of = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    cuts = [(d, w[at:at + 38]) for d, w in sorted(texts_of.items()) for at in range(7, len(w) - 37, 61)][:3000]
    assert len(cuts) == 3000
    table = spark.createDataFrame([(n, " ".join(w), 1) for n, (_, w) in enumerate(cuts)], ITEMS)
    found = {r["doc_id"]: set(r["item_ids"]) for r in find_contamination(docs, table).collect()}
    assert all(n in found[doc] for n, (doc, _) in enumerate(cuts))


def test_short_items_among_rare_words(spark):
    """A verbatim item of five words or more is found whatever stands around it."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(400)]
    items = [rng.sample(common, n) for n in range(5, 32) for _ in range(4)]
    rows = []
    for n, item in enumerate(items):
        around = [f"rare{n}x{i}" for i in range(120)]
        at = rng.randrange(120)
        rows.append((n, " ".join(around[:at] + item + around[at:])))
    rows += [(1000 + i, " ".join(rng.choices(common, k=60))) for i in range(300)]
    table = spark.createDataFrame([(n, " ".join(item), 1) for n, item in enumerate(items)], ITEMS)
    found = {r["doc_id"]: set(r["item_ids"]) for r in find_contamination(make_docs(spark, rows), table).collect()}
    assert [n for n in range(len(items)) if n not in found[n]] == []


def test_capitals_beyond_ascii():
    known = latent.Numbers({"ción": 0, "ñez": 1})
    assert latent.numbers_of("CIÓN Ñez,", known).tolist() == [0, 1]
    assert min(latent.numbers_of("cion, nez ...", known)) >= 2


def test_words_that_share_a_hash_are_different(spark):
    """A text none of whose words is the item's, though each has the hash of one."""
    wanted, own = {}, [f"item{i}" for i in range(30)]
    places = {zlib.crc32(w.encode()) % latent.FOREIGN: w for w in own}
    n = 0
    while len(wanted) < len(places):
        word = f"other{n}"
        n += 1
        place = zlib.crc32(word.encode()) % latent.FOREIGN
        if place in places:
            wanted.setdefault(place, word)
    other = [wanted[zlib.crc32(w.encode()) % latent.FOREIGN] for w in own]
    table = spark.createDataFrame([(7, " ".join(own), 1)], ITEMS)
    rows = [(1, " ".join(other)), (2, " ".join(own)), (None, " ".join(other)), (None, " ".join(own))]
    found = [(r["doc_id"], r["contaminated"]) for r in find_contamination(make_docs(spark, rows), table).collect()]
    assert sorted(found, key=str) == sorted([(1, False), (2, True), (None, False), (None, True)], key=str)


def test_matches_equal_a_plain_search(spark):
    """Every match holds up word by word, and no text that holds nearly a whole item in a row is missed."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()
    items = {r["item_id"]: latent.words_of(r["text"]) for r in read("benchmark")}
    docs = {r["doc_id"]: latent.words_of(r["text"]) for r in read("documents")}
    path = "/root/testdata/sf0.001"
    found = {r["doc_id"]: {m["item_id"]: m for m in r["matches"]} for r in find_contamination(
        spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    hits = 0
    for doc, own in docs.items():
        for item, m in found[doc].items():
            stretch = own[m["first_word"]:m["last_word"]]
            assert plain_lcs(items[item], stretch) / len(items[item]) == m["share"] >= decontaminate.SHARE
        for item, want in items.items():
            if len(want) >= 5 and len(set(want) & set(own)) >= 0.9 * len(set(want)):
                size = len(want) + 4
                best = max(plain_lcs(want, own[at:at + size]) for at in range(0, max(1, len(own) - size + 1), 2))
                if best >= 0.9 * len(want):
                    hits += 1
                    assert item in found[doc]
    assert hits > 0


def test_reworded_passages_come_from_the_latent_space(spark, monkeypatch):
    """Without the search by words, the projection alone finds passages with a fourth of their words changed."""
    monkeypatch.setattr(decontaminate.Postings, "near", lambda self, ids, block, text: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    rng = random.Random(12)
    items = [words(rng, 32) for _ in range(30)]
    rows = []
    for n, item in enumerate(items):
        own = [f"new{n}x{i}" if i % 4 == 1 else w for i, w in enumerate(item)]
        rows.append((n, " ".join(words(rng, 64) + own + words(rng, 64))))
    rows += [(1000 + i, " ".join(words(rng, 160))) for i in range(60)]
    table = spark.createDataFrame([(n, " ".join(item), 1) for n, item in enumerate(items)], ITEMS)
    found = {r["doc_id"]: r["item_ids"] for r in find_contamination(make_docs(spark, rows), table).collect()}
    assert sum(found[n] == [n] for n in range(30)) >= 27
    assert not any(found[i] for i in found if i >= 1000)
