"""Near-duplicates against plain comparison of all pairs."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from samples import make_docs, odd_rows, texts
from voltrail.llm import graph, near_dedup
from voltrail.llm.graph import components
from voltrail.llm.near_dedup import NearDuplicates, distance_for, index_keys, key_places, near_duplicates


def word_set(text, words):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return frozenset()
    width = min(words, len(tokens))
    return frozenset(tuple(tokens[i:i + width]) for i in range(len(tokens) - width + 1))


def plain(rows, words):
    """(id, set size, smallest id reachable) per row; ids are unique here but for copies."""
    sets = [word_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = -(2**63)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 2**63), low if doc is None else doc)
    return sorted(
        (str(d), len(s), str(None if least[root(i)] == low else least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("words", [2, 5])
def test_equals_all_pairs(spark, monkeypatch, words):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PIVOT_PAIRS", 4)
    monkeypatch.setattr(near_dedup, "BUCKET_KEYS", 500)
    rng = random.Random(2)
    originals = texts(12, 4, (60, 90))
    rows = []
    for t in originals:
        chain = t
        for step in range(6):
            # Chains of edits: the ends may be apart while each step is near.
            rows.append((len(rows) + 10, chain))
            chain = edited(rng, chain, rng.choice([1, 2, 4, 6]))
    rows += [(len(rows) + 10 + i, t) for i, t in enumerate(texts(15, 6, (1, 7)))]
    rows += [(200, rows[0][1].upper()), (201, rows[0][1].replace(" ", "\n\t "))] + odd_rows(300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert got(near_duplicates(make_docs(spark, rows).coalesce(2), words)) == plain(rows, words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(near_duplicates(docs, 2)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], 2)


def run_counting_pairs(docs, words=2):
    """Rows of the result, and the number of pairs that the last step compares by full sets."""
    compared = []

    class Counting(NearDuplicates):
        def unresolved(self, stars, links, parts):
            found = near_dedup.written(super().unresolved(stars, links, parts), "counted")
            compared.append(found.count())
            return found

    rows = Counting(docs, words, 80).run().collect()
    return [(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows], compared[0]


def test_texts_of_one_template_make_no_pairs(spark):
    rng = random.Random(5)
    common = [f"common{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"own{rng.randrange(10**9)}" for _ in range(8)])) for i in range(300)]
    found, pairs = run_counting_pairs(make_docs(spark, rows))
    assert sorted(found) == plain(rows, 2)
    assert len({c for _, _, c in found}) == 300
    assert pairs < 300


def test_many_edits_of_one_text_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 900)
    monkeypatch.setattr(near_dedup, "BUCKET_KEYS", 300)
    rng = random.Random(6)
    base = texts(1, 9, (60, 61))[0]
    rows = [(i, edited(rng, base, rng.choice([2, 3, 4, 5, 6, 9]))) for i in range(150)]
    found, _ = run_counting_pairs(make_docs(spark, rows))
    assert sorted(found) == plain(rows, 2)


def test_near_misses_of_one_text_make_few_pairs(spark):
    """Each text is about 0.72 like each other one: near enough for signatures and first shingles, not for bitmaps."""
    rng = random.Random(7)
    base = texts(1, 9, (150, 151))[0]
    rows = [(i, edited(rng, base, 6)) for i in range(200)]
    found, pairs = run_counting_pairs(make_docs(spark, rows))
    assert sorted(found) == plain(rows, 2)
    assert pairs < 1000


def test_bitmaps_never_tell_more_than_sets_differ():
    rng = np.random.default_rng(3)
    for size in (1, 50, 700, 9000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 5:], rng.integers(0, 2**63, size // 3).astype(np.uint64)]))
        x, y = (np.frombuffer(near_dedup.bitmap(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum(dtype=int) <= len(np.setxor1d(a, b))


def test_rarest_items_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for size in (1, 4, 5, 9, 10, 61):
        for other in range(size, size * 100 // 80 + 1):
            both = rng.permutation(1000)[:other]
            a, b = np.sort(both[:size]), np.sort(both)
            assert near_dedup.are_similar(a, b, 80)
            firsts = [x[:near_dedup.prefix_length(len(x), 80)] for x in (a, b)]
            assert set(firsts[0]) & set(firsts[1])


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(8)
    distance = distance_for(80)
    for _ in range(200):
        a = rng.integers(0, 2**16, 64).astype(np.uint16)
        b = a.copy()
        b[rng.choice(64, distance, replace=False)] ^= np.uint16(1)
        keys = index_keys(np.stack([a, b]), 80)
        assert set(keys[0]) & set(keys[1])
    assert len(set(key_places(80))) == len(key_places(80))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(3, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in (3, 5, *range(6, 40))}}


@pytest.mark.parametrize("edges", [0, 60, 200_000])
def test_few_edges_cost_no_rounds(spark, monkeypatch, edges):
    """Rounds as long as more edges are left than a task follows, with the same components; few edges are written once."""
    writes, written = [], graph.written
    monkeypatch.setattr(graph, "TASK_EDGES", edges)
    monkeypatch.setattr(graph, "written", lambda df, label: writes.append(label) or written(df, label))
    links = [(i, i + 1) for i in range(100, 160)] + [(i, 5) for i in range(6, 40)] + [(3, 5), (5, 3), (7, 7), (-2, 3)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == 98 and {r["node"]: r["component"] for r in found} == {
        **{i: 100 for i in range(100, 161)}, **{i: -2 for i in (-2, 3, 5, *range(6, 40))}}
    assert len(writes) == 1 if edges == 200_000 else len(writes) > 4


def test_a_turn_looks_up_no_known_sets(spark, monkeypatch):
    labels, written = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, label: labels.append(label) or written(df, label))
    near_duplicates(make_docs(spark, [(i, " ".join(f"w{j}" for j in range(40 + i % 4))) for i in range(20)])).count()
    assert labels.count("near-sure") >= 1 and labels.count("near-needed") <= 2


@pytest.mark.parametrize("bits", [0, 7])
def test_stars_leave_in_small_pieces(bits):
    state = np.random.default_rng(3)
    signatures = state.integers(0, 2**16, (1500, near_dedup.PLACES), np.uint16)
    signatures[700:900] = signatures[5]
    classes = state.permutation(1500).astype(np.int64)
    rows = pd.DataFrame({"cls": classes, "signature": [x.tobytes() for x in signatures]})
    held = {}
    for cls, own in zip(classes.tolist(), index_keys(signatures, 80).tolist()):
        for key in own:
            held.setdefault(key, []).append(cls)
    least, links, sizes = {}, set(), []
    for piece in near_dedup.local_stars(iter([rows]), 80, bits):
        links |= set(piece.loc[piece["a"].notna(), ["a", "b"]].itertuples(index=False, name=None))
        groups = piece[piece["bucket"].notna()]
        keys = [near_dedup.unpack_sorted(x) for x in groups["keys"]]
        sizes.append(sum(map(len, keys)))
        for bucket, own, firsts in zip(groups["bucket"], keys, groups["least"]):
            assert not bits or (own >> np.uint64(64 - bits) == bucket).all()
            least |= dict(zip(own.tolist(), near_dedup.unpack(firsts, np.int64).tolist()))
    assert least == {key: min(own) for key, own in held.items()}
    assert links == {(min(own), cls) for own in held.values() for cls in own if cls != min(own)}
    assert not bits or max(sizes) < 100_000


def test_sets_go_to_tasks_in_small_batches(spark, monkeypatch):
    seen = []
    confirm = NearDuplicates.confirm

    def watched(self, links, count):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return confirm(self, links, count)

    monkeypatch.setattr(NearDuplicates, "confirm", watched)
    rows = [(i, t + " x" * (i % 2)) for i, t in enumerate(t for t in texts(6, 4, (60, 90)) for _ in range(2))]
    near_duplicates(make_docs(spark, rows), 2).collect()
    assert set(seen) == {str(near_dedup.TEXT_ROWS)}


def test_empty_table(spark):
    assert near_duplicates(make_docs(spark, [])).count() == 0
    assert got(near_duplicates(make_docs(spark, [(1, None), (2, "")]))) == [("1", 0, "1"), ("2", 0, "2")]


def test_class_is_usable_alone(spark):
    run = NearDuplicates(make_docs(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h")]), 2, 80)
    assert run.classes.count() == 1
