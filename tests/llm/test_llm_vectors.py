"""Nearest vectors against brute force."""

import numpy as np
import pytest

from voltrail.llm import vectors
from voltrail.llm.vectors import nearest


def brute(rows, most=20):
    ids = [i for i, _ in rows]
    matrix = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, matrix):
        if i % 20 == 0:
            scores = matrix @ v
            order = sorted((-s, j) for j, s in zip(ids, scores) if j != i)[:most]
            out[i] = [(j, -s) for s, j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cls string")


def recall(got, want):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("shard_rows", [16384, 150])
def test_recall_on_given_vectors(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, want = found(nearest(table, shard_rows=shard_rows)), brute(rows)
    assert set(got) == set(want) and recall(got, want) > 0.95
    scores = {(q, j): s for q, near in want.items() for j, s in near}
    for q, near in got.items():
        for j, s in near:
            assert (q, j) not in scores or s == pytest.approx(scores[q, j], rel=1e-12)


def test_copies_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(200)]
    rows += [(500 + i, (5 * np.array(rows[i][1])).tolist()) for i in range(60)]
    got, want = found(nearest(frame(spark, rows))), brute(rows)
    assert recall(got, want) > 0.9
    assert [j for j, _ in got[300]] == [j for j, _ in want[300]]


def test_odd_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)]
    odd = [(20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (23, [float("inf"), 1.0]), (24, [None, 1.0]),
           (25, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [9.0, 9.0]), (4, rows[4][1])]
    got = found(nearest(frame(spark, rows + odd)))
    assert {q: [j for j, _ in n] for q, n in got.items()} == {0: [3, 4, 3, 2, 1]}


def test_every_vector_of_an_id_is_found_and_asked(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [3.0, 3.0]), (20, [2.0, 0.0]), (20, [0.0, 2.0]), (7, [1.0, 1.0])]
    answers = {}
    for r in nearest(frame(spark, rows)).orderBy("query_id", "query_vector", "rank").collect():
        answers.setdefault(r["query_vector"], []).append((r["vec_id"], r["score"]))
    want = [[(5, 6.0), (5, 2.0), (7, 2.0), (5, 0.0), (20, 0.0)]] * 2
    assert list(answers.values()) == want


def test_empty_table(spark):
    assert nearest(frame(spark, [])).count() == 0
    assert nearest(frame(spark, [(20, [1.0])])).count() == 0
    assert vectors.usable(frame(spark, [(1, [])])).count() == 0
