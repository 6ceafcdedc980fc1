"""Packing: every bin is valid, every token is placed, and each piece went to the tightest compatible bin."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from samples import make_docs, odd_rows, texts
from voltrail.llm.packing import Bins, pack_documents, word_count


@pytest.mark.parametrize("capacity,pieces", [(100, 4096), (40, 16)])
def test_bins_are_valid(spark, capacity, pieces):
    rows = [(i, t) for i, t in enumerate(texts(80) + texts(10))] + odd_rows(100)
    packed = pack_documents(make_docs(spark, rows), capacity, pieces).toPandas()
    assert len(set(packed["bin_id"])) > 1
    for _, one in packed.groupby("bin_id"):
        assert one["n_tokens"].sum() <= capacity and (one["bin_tokens"] == one["n_tokens"].sum()).all()
        assert one["source"].is_unique and one["cluster"].dropna().is_unique
        assert sorted(one["position"]) == list(range(len(one)))
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len((t or "").split())
    ids = [None if np.isnan(x) else int(x) for x in packed["doc_id"].astype(float)]
    have = pd.Series(packed["n_tokens"].to_list()).groupby(pd.Series([repr(x) for x in ids])).sum()
    assert {repr(k): v for k, v in want.items()} == have.to_dict()


def test_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    bins, plain = Bins(50), []
    for size in sorted(rng.integers(1, 50, 400).tolist(), reverse=True):
        source, cluster = 1 << int(rng.integers(0, 6)), 1 << int(rng.integers(0, 40))
        fits = [(room, n) for n, (room, s, c) in enumerate(plain) if room >= size and not (s & source or c & cluster)]
        number = bins.place(size, source, cluster)
        if fits:
            assert plain[number][0] == min(fits)[0]
            room, s, c = plain[number]
            plain[number] = room - size, s | source, c | cluster
        else:
            assert number == len(plain)
            plain.append((50 - size, source, cluster))


def test_empty_table(spark):
    assert pack_documents(make_docs(spark, [])).count() == 0


def test_groups_are_counted_in_pieces(spark):
    """Few long texts give many pieces, so many groups."""
    docs = make_docs(spark, [(i, " ".join(["word"] * 2000)) for i in range(4)])
    sizes = [r["n"] for r in pack_documents(docs, capacity=10, group_pieces=50).selectExpr(
        "split(bin_id, '-')[0] AS part").groupBy("part").count().toDF("part", "n").collect()]
    assert sum(sizes) == 800 and max(sizes) < 150


def test_words_are_counted_without_a_list_of_them(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, " A\x0b\x0cb  c\r\n"), (5, "\u0130\u00a0x \u3000 y\x1fz"), (6, "\x00 \x00")]
    counted = make_docs(spark, rows).select("doc_id", word_count(F.col("text")).alias("n"))
    assert {r["doc_id"]: r["n"] for r in counted.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 3, 5: 3, 6: 2}
    assert "regexp_extract_all" not in plan_of(counted).lower() and "regexp_count" not in plan_of(counted).lower()


def test_texts_are_read_once(spark):
    """Neither counting the groups nor packing them cuts the texts again."""
    packed = pack_documents(make_docs(spark, [(i, t) for i, t in enumerate(texts(20))]), capacity=40, group_pieces=16)
    assert "regexp_replace" not in plan_of(packed).lower() and packed.count() >= 20
