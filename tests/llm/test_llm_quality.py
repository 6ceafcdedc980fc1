"""The quality model: accuracy on texts outside the fit, and its parts."""

import numpy as np

from samples import make_docs, odd_rows, texts
from voltrail.llm.quality import (
    BAD, GOOD, NAMES, SILENT, QualityModel, judge_quality, label_model, measure, pattern_of, votes_from, votes_of,
)

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    model = QualityModel(docs, labels)
    caught, spared = model.held_out_accuracy(docs)
    assert caught > 0.94 and spared > 0.99
    # Of all labelled texts, most of which the fit has seen.
    judged = model.judge(docs).join(labels, "doc_id")
    assert judged.where("toxic = 1 AND kept").count() <= 0.06 * judged.where("toxic = 1").count()
    assert judged.where("toxic = 0 AND quality = 1 AND NOT kept").count() <= 0.01 * judged.count()


def test_label_model_finds_the_right_labellers():
    rng = np.random.default_rng(1)
    patterns = {}
    fires = {True: (0.7, 0.5, 0.3), False: (0.01, 0.02, 0.01)}
    heuristics = len(NAMES) - 2
    for bad in rng.random(20_000) < 0.2:
        votes = [BAD if rng.random() < r else SILENT for r in fires[bool(bad)]] + [SILENT] * (heuristics - 3)
        votes.append(SILENT if BAD in votes else GOOD)
        votes.append((BAD if bad else GOOD) if rng.random() < 0.1 else SILENT)
        p = pattern_of(votes)
        patterns[p] = patterns.get(p, 0) + 1
    posterior, rates, _ = label_model(patterns)
    assert abs(rates[0, 0, 0] - 0.7) < 0.12 and rates[0, 1, 0] < 0.04 and rates[-1, 0, 0] > rates[-1, 0, 1]
    assert posterior[pattern_of([BAD, BAD] + [SILENT] * heuristics)] > 0.9
    assert posterior[pattern_of([SILENT] * heuristics + [GOOD, SILENT])] < 0.15
    assert all(pattern_of(votes_from(p)) == p for p in patterns)


def test_measurements():
    shout, _ = measure("WHAT!! IS!! THIS!!", frozenset())
    assert votes_of(shout)[:2] == [BAD, BAD]
    clean, parts = measure("You idiot, you.", frozenset([b"idio-"]))
    assert parts == {b"you", b"idiot", b"idio-", b"idiot-"} and votes_of(clean)[-2:] == [SILENT, SILENT]
    assert all(v != BAD for v in votes_of(measure("", frozenset())[0]))


def test_odd_rows(spark):
    junk = [(i, "BUY!! NOW!! " * 30) for i in range(20)]
    rows = junk + [(100 + i, t) for i, t in enumerate(texts(40))] + odd_rows(500)
    labels = spark.createDataFrame(
        [(i, 0, 0) for i in range(10)] + [(100 + i, 1, 0) for i in range(20)] + [(0, None, None), (None, 0, 1)], LABELS)
    judged = judge_quality(make_docs(spark, rows), labels).collect()
    assert len(judged) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in judged}
    assert not any(kept[i] for i in range(20)) and all(kept[100 + i] for i in range(40))
    assert all(kept[500 + i] for i in (0, 1, 2))


def test_without_labels_and_without_texts(spark):
    none = spark.createDataFrame([], LABELS)
    assert judge_quality(make_docs(spark, [(1, "fine words"), (2, None)]), none).count() == 2
    assert judge_quality(make_docs(spark, []), none).count() == 0


def test_posterior_without_the_given_label():
    """Answers whose texts all have a label are judged alike by the rates when that label is silent."""
    bad, good = [BAD] * (len(NAMES) - 1), [GOOD] * (len(NAMES) - 1)
    patterns = {pattern_of([*bad, BAD]): 200, pattern_of([*good, GOOD]): 800}
    posterior, _, _ = label_model(patterns)
    assert posterior[pattern_of([*bad, SILENT])] > 0.99 and posterior[pattern_of([*good, SILENT])] < 0.01
