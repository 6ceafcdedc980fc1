"""The pipeline: every stage's decisions take effect, and the next one works on what it left."""

import hashlib

import corpus_pipeline
from samples import odd_rows, texts
from test_llm_near import plain
from voltrail.llm.common import DOCUMENTS, TABLES


def write_tables(spark, folder, rows, labels, items):
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in rows], DOCUMENTS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, TABLES["labels"]).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, TABLES["benchmark"]).write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    line = "this very line stands at the top of a good many documents here"
    passage = " ".join(f"exam{i}" for i in range(40))
    clean = [(i, f"{line}\n{t}") for i, t in enumerate(texts(30, 5, (40, 80)))]
    junk = [(100 + i, f"SALE!! {i} NOW!! " * 40) for i in range(12)]
    copies = [(200 + i, clean[3][1] + " end") for i in range(5)]
    leaks = [(300 + i, f"{t} {passage} {t}") for i, t in enumerate(texts(3, 8))]
    rows = clean + junk + copies + leaks + odd_rows(500)
    labels = [(i, 0, 0) for i in range(100, 106)] + [(i, 1, 0) for i in range(15)]
    docs = write_tables(spark, str(tmp_path), rows, labels, [(1, passage)])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = (before.collect(), docs.collect())
    ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    assert ids(seen["quality"][1]) == sorted(str(i) for i, _ in rows if i is None or not 100 <= i < 112)
    assert ids(seen["line_dedup"][1]) == ids(seen["line_dedup"][0])
    assert sum(line in (r["text"] or "") for r in seen["line_dedup"][1]) == 1
    before, after = seen["near_dedup"]
    groups = plain([(r["doc_id"], r["text"]) for r in before], 5)
    assert ids(after) == sorted({d for d, _, least in groups if d == least})
    before, after = seen["decontamination"]
    assert ids(after) == sorted(i for i in ids(before) if not i.startswith("30"))
    assert set(ids(seen["packing"][1])) == set(ids(after))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert ids(whole.collect()) == ids(seen["packing"][1])


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def stages_of(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        out[name] = docs.collect()
    return out


def test_rows_without_an_id_are_judged_apart(spark, tmp_path):
    """Clean, junk, contaminated and copied rows under no id and under one id; columns of other names are dropped."""
    passage = " ".join(f"exam{i}" for i in range(40))
    clean = texts(6, 9, (60, 80))
    junk = [f"SALE!! {i} NOW!! " * 40 for i in range(15)]
    own = [clean[0], clean[0] + " end", junk[0], junk[1], f"{clean[1]} {passage}", clean[2], clean[2]]
    rows = [(None, t) for t in own] + [(7, t) for t in (clean[3], junk[2], clean[4], f"{passage} {clean[5]}")]
    rows += [(100 + i, t) for i, t in enumerate(junk[3:])] + [(200 + i, t) for i, t in enumerate(texts(30, 5, (40, 80)))]
    labels = [(i, 0, 0) for i in range(100, 106)] + [(200 + i, 1, 0) for i in range(15)]
    docs = write_tables(spark, str(tmp_path), rows, labels, [(1, passage)])
    clash = docs.selectExpr("*", "1 AS kept", "'x' AS _matches", "2 AS _of", "text AS set_key", "3 AS _text_key", "'y' AS component")
    seen = {name: [r for r in rows if r["doc_id"] in (None, 7)] for name, rows in stages_of(spark, clash, tmp_path).items()}
    kept = sorted(((r["doc_id"], r["text"]) for r in seen["decontamination"]), key=str)
    first = min((own[0], own[1]), key=lambda t: hashlib.md5(t.encode()).digest())
    assert len(seen["quality"]) == 8 and len(seen["near_dedup"]) == 6
    assert kept == sorted([(None, first), (None, clean[2]), (7, clean[3]), (7, clean[4])], key=str)
    assert {r["doc_id"] for r in seen["packing"]} == {None, 7}


def test_empty_table(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
