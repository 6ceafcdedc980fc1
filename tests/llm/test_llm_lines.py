"""The line index: reversible, and equal to plain counting."""

import numpy as np

from samples import make_docs, odd_rows, texts
from voltrail.llm import line_dedup
from voltrail.llm.cuckoo import CuckooFilter
from voltrail.llm.line_dedup import LineIndex, dedup_lines, line_digests, line_refs


def lines_docs(spark, ids, seed=3):
    pool = [t.ljust(40, ".") for t in texts(30, seed, (8, 20))]
    return make_docs(spark, [(i, "\n".join(pool[(i * k) % 30] for k in range(1, 6))) for i in ids])


def state(index):
    counts = {bytes(r["key"]): (r["docs"], r["last_doc"]) for r in index.counts.collect()}
    refs = {(r["doc_id"], bytes(r["key"])) for r in index.refs.collect()}
    return counts, refs


def held(index):
    filters = {r["shard"]: CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()}
    return sum(int((f.table != 0).sum()) for f in filters.values())


def test_insert_then_delete_leaves_no_trace(spark):
    first, more = lines_docs(spark, range(20)), lines_docs(spark, range(20, 35), 8)
    index = LineIndex.of(line_refs(first), shard_keys=8)
    assert index.shards > 1
    before = state(index)
    grown = index.insert(line_refs(more))
    assert state(grown) == state(LineIndex.of(line_refs(first.union(more))))
    assert held(grown) == len(state(grown)[0])
    back = grown.delete(more.select("doc_id"))
    assert state(back) == before and held(back) == len(before[0])
    again = grown.insert(line_refs(more))
    assert state(again) == state(grown)


def test_batches_split_shards_and_give_the_same_index(spark):
    refs = line_refs(lines_docs(spark, range(60)))
    whole = LineIndex.of(refs, shard_keys=4)
    loaded = LineIndex.loaded(refs, batches=5, shard_keys=4)
    assert loaded.shards >= whole.shards > 1
    assert state(loaded) == state(whole) and held(loaded) == len(state(whole)[0])


def test_the_rows_come_through_the_filters(spark, monkeypatch):
    docs = lines_docs(spark, range(40))
    right = {r["doc_id"]: r["n_dropped"] for r in line_digests(docs).collect()}
    assert sum(right.values()) > 0
    monkeypatch.setattr(line_dedup, "_ask", lambda batch, filters: batch[["key", "docs", "last_doc"]].assign(maybe=False))
    assert {r["doc_id"]: r["n_dropped"] for r in line_digests(docs).collect()} != right


def test_a_deletion_writes_its_own_keys_only(spark, monkeypatch):
    docs = lines_docs(spark, range(60))
    index, rows = LineIndex.of(line_refs(docs)), {}
    write = line_dedup.written

    def counted(df, label):
        done = write(df, label)
        rows[label] = done.count()
        return done

    monkeypatch.setattr(line_dedup, "written", counted)
    left = index.delete(docs.where("doc_id = 59").select("doc_id"))
    assert rows["line-refs"] <= 5 and rows["line-counts"] <= 5 and rows["line-changed"] <= 5
    assert state(left) == state(LineIndex.of(line_refs(docs.where("doc_id < 59"))))


def test_empty_table(spark):
    assert line_digests(make_docs(spark, [])).count() == 0
    index = LineIndex.of(line_refs(make_docs(spark, [])))
    more = line_refs(lines_docs(spark, range(8)))
    assert state(index.insert(more)) == state(LineIndex.of(more))


def test_drop_and_keep(spark):
    line = "a line of more than forty code points in all, Ä"
    rows = [(i, f"{line}\nown {i}\n {line.replace('a line', 'A LINE')}\t") for i in range(5)] + odd_rows(100)
    done = {(r["doc_id"], r["text"]): r["line_result"] for r in dedup_lines(make_docs(spark, rows)).collect()}
    for i in range(4):
        assert done[i, rows[i][1]]["kept"] == f"own {i}" and done[i, rows[i][1]]["n_dropped"] == 2
    assert done[4, rows[4][1]]["kept"] == rows[4][1]
    assert done[100, None]["n_lines"] == 1 and done[100, None]["kept"] == ""


def test_cuckoo_filter_grows_and_forgets():
    keys = np.random.default_rng(1).integers(0, 2**60, 5000)
    small = CuckooFilter.build(keys[:100])
    assert len(small.insert(keys[100:])) > 0
    full = CuckooFilter.build(keys)
    assert full.contains(keys).all()
    full.delete(keys[:2500])
    assert full.contains(keys[2500:]).all() and full.contains(keys[:2500]).mean() < 0.01
