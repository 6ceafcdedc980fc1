"""The prefix trie against a plain one, with odd rows, in many blocks and shards; the perfect hash on its own."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from check import rows_of
from voltrail.llm import prefix_trie
from voltrail.llm.perfect_hash import PerfectHash

SCHEMA = "conv_id long, turn long, role string, text string, depth int, hi string, shard int, h long"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 130), *range(-25, 0)]:
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["hi there", "what now", "a b\tc"])) for t in range(rng.randint(1, 6))]
    rows += [(5000 + i, t, "user", ["same", "words for all", "here"][t]) for i in range(60) for t in range(3)]
    rows += [(9001, None, "user", "no number"), (9001, 0, None, None), (9001, 0, "user", ""), (9001, 0, "user", "")]
    rows += [(None, 0, "user", "nobody's"), (None, 1, None, None), (9020, 0, "x", "w " * 30_000), (9021, 3, "", "\n")]
    rows += [(9040, t, "user", f"turn {t % 3}") for t in range(23)]
    return rows + [(9041, t, "user", f"turn {t % 3}") for t in range(23)] + [(9043, 0, "user", "lonely")]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, code), role, text))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, abs(c) % 20
        full[c] = tuple(own.get(c - rest if c >= 0 else c + rest, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        value = (len(who) - 1) * len(p[-1][1].split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += value
    return [
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(who) if full[c] == p).encode()).hexdigest())
        for p, who in members.items()]


@pytest.mark.parametrize("block, rows", [(4096, 100_000), (4, 50)])
def test_equals_plain_and_sql(spark, tmp_path, monkeypatch, block, rows):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", rows)
    table = make(spark, conversations())
    got = prefix_trie.prefix_trie(table)
    have = [tuple(r) for r in got.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(have, key=key) == sorted(plain(conversations()), key=key)
    path = str(tmp_path / "conversations.parquet")
    table.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(prefix_trie.SQL)
    assert rows_of(got.columns, have) == rows_of([c[0] for c in result.description], result.fetchall())


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(make(spark, [])).count() == 0


def test_ids_of_a_node_in_many_chunks(spark):
    ends = spark.range(30_000).selectExpr("id % 3 = 0 AS hot", "id").selectExpr(
        "CASE WHEN hot THEN 7L ELSE id END AS hi", "0L AS lo", "id AS conv_id")
    got = {r["hi"]: r["ends_sha256"] for r in prefix_trie.digests_of_ids(ends).collect()}
    want = ",".join(str(i) for i in sorted({*range(0, 30_000, 3), 7}))
    assert len(got) == 20_000 and got[7] == hashlib.sha256(want.encode()).hexdigest()
    assert got[8] == hashlib.sha256(b"8").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 50_000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(-2**63, 2**63 - 1, n) for _ in range(2))
    table = PerfectHash.build(high, low)
    again = PerfectHash.from_bytes(*table.to_bytes())
    assert sorted(table.slots(high, low)) == list(range(n))
    assert (again.slots(high, low) == table.slots(high, low)).all()
    foreign = prefix_trie.find(table, high[np.argsort(table.slots(high, low))], low[np.argsort(table.slots(high, low))], low, high)
    assert (foreign == -1).all()


def test_two_prefixes_of_one_digest_stop_the_job():
    row = {"shard": 0, "conv_id": 1, "hi": 5, "lo": 6, "phi": 1, "plo": 1, "c1": 1, "c2": 1, "depth": 1, "words": 2}
    prefix_trie.build_shard(pd.DataFrame([row, row]))
    with pytest.raises(ValueError):
        prefix_trie.build_shard(pd.DataFrame([row, {**row, "c1": 2}]))
