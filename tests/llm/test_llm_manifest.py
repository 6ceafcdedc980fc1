"""The Merkle manifest against a plain one, with odd rows, and against changed rows and proofs."""

import hashlib
import zlib

import duckdb
import pytest

from check import rows_of
from samples import texts
from voltrail.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, path int, nr long, p0 int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """All levels, from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append(((level[at - 1], "") if at % 2 else ("", level[at + 1] if at + 1 < len(level) else "")))
        at //= 2
    return out


def plain(rows):
    full = []
    for doc_id, text, lang, source, n in rows:
        leaf = H(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        full.append((doc_id, lang, leaf, H(*map(field, (doc_id, source, lang, n + 1, text))) if hit else leaf))
    langs = sorted({r[1] for r in full}, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted([r for r in full if r[1] == x], key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for x in langs]
    trees = [tree([r[2] for r in part]) for part in parts]
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for i, (part, levels) in enumerate(zip(parts, trees)):
        for at, (doc_id, _, leaf, changed) in enumerate(part):
            path = siblings(levels, at) + siblings(top, i)
            node = changed
            for before, after in path:
                node = H(before, node, after)
            out.append((doc_id, leaf, levels[-1][0], root, H(*[a + b for a, b in path]), node, node == root))
    return out


def odd():
    words = texts(60)
    rows = [(i * 3, t, ["en", "de", None, "ü", "z"][i % 5], f"s{i % 2}", len(t)) for i, t in enumerate(words[:50])]
    rows += [(1000, None, "en", None, None), (1001, "", "one", "", 0), (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    rows += [(7, "same", "en", "s", 4)] * 3 + [(7, "other", "en", "s", 5), (8, "Ümläut\n-", "en", "s", 2**63 - 1)]
    rows += [(3, "copy", "copies", "s", 4)] * 37 + [(i, "x", f"l{n}", "s", 1) for n in (15, 16, 17, 33) for i in range(n)]
    return rows + [(2000 + i, "long " * 20_000, "en", "s", 100_000) for i in range(2)]


@pytest.mark.parametrize("rows", [odd(), [(i, "x", f"l{i:03d}", "s", 1) for i in range(40)]], ids=["odd", "languages"])
def test_equals_plain_and_sql(spark, tmp_path, rows):
    docs = make(spark, rows)
    got = manifest.verify_manifest(docs)
    have = [tuple(r) for r in got.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(have, key=key) == sorted(plain(rows), key=key)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(manifest.SQL)
    assert rows_of(got.columns, have) == rows_of([c[0] for c in result.description], result.fetchall())


def test_only_changed_rows_fail(spark):
    rows = manifest.verify_manifest(make(spark, odd())).collect()
    failed = {r["doc_id"] for r in rows if not r["verified"]}
    with_count = {r[0] for r in odd() if r[0] is not None and r[4] is not None}
    assert failed == {i for i in with_count if zlib.crc32(str(i).encode()) % 7 == 0} and failed
    assert len({r["root"] for r in rows}) == 1


def test_another_dataset_has_another_root(spark):
    rows = odd()
    assert manifest.manifest(make(spark, rows)).first()["root"] != manifest.manifest(make(spark, rows[1:])).first()["root"]


def test_empty_table(spark):
    assert manifest.verify_manifest(make(spark, [])).count() == 0
