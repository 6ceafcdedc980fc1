"""A Merkle manifest of a dataset by slot pivot, with an inclusion proof for every row.

A row's leaf is the digest of its fields. The leaves of a language, in order of their ids, are the bottom of a tree in
which every `FANOUT` consecutive nodes have one parent; the tops of the languages' trees are the bottom of another one.

Slot pivot: a node's number, modulo the number of slots, is its slot. One conditional aggregate per slot spreads the
children of a parent into columns; concatenating these columns and hashing gives the parent, and the columns of a run
without a node's own slot are its siblings. A pass spreads `LEVELS` levels at once: FANOUT ** LEVELS nodes meet in a row
and the levels between are columns computed in that row. So a tree over n leaves takes log(n) / LEVELS passes, each a
FANOUT ** LEVELS-th of the one before. Passes are written. On the way down a row gives each of its nodes the siblings
inside the row, followed by the path above the row: the bottom pass holds what belongs to a leaf, so the leaves are not
joined again, and no text is shuffled. No row holds more than one run of nodes, however large a language is.

Digests are lowercase hexadecimal SHA-256 of concatenated UTF-8 text. The last run of a level may be shorter, down to one
node, which is hashed alone. A language of one row has its leaf as top.

Defined results: a null field is `-` in the leaf; a null language is a language, ordered first; a null id stands before
all others and is never tampered with. Rows with one id are ordered by their leaves, and repeated rows have a leaf each.
Texts of any length are hashed whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import crc32_sql
from voltrail.llm.ordering import numbered, same
from voltrail.session import written

FANOUT, LEVELS = 2, 4
SPAN = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7
PATH = "array<struct<before:string,after:string>>"


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def _left(total: Column, level: int) -> Column:
    """How many nodes a tree over `total` nodes has `level` levels higher."""
    return F.ceil(total / F.lit(FANOUT**level)).cast("long")


def _run(level: int, first: int) -> list[Column]:
    return [F.coalesce(F.col(f"h{level}_{first + i}"), F.lit("")) for i in range(FANOUT)]


def spread(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """group, nr, total, p<slot> (what the nodes carry) and h<level>_<place>: a row for each SPAN nodes of a group."""
    slot = F.col("nr") % SPAN
    here = [
        F.max(F.when(slot == i, F.struct("node", *carried))).alias(f"p{i}") for i in range(SPAN)
    ]
    rows = nodes.groupBy("group", F.floor(F.col("nr") / SPAN).alias("nr"), "total").agg(*here)
    rows = rows.withColumns({f"h0_{i}": F.col(f"p{i}.node") for i in range(SPAN)})
    for level in range(1, LEVELS + 1):
        grows = _left(F.col("total"), level - 1) > 1
        rows = rows.withColumns({
            f"h{level}_{i}": F.when(
                F.col(f"p{i * FANOUT**level}").isNotNull(),
                F.when(grows, digest(*_run(level - 1, i * FANOUT))).otherwise(F.col(f"h{level - 1}_{i * FANOUT}")))
            for i in range(SPAN // FANOUT**level)
        })
    return rows if carried else rows.drop(*[f"p{i}" for i in range(1, SPAN)])


def climb(nodes: DataFrame, largest: int, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The written passes from the bottom up, and the tops: group, node, pass_no (the pass that made it)."""
    passes, tops, room = [], None, 1
    while not passes or room < largest:
        number = len(passes)
        passes.append(written(spread(nodes, () if passes else carried), f"manifest-pass-{number}"))
        room *= SPAN
        above = passes[-1].select(
            "group", "nr", _left(F.col("total"), LEVELS).alias("total"), F.col(f"h{LEVELS}_0").alias("node"))
        done = above.where("total = 1").select("group", "node", F.lit(number).alias("pass_no"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = above.where("total > 1")
    return passes, tops


def _steps(rows: DataFrame) -> DataFrame:
    """e<level>_<place>: the step from a node to its parent, as an array of one, or of none above the top."""
    steps = {}
    for level in range(LEVELS):
        grows = _left(F.col("total"), level) > 1
        for i in range(SPAN // FANOUT**level):
            run, own = _run(level, i - i % FANOUT), i % FANOUT
            sides = [F.concat(F.lit(""), *run[:own]).alias("before"), F.concat(F.lit(""), *run[own + 1:]).alias("after")]
            steps[f"e{level}_{i}"] = F.when(grows, F.array(F.struct(*sides))).otherwise(F.array().cast(PATH))
    return rows.withColumns(steps)


def descend(passes: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """group, nr, path, top, root and what the leaves carry: a row per node of the bottom pass.

    seeds: group, pass_no, path (the steps above the group's top), top, root.
    """
    above = None
    for number in reversed(range(len(passes))):
        paths = seeds.where(F.col("pass_no") == number).select("group", F.lit(0).cast("long").alias("nr"), "path", "top", "root")
        if above is not None:
            paths = paths.unionByName(written(above.select(*paths.columns), f"manifest-paths-{number}"))
        paths = paths.withColumnsRenamed({"group": "_group", "nr": "_nr"})
        rows = _steps(passes[number].join(paths, same(["group", "nr"], ["_group", "_nr"])))
        bottom = "p1" in passes[number].columns
        children = F.array(*[
            F.struct(
                (F.col("nr") * SPAN + i).alias("nr"), F.col(f"h0_{i}").alias("node"),
                F.concat(*[F.col(f"e{level}_{i // FANOUT**level}") for level in range(LEVELS)], "path").alias("path"),
                *([F.col(f"p{i}").alias("carried")] if bottom else []),
            ) for i in range(SPAN)
        ])
        above = rows.select("group", "top", "root", F.explode(children).alias("child")).select(
            "group", "top", "root", "child.*").where("node IS NOT NULL")
    return above


def _trees(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    largest = nodes.agg(F.max("total")).first()[0] or 0
    passes, tops = climb(nodes, largest, carried)
    return passes, written(tops, "manifest-tops")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, altered (the tampered leaf, if it differs), subroot, root and path: a row per document."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaves = written(
        docs.select("doc_id", F.col("lang").alias("group"), leaf().alias("node"), F.when(hit, leaf(n_chars=more)).alias("altered")),
        "manifest-leaves")
    ordered = written(numbered(leaves, ["group"], ["doc_id", "node"], "manifest-order"), "manifest-numbered")
    passes, tops = _trees(ordered, ["doc_id", "altered"])
    roots = tops.select(F.lit(0).alias("group"), F.col("group").alias("lang"), "node", "pass_no")
    upper = written(numbered(roots, ["group"], ["lang"], "manifest-langs"), "manifest-langs-numbered")
    upper_passes, upper_top = _trees(upper, ["lang", "pass_no"])
    seed = upper_top.select(
        "group", "pass_no", F.array().cast(PATH).alias("path"), F.lit("").alias("top"), F.col("node").alias("root"))
    seeds = descend(upper_passes, seed).select(
        F.col("carried.lang").alias("group"), F.col("carried.pass_no").alias("pass_no"), "path", F.col("node").alias("top"), "root")
    rows = descend(passes, written(seeds, "manifest-seeds"))
    return rows.select(
        "carried.doc_id", F.col("group").alias("lang"), F.col("node").alias("leaf"), "carried.altered",
        F.col("top").alias("subroot"), "root", "path")


def fold(path: Column, bottom: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, bottom, lambda node, step: digest(step["before"], node, step["after"]))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row held against its own proof."""
    rows = manifest(docs)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    checked = rows.withColumn("folded_root", fold(F.col("path"), F.coalesce("altered", "leaf")))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str = "n_chars") -> str:
    def part(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


SQL = f"""WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (ORDER BY lk, doc_id NULLS FIRST, leaf) AS r,
         row_number() OVER (PARTITION BY lk ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nr, count(*) OVER (PARTITION BY lk) AS n
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS lk, {_leaf_sql()} AS leaf,
               CASE WHEN ({crc32_sql("doc_id")}) % {TAMPERED_EVERY} = 0
                    THEN {_leaf_sql('CAST(n_chars AS HUGEINT) + 1')} END AS altered
        FROM documents)),
t(lk, lv, nr, n, h) AS (
  SELECT lk, 0, nr, n, leaf FROM leaves
  UNION ALL
  SELECT lk, lv + 1, nr // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY nr))
  FROM t WHERE n > 1 GROUP BY lk, lv, nr // {FANOUT}, n),
subs AS (SELECT lk, h AS subroot, row_number() OVER (ORDER BY lk) - 1 AS nr, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, nr, n, h) AS (
  SELECT 0, nr, n, subroot FROM subs
  UNION ALL
  SELECT lv + 1, nr // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY nr))
  FROM u WHERE n > 1 GROUP BY lv, nr // {FANOUT}, n),
steps AS (
  SELECT l.r, v.lv, l.nr // CAST({FANOUT} ** v.lv AS BIGINT) AS own, s.h
  FROM leaves l JOIN (SELECT DISTINCT lk, lv FROM t WHERE n > 1) v USING (lk)
  LEFT JOIN t s ON s.lk = l.lk AND s.lv = v.lv AND s.nr = xor(l.nr // CAST({FANOUT} ** v.lv AS BIGINT), 1)
  UNION ALL
  SELECT l.r, 1000 + v.lv, b.nr // CAST({FANOUT} ** v.lv AS BIGINT), s.h
  FROM leaves l JOIN subs b USING (lk) CROSS JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) v
  LEFT JOIN u s ON s.lv = v.lv AND s.nr = xor(b.nr // CAST({FANOUT} ** v.lv AS BIGINT), 1)),
paths AS (
  SELECT r, string_agg(h, '' ORDER BY lv) AS siblings,
         list(CASE WHEN own % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(h, '') ORDER BY lv) AS moves
  FROM steps GROUP BY r),
folded AS (
  SELECT l.doc_id, l.leaf, b.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(l.altered, l.leaf), coalesce(p.moves, [])), lambda a, s: sha256(
           CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM leaves l JOIN subs b USING (lk) LEFT JOIN paths p USING (r))
SELECT *, folded_root = root AS verified FROM folded"""
