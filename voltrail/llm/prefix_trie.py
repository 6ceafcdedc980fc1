"""A trie of conversation prefixes in minimal-perfect-hash node tables, one per shard of conversations.

A prefix is known by a digest of 128 bits: the exclusive or of its turns' hashes, each taken with the turn's place. So
prefix digests are running sums, and a conversation is summed block by block: however many turns it has, no task needs
all of them. Conversations are dealt to shards by conversation and block of turns. In a shard the distinct prefixes get
the slots of a minimal perfect hash; each slot holds its prefix's digest, its parent's and its last turn's, and every
row and every later look-up is compared with them: two prefixes of one digest stop the job. Counts are scattered into
flat arrays by slot, and values climb through the array of parent slots, deepest nodes first.

A node that stands in several shards has a part of its counts in each; the parts are added up. What a node brings to its
ancestors is entered once, in the shard of the smallest conversation that has it. Where that conversation goes on in a
later block, what it brings there enters at the last turn of the earlier block. So no shard holds more than its rows,
and no node, however many conversations share it, is gathered anywhere. Digests of conversation ids run over chunks of
ids, in order, with one hash state at a time.

Defined results: rows without a conversation id belong to none. Null roles and texts are empty. Turns are ordered by
their number, null first, then by a digest of role and text; repeated rows are a turn each. Texts of any length are
hashed whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.llm import perfect_hash
from voltrail.llm.common import SPACE, crc32_sql
from voltrail.llm.ordering import numbered
from voltrail.llm.perfect_hash import PerfectHash
from voltrail.session import fan_out, send_to_tasks, written

SHARD_ROWS = 100_000
BLOCK = 4096
CHUNK = 4096
FAMILY, SHARED = 20, 4
ARRAYS = {"hi": np.int64, "lo": np.int64, "phi": np.int64, "plo": np.int64, "c1": np.int64, "c2": np.int64,
          "depth": np.int64, "words": np.int64, "n": np.int64, "conv_id": np.int64, "parent": np.int64}
NODES = ", ".join(f"{c} long" for c in ARRAYS if c != "parent")
TABLE = "shard long, sizes binary, bits binary, " + ", ".join(f"{c} binary" for c in ARRAYS)
SUMS = "hi long, lo long, leaves long, saved long"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, code (a digest of role and text), words, nr from 0 on, total."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("code"),
        F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long").alias("words"))
    # Dealing by ranges reads its input twice: the texts are hashed once before.
    return numbered(written(slim, "trie-slim"), ["conv_id"], ["turn", "code"], "trie-turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, d, code, words: every conversation with the first turns of its family's first one in front.

    The second table has conv_id and length, also of conversations without a turn left.
    """
    convs = turns.where("nr = 0").select(
        "conv_id", "total", (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    convs = written(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", "total", F.least("h", F.coalesce("base_total", F.lit(0))).alias("lent")), "trie-convs")
    own = turns.drop("total").join(convs.select("conv_id", "h", "lent"), "conv_id").where("nr >= h").select(
        "conv_id", (F.col("nr") - F.col("h") + F.col("lent") + 1).alias("d"), "code", "words")
    heads = turns.where(F.col("nr") < SHARED).select(F.col("conv_id").alias("base"), "nr", "code", "words")
    lent = convs.where("lent > 0").select("conv_id", "base", "lent").join(heads, "base").where("nr < lent").select(
        "conv_id", (F.col("nr") + 1).alias("d"), "code", "words")
    length = F.col("lent") + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    return own.unionByName(lent), convs.select("conv_id", length.alias("length"))


def _block(depth: Column) -> Column:
    return F.floor(depth / BLOCK)


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, block, hi, lo, phi, plo, c1, c2, words: a row per conversation and prefix, the empty one included."""
    def hashed(salt: int, *what: str) -> Column:
        return F.xxhash64(F.lit(salt), *what)

    rows = turns.withColumns({
        "h1": hashed(1, "code", "d"), "h2": hashed(2, "code", "d"), "c1": hashed(3, "code"), "c2": hashed(4, "code"),
    }).select("conv_id", F.col("d").alias("depth"), "h1", "h2", "c1", "c2", "words")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "h1", "h2", "c1", "c2", "words")]
    rows = rows.unionByName(lengths.select("conv_id", *none)).withColumn("block", _block(F.col("depth")))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumns({"x1": F.bit_xor("h1").over(inside), "x2": F.bit_xor("h2").over(inside)}), "trie-turn-sums")
    long = rows.join(lengths.where(F.col("length") >= BLOCK).select("conv_id"), "conv_id", "left_semi")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    before = sums.select("conv_id", "block", F.bit_xor("h1").over(earlier).alias("b1"), F.bit_xor("h2").over(earlier).alias("b2"))
    full = rows.join(before, ["conv_id", "block"], "left").withColumns({
        "hi": F.col("x1").bitwiseXOR(F.coalesce("b1", F.lit(0).cast("long"))),
        "lo": F.col("x2").bitwiseXOR(F.coalesce("b2", F.lit(0).cast("long")))})
    return full.select(
        "conv_id", "depth", "block", "hi", "lo", F.col("hi").bitwiseXOR(F.col("h1")).alias("phi"),
        F.col("lo").bitwiseXOR(F.col("h2")).alias("plo"), "c1", "c2", "words")


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the hash and, slot by slot, the arrays of the shard's nodes."""
    hi, lo = rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)
    order = np.lexsort((lo, hi))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
    keys = order[first]
    table = PerfectHash.build(hi[keys], lo[keys])
    arrays = {c: np.zeros(len(keys), kind) for c, kind in ARRAYS.items()}
    own = table.slots(hi[keys], lo[keys])
    for c in ("hi", "lo", "phi", "plo", "c1", "c2", "depth", "words"):
        arrays[c][own] = rows[c].to_numpy(np.int64)[keys]
    slots = table.slots(hi, lo)
    for c in ("hi", "lo", "phi", "plo", "c1", "c2", "depth", "words"):
        if (arrays[c][slots] != rows[c].to_numpy(np.int64)).any():
            raise ValueError("two prefixes have one digest")
    np.add.at(arrays["n"], slots, 1)
    arrays["conv_id"][:] = np.iinfo(np.int64).max
    np.minimum.at(arrays["conv_id"], slots, rows["conv_id"].to_numpy(np.int64))
    arrays["parent"] = find(table, arrays["hi"], arrays["lo"], arrays["phi"], arrays["plo"])
    # What a block brings to earlier ones is entered there.
    arrays["parent"][arrays["depth"] % BLOCK == 0] = -1
    sizes, bits = table.to_bytes()
    return pd.DataFrame({
        "shard": [int(rows["shard"].iloc[0])], "sizes": [sizes], "bits": [bits], **{c: [a.tobytes()] for c, a in arrays.items()}})


def find(table: PerfectHash, hi: np.ndarray, lo: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The slots of these digests, -1 for those the table does not hold."""
    slots = table.slots(high, low)
    there = slots >= 0
    there[there] = (hi[slots[there]] == high[there]) & (lo[slots[there]] == low[there])
    return np.where(there, slots, -1)


def _arrays(row: pd.Series, names) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], ARRAYS[c]) for c in names}


def list_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, row in batch.iterrows():
            yield pd.DataFrame(_arrays(row, [c for c in ARRAYS if c != "parent"]))


def climb_shard(index: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """hi, lo, leaves, saved: what the shard's nodes get from the values entered in it."""
    if not len(index) or not len(values):
        return pd.DataFrame({c.split()[0]: [] for c in SUMS.split(", ")})
    row = index.iloc[0]
    nodes = _arrays(row, ("hi", "lo", "depth", "parent"))
    table = PerfectHash.from_bytes(row["sizes"], row["bits"])
    slots = find(table, nodes["hi"], nodes["lo"], values["hi"].to_numpy(np.int64), values["lo"].to_numpy(np.int64))
    if (slots < 0).any():
        raise ValueError("a value's prefix is not in its shard")
    sums = {c: np.zeros(len(nodes["hi"]), np.int64) for c in ("leaves", "saved")}
    for c, own in sums.items():
        np.add.at(own, slots, values[c].to_numpy(np.int64))
    order = np.argsort(-nodes["depth"], kind="stable")
    for level in np.split(order, np.nonzero(np.diff(nodes["depth"][order]))[0] + 1):
        level = level[nodes["parent"][level] >= 0]
        for own in sums.values():
            np.add.at(own, nodes["parent"][level], own[level])
    got = (sums["leaves"] != 0) | (sums["saved"] != 0)
    return pd.DataFrame({"hi": nodes["hi"][got], "lo": nodes["lo"][got], **{c: own[got] for c, own in sums.items()}})


def chunk_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hi, lo, first, ids: the ids of a node in a batch, which come in order, as one text."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at:at + CHUNK]
            yield part.groupby(["hi", "lo"], sort=False).agg(
                first=("conv_id", "min"), ids=("conv_id", lambda x: ",".join(map(str, x)))).reset_index()


def hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hi, lo, ends_sha256 of chunks in the order of nodes and ids."""
    node, state = None, None
    for batch in batches:
        done = []
        for hi, lo, ids in zip(batch["hi"], batch["lo"], batch["ids"]):
            if (hi, lo) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (hi, lo), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["hi", "lo", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["hi", "lo", "ends_sha256"])


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 from hi, lo, conv_id."""
    tasks = fan_out(ends.sparkSession)
    in_order = ends.repartitionByRange(tasks, "hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    chunks = written(in_order.mapInPandas(chunk_ids, "hi long, lo long, first long, ids string"), "trie-ids")
    together = chunks.repartition(tasks, "hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "ids")
    return together.mapInPandas(hash_ids, "hi long, lo long, ends_sha256 string")


def _one(column: str) -> Column:
    """The value that all parts of a node must share."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(
        F.raise_error(F.lit("two prefixes have one digest")).cast("long")).alias(column)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    for module in (__name__, perfect_hash.__name__):
        send_to_tasks(module)
    turns, lengths = rebuilt(written(turns_in_order(conversations), "trie-numbered"))
    rows = written(prefixes(turns, lengths), "trie-prefixes")
    shards = max(fan_out(rows.sparkSession), -(-rows.count() // SHARD_ROWS))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("conv_id", _block(F.col("depth"))), F.lit(shards)))

    index = written(dealt(rows).groupBy("shard").applyInPandas(build_shard, TABLE), "trie-index")
    parts = index.select([c for c in index.columns if c not in ("sizes", "bits", "parent")]).mapInPandas(list_nodes, NODES)
    nodes = written(parts.groupBy("hi", "lo").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *[_one(c) for c in ("phi", "plo", "c1", "c2", "depth", "words")]), "trie-nodes")
    inner = nodes.where("depth > 0")
    kids = inner.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, ["hi", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-counted")
    values = nodes.select(
        "conv_id", "depth", "hi", "lo", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    entered = dealt(values.unionByName(_from_later_blocks(rows, values))).where("leaves <> 0 OR saved <> 0")
    sums = entered.groupBy("shard").cogroup(
        index.select("shard", "sizes", "bits", "hi", "lo", "depth", "parent").groupBy("shard")
    ).applyInPandas(lambda given, own: climb_shard(own, given), SUMS)
    total = sums.groupBy("hi", "lo").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = rows.join(lengths.withColumnsRenamed({"length": "depth"}), ["conv_id", "depth"], "left_semi").select("hi", "lo", "conv_id")
    parents = nodes.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    whole = nodes.join(total, ["hi", "lo"], "left").join(digests_of_ids(ends), ["hi", "lo"], "left").join(
        parents, ["phi", "plo", "depth"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def _from_later_blocks(rows: DataFrame, values: DataFrame) -> DataFrame:
    """What a conversation's nodes bring in later blocks, entered at the last turn of each earlier block."""
    later = values.where(F.col("depth") >= BLOCK).groupBy("conv_id", _block(F.col("depth")).alias("block")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    at_end = rows.where(F.col("depth") % BLOCK == BLOCK - 1).select("conv_id", "block", "depth", "hi", "lo")
    none = F.lit(0).cast("long")
    both = at_end.withColumns({"leaves": none, "saved": none}).unionByName(
        later.withColumns({c: F.lit(None).cast("long") for c in ("depth", "hi", "lo")}))
    after = Window.partitionBy("conv_id").orderBy(-F.col("block")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumns({c: F.coalesce(F.sum(c).over(after), none) for c in ("leaves", "saved")}).where(
        "hi IS NOT NULL").select("conv_id", "depth", "hi", "lo", "leaves", "saved")


SQL = f"""WITH t AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) - 1 AS nr
  FROM (SELECT *, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS code
        FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
              FROM conversations WHERE conv_id IS NOT NULL))),
conv AS (SELECT c, count(*) AS n, c - c % {FAMILY} AS base, ({crc32_sql('c')}) % {SHARED} AS h FROM t GROUP BY c),
v AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS lent FROM conv a LEFT JOIN conv b ON b.c = a.base),
r AS (
  SELECT v.c, nr + 1 AS d, role, text FROM v JOIN t ON t.c = v.base AND nr < lent
  UNION ALL SELECT v.c, nr - h + lent + 1, role, text FROM v JOIN t ON t.c = v.c AND nr >= h),
k AS (
  SELECT c, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d) AS key,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM v),
node AS (
  SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         key[:-65] AS up FROM k GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
sums AS (
  SELECT k.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * x.words) AS saved_tokens
  FROM full_node x JOIN k ON k.c = x.conv_id AND k.d <= x.depth GROUP BY k.key),
ends AS (
  SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
  FROM k JOIN (SELECT c, max(d) AS d FROM k GROUP BY c) USING (c, d) GROUP BY key)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_node x JOIN sums USING (key) LEFT JOIN ends USING (key)
LEFT JOIN node p ON x.depth > 0 AND p.key = x.up"""
