"""Approximate nearest neighbours by inner product: one small-world graph per shard, answers of all shards merged.

Equal vectors are one node that knows its `NEAREST` + 1 smallest ids: no answer needs more of them. Every vector gets one
more component that brings it to the largest length there is, so the largest inner product is the nearest vector. Nodes
are dealt to shards of about `SHARD_ROWS` by a hash; a shard's graph, vectors and ids are one row of flat arrays, written
once. Queries meet every shard, in blocks, as the method asks; scores are computed again in double precision.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do those without
an id or of another dimension than most rows have (ties: the smaller one). Different vectors under one id are candidates
and queries each on their own, also for each other, told apart by `query_vector`, a hash of the query's vector; a row
repeated whole is one row. A query finds all candidates if there are fewer than `NEAREST`. An empty table gives no rows.
Extra columns are ignored. Equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.llm import hnsw
from voltrail.session import send_to_tasks, written

NEAREST = 20
SHARD_ROWS = 16384
QUERY_BLOCK = 2048
WIDTH = 128
LEVELS = "shard long, classes binary, vectors binary, dim int, levels array<struct<nodes:binary,links:binary>>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: the distinct usable rows, all of the commonest dimension."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    other = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & other)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is not None:
        rows = rows.where(F.size("embedding") == sizes["dim"])
    return rows.distinct()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float32) for x in column]) if len(column) else np.zeros((0, 0), np.float32)


def build_shard(group: pd.DataFrame, longest: float) -> pd.DataFrame:
    group = group.sort_values("order")
    plain = _matrix(group["embedding"])
    rest = np.sqrt(np.maximum(longest**2 - (plain.astype(np.float64) ** 2).sum(1), 0)).astype(np.float32)
    vectors = np.column_stack([plain, rest])
    return pd.DataFrame({
        "shard": [int(group["shard"].iloc[0])], "classes": [group["cls"].to_numpy(np.int64).tobytes()],
        "vectors": [vectors.tobytes()], "dim": [vectors.shape[1]],
        "levels": [[{"nodes": n.tobytes(), "links": l.tobytes()} for n, l in hnsw.build(vectors)]],
    })


def search_shard(index: pd.DataFrame, queries: pd.DataFrame, most: int, width: int) -> pd.DataFrame:
    """query_id, query_vector, cls, score: the nearest nodes that the shard's graph finds."""
    if not len(index) or not len(queries):
        return pd.DataFrame({"query_id": [], "query_vector": [], "cls": [], "score": []})
    row = index.iloc[0]
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
    classes = np.frombuffer(row["classes"], np.int64)
    graph = []
    for level in row["levels"]:
        nodes = np.frombuffer(level["nodes"], np.int32)
        graph.append((nodes, np.frombuffer(level["links"], np.int32).reshape(len(nodes), -1)))
    out = []
    ids, prints = queries["query_id"].to_numpy(np.int64), queries["query_vector"].to_numpy(np.int64)
    plain = _matrix(queries["embedding"])
    for at in range(0, len(ids), 256):
        asked = plain[at:at + 256]
        padded = np.column_stack([asked, np.zeros(len(asked), np.float32)])
        pool, sims = hnsw.search(vectors, graph, padded, width)
        top = np.argsort(-sims, axis=1)[:, :most]
        found, good = np.take_along_axis(pool, top, 1), np.isfinite(np.take_along_axis(sims, top, 1))
        exact = np.einsum("nkd,nd->nk", vectors[np.maximum(found, 0), :-1].astype(np.float64), asked.astype(np.float64))
        which = np.nonzero(good)
        out.append(pd.DataFrame({
            "query_id": ids[at + which[0]], "query_vector": prints[at + which[0]], "cls": classes[found[which]],
            "score": exact[which]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, most: int = NEAREST, every: int = 20, shard_rows: int = SHARD_ROWS, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score, query_vector: for ids divisible by `every` the `most` nearest other rows found."""
    for module in (__name__, hnsw.__name__):
        send_to_tasks(module)
    rows = written(usable(vectors), "ann-vectors")
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nr", F.row_number().over(by_id)).where(F.col("nr") <= most + 1)
    nodes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("cls", F.monotonically_increasing_id()), "ann-nodes")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest = nodes.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    shards = max(1, -(-total // shard_rows))
    dealt = nodes.select(
        "cls", "embedding", F.xxhash64("embedding", F.lit(1)).alias("order"),
        F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("shard"))
    index = written(dealt.groupBy("shard").applyInPandas(lambda g: build_shard(g, longest), LEVELS), "ann-index")
    vector = F.xxhash64("embedding")
    asked = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), vector.alias("query_vector"), "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    found = copies.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInPandas(
        lambda i, q: search_shard(i, q, most + 1, width), "query_id long, query_vector long, cls long, score double")
    # Each of a query's best nodes gives a row at least, but for its own: one more than `most` nodes are enough.
    near = found.join(nodes.select("cls", "ids", vector.alias("vector")), "cls")
    best = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), F.col("ids")[0], "vector")
    near = near.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= most + 1)
    each = near.select("query_id", "query_vector", "vector", "score", F.explode("ids").alias("vec_id")).where(
        "vec_id <> query_id OR vector <> query_vector")
    order = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), "vec_id", "vector")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_vector")
