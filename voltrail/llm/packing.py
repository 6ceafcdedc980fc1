"""Conflict-constrained best-fit packing of texts into training sequences.

Texts longer than a bin are cut into pieces. A bin never holds two pieces of one source, nor two of one cluster of
copies. Bins are ordered by the room they have left; the search starts at the smallest room that fits and goes on to the
next larger one until a bin without a conflict is found: the tightest compatible bin. If there is none, a bin is opened.

Pieces are dealt to groups of about `group_pieces` by a hash of the text's id and the piece number, so a source that
holds a third of all texts spreads evenly, and each group is packed on its own, longest pieces first. A group costs at
most a few partly filled bins.

Defined results: null or empty text has no token and one piece of length 0. A null source, and a null cluster, is a
source or cluster of its own. Repeated rows are packed each; they share a cluster, so never a bin. Ties in length go to
the smaller id, then piece. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import SPACE
from voltrail.session import send_to_tasks, written

PACKED = ("doc_id long, piece int, start long, n_tokens long, source string, cluster string, bin_id string, "
          "position int, bin_tokens long")


def plain_text(text: Column) -> Column:
    """In lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[{SPACE}]+", " "))


def text_cluster(text: Column) -> Column:
    """Copies that agree but for case and white space share a cluster; empty texts are no copies of one another."""
    plain = plain_text(text)
    return F.when(plain != "", F.md5(plain))


def word_count(text: Column) -> Column:
    """One more than the spaces between words: no list of the words is made, which would take many times the text."""
    plain = plain_text(text)
    return F.when(plain != "", F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).otherwise(0).cast("long")


#: Stands for a null id on the way through pandas, which has no null among whole numbers.
NO_ID = -(2**63)


class Bins:
    """Open bins by the room left. A room's `common` bitmap holds the sources that all its bins have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.common: dict[int, int] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The number of the tightest bin with room and without conflict; a new one if need be."""
        for at in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[at]
            if self.common[room] & source:
                continue
            for number in self.by_room[room]:
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    self._take(room, number)
                    break
            else:
                continue
            break
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self._put(room - size, number)
        return number

    def _take(self, room: int, number: int) -> None:
        left = self.by_room[room]
        left.remove(number)
        if not left:
            del self.by_room[room], self.common[room]
            del self.rooms[bisect_left(self.rooms, room)]
        else:
            common = -1
            for other in left:
                common &= self.sources[other]
                if not common:
                    break
            self.common[room] = common

    def _put(self, room: int, number: int) -> None:
        if room in self.by_room:
            self.by_room[room].append(number)
            self.common[room] &= self.sources[number]
        else:
            insort(self.rooms, room)
            self.by_room[room] = [number]
            self.common[room] = self.sources[number]


def _bits(values: pd.Series) -> list[int]:
    """A bit per value; a null shares its bit with nothing."""
    codes: dict[object, int] = {}
    return [0 if v is None or v != v else codes.setdefault(v, 1 << len(codes)) for v in values]


def pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins = Bins(capacity)
    # A null source or cluster conflicts with nothing; a cut text's pieces conflict through their own text.
    cuts = _bits(group["cut"])
    sources, clusters = _bits(group["source"]), _bits(group["cluster"])
    width = max([x.bit_length() for x in clusters], default=0)
    numbers = [
        bins.place(int(n), s, c | (t << width))
        for n, s, c, t in zip(group["n_tokens"], sources, clusters, cuts)
    ]
    out = group.assign(number=numbers)
    out["position"] = out.groupby("number").cumcount().astype("int32")
    out["bin_tokens"] = out.groupby("number")["n_tokens"].transform("sum")
    out["bin_id"] = out["part"].astype(str) + "-" + out["number"].astype(str)
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, group_pieces: int = 4096, length: Column | None = None,
                   cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, source, cluster, bin_id, position and bin_tokens: a row per piece.

    `length` counts a text's tokens (words, if not given) and `cluster` names its copies.
    """
    send_to_tasks(__name__)
    text = F.col("text")
    sized = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "source", (cluster if cluster is not None else text_cluster(text)).cast("string").alias("cluster"),
        (length if length is not None else word_count(text)).cast("long").alias("length"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    last = F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("start", F.col("piece").cast("long") * capacity).withColumn(
        "n_tokens", F.least(F.col("length") - F.col("start"), F.lit(capacity))
    ).withColumn("cut", F.when(last > 0, F.col("key").cast("string"))).withColumn("row", F.monotonically_increasing_id())
    # Texts are read once: what follows needs their pieces only.
    cut = written(cut.drop("length"), "packing-pieces")
    parts = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("key", "piece", "row"), F.lit(parts)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, capacity)[[c.split()[0] for c in PACKED.split(", ")]]

    packed = dealt.groupBy("part").applyInPandas(pack, PACKED)
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
