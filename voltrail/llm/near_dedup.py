"""Near-duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature has `PLACES` symbols of b = 16 bits: the low bits of the minimum of one hash function each over a text's
shingles. Two sets of similarity s differ in each place with probability 1 - s. `distance_for` picks the distance that a
pair of the least similarity exceeds once in 800,000 pairs. Signatures are cut into chunks; of a pair within the
distance some chunk has at most `errors` differing places (pigeonhole). So each chunk gives a key for every choice of
places that may be wrong, made of the others, and every pair within the distance shares a key.

No group of a key is expanded into pairs. Copies of one set are one class. Per batch of classes and key, the classes
link to the smallest one, and the batches' smallest ones to the smallest of all (stars). Of the stars' links within the
distance, each class's nearest one is confirmed first, then the nearest few between components that are still apart, and
so on until none is left. A key whose classes are then in one component has nothing left to give. The classes of the
other keys meet by their rarest shingles: of two similar sets of n and m shingles, the n - ceil(0.8 n) + 1 and
m - ceil(0.8 m) + 1 rarest ones have one in common, whatever the order of rarity (here: the number of such classes that
hold it). Those that share one, are in different components, and could still share enough of the shingles after it are
compared by signature and by bitmap, block by block; the pairs within the distance, which share a key, are confirmed. A
bitmap holds the parity of the number of a set's shingles in each of `BITS` places, so the places in which two of them
differ are at most the shingles that only one set has: pairs with too many are no copies for certain. So every pair
that shares a key is linked, disproved or joined, and texts of one template that are no copies make no pairs.

Defined results: null or empty text, and text without words, has no shingle and is its own component. A null id counts
as the smallest id. Repeated rows are copies; rows repeated with one id are all kept or all dropped by `near_duplicates`,
and one of them stays in `without_near_duplicates`. Extra columns are
ignored. An empty table gives no rows. Whole texts count, however long. Shingles go by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.llm import blobs
from voltrail.llm.blobs import pack, pack_sorted, unpack, unpack_sorted
from voltrail.llm.graph import components
from voltrail.session import TEXT_ROWS, arrow_rows, fan_out, large_rows_written, send_to_tasks, work_folders_removed, written

SIMILARITY = 80
PLACES, CHUNKS = 64, 10
MISS = 1.25e-6
BUCKET_KEYS = 250_000
BLOCK = 1024
BITS = 2048
PIVOT_PAIRS = 4096
STAR_ROWS = 4096
PIECE_KEYS = 65_536
CHUNK_SHINGLES = 500_000
TASK_LINKS = 5000
NO_ID = -(2**63)

SETS = "doc_id long, text_key binary, n_shingles long, set_key binary, signature binary"


def distance_for(similarity: int, places: int = PLACES) -> int:
    """The least distance that a pair of this similarity (in hundredths) exceeds with a probability of at most MISS."""
    differ = 1 - similarity / 100
    tail, at = 0.0, places
    while at > 0:
        tail += math.comb(places, at) * differ**at * (1 - differ) ** (places - at)
        if tail > MISS:
            return at
        at -= 1
    return 0


def key_places(similarity: int) -> list[tuple[int, ...]]:
    """For every chunk and every choice of wrong places in it, the places that make its key."""
    errors = distance_for(similarity) // CHUNKS
    keys = []
    for chunk in np.array_split(np.arange(PLACES), CHUNKS):
        keys += combinations(chunk.tolist(), max(1, len(chunk) - errors))
    return keys


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, words: int, known: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit numbers; all words are one shingle if they are too few."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    keys = np.full(len(tokens) - width + 1, width, np.uint64)
    for at in range(width):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + len(keys)])
    return np.unique(keys)


def _factors() -> np.ndarray:
    state = np.random.default_rng(20)
    return state.integers(1, 2**63, PLACES, np.uint64) << np.uint64(1) | np.uint64(1)


def signature(keys: np.ndarray) -> np.ndarray:
    least = np.full(PLACES, 2**64 - 1, np.uint64)
    factors = _factors()[:, None]
    for at in range(0, len(keys), 16384):
        hashed = keys[None, at:at + 16384] * factors
        least = np.minimum(least, (hashed ^ (hashed >> np.uint64(29))).min(1))
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def set_key(keys: np.ndarray) -> bytes:
    sums = _mixed(keys + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(keys ^ np.uint64(0x5DEECE66D)))
    return np.array(sums, np.uint64).tobytes()


def bitmap(keys: np.ndarray) -> bytes:
    """The parity of the number of keys in each of `BITS` places."""
    return np.packbits(np.bincount((_mixed(keys) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def describe(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known = WordHashes()
        rows = []
        for doc, name, text in zip(batch["doc_id"].tolist(), batch["text_key"], batch["text"]):
            keys = shingles(text, words, known)
            rows.append((doc, name, len(keys), *((set_key(keys), signature(keys).tobytes()) if len(keys) else (None, None))))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "set_key", "signature"])


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint16).reshape(-1, PLACES)


def index_keys(signatures: np.ndarray, similarity: int) -> np.ndarray:
    """A row of keys per signature."""
    places = key_places(similarity)
    symbols = signatures.astype(np.uint64)
    out = np.empty((len(symbols), len(places)), np.uint64)
    for number, own in enumerate(places):
        key = np.full(len(symbols), number + 1, np.uint64)
        for place in own:
            key = key * np.uint64(0x100000001B3) + symbols[:, place] + np.uint64(1)
        out[:, number] = _mixed(key)
    return out


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


STARS = "bucket long, keys binary, least binary, a long, b long"


def local_stars(batches: Iterator[pd.DataFrame], similarity: int, bits: int) -> Iterator[pd.DataFrame]:
    """Per batch: links to the smallest class of each key, and that class for the bucket that owns the key.

    They leave in pieces of about PIECE_KEYS links or keys, as a piece passes through memory whole.
    """
    for batch in (whole.iloc[at:at + STAR_ROWS] for whole in batches for at in range(0, len(whole), STAR_ROWS)):
        batch = batch.sort_values("cls")
        classes = batch["cls"].to_numpy(np.int64)
        keys = index_keys(_signatures(batch["signature"]), similarity)
        flat, width = keys.ravel(), keys.shape[1]
        # Stable, so that classes ascend under each key.
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], classes[order // width]
        starts = _starts(flat)
        least = np.repeat(owner[starts], np.diff(np.append(starts, len(flat))))
        apart = least != owner
        pairs = np.unique(np.stack([least[apart], owner[apart]], 1), axis=0)
        del keys, order, least, apart
        for at in range(0, len(pairs), PIECE_KEYS):
            yield _rows(a=pairs[at:at + PIECE_KEYS, 0], b=pairs[at:at + PIECE_KEYS, 1])
        flat, owner = flat[starts], owner[starts]
        bucket = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
        cuts = _starts(bucket)
        for own in np.split(cuts, _starts(cuts // PIECE_KEYS)[1:]):
            end = cuts[np.searchsorted(cuts, own[-1]) + 1] if own[-1] < cuts[-1] else len(flat)
            yield _rows(
                bucket=bucket[own], keys=[pack_sorted(x) for x in np.split(flat[own[0]:end], own[1:] - own[0])],
                least=[pack(x) for x in np.split(owner[own[0]:end], own[1:] - own[0])])


def _rows(**columns) -> pd.DataFrame:
    out = pd.DataFrame({"bucket": None, "keys": None, "least": None, "a": None, "b": None} | columns)
    return out.astype({c: "Int64" for c in ("bucket", "a", "b")})


def join_stars(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the batches' smallest classes of each key."""
    keys = np.concatenate([unpack_sorted(x) for x in group["keys"]])
    least = np.concatenate([unpack(x, np.int64) for x in group["least"]])
    order = np.lexsort((least, keys))
    keys, least = keys[order], least[order]
    starts = _starts(keys)
    first = np.repeat(least[starts], np.diff(np.append(starts, len(keys))))
    pairs = np.unique(np.stack([first, least], 1)[first != least], axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def packed_sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """The sets of classes, from the text of a document that has it."""
    for batch in batches:
        known = WordHashes()
        rows = []
        for cls, key, text in zip(batch["cls"].tolist(), batch["set_key"], batch["text"]):
            keys = shingles(text, words, known)
            if len(keys) and set_key(keys) == bytes(key):
                rows.append((cls, pack_sorted(keys)))
        yield pd.DataFrame(rows, columns=["cls", "items"])


def bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"cls": batch["cls"], "bitmap": [bitmap(unpack_sorted(x)) for x in batch["items"]]})


def are_similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def prefix_length(size: int, similarity: int) -> int:
    """So many of a set's rarest items hold one of those of any similar set."""
    return size + (-size * similarity) // 100 + 1


def ask_counts(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The distinct shingles of a chunk of classes, and in how many of these each is, for the buckets that own them."""
    keys, counts = np.unique(np.concatenate([unpack_sorted(x) for x in group["items"]]), return_counts=True)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = _starts(bucket)[1:]
    return pd.DataFrame({
        "bucket": bucket[np.append(0, cuts)], "chunk": int(group["chunk"].iat[0]),
        "keys": [pack_sorted(x) for x in np.split(keys, cuts)], "counts": [pack(x) for x in np.split(counts, cuts)]})


def answer_counts(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk that asked, its shingles that two or more classes hold, with their number."""
    asked = [unpack_sorted(x) for x in group["keys"]]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, np.concatenate([unpack(x, np.int64) for x in group["counts"]]))
    rows = []
    for chunk, own in zip(group["chunk"].tolist(), np.split(counts[place], np.cumsum([len(x) for x in asked])[:-1])):
        own_keys = asked[len(rows)]
        rows.append((chunk, pack_sorted(own_keys[own > 1]), pack(own[own > 1])))
    return pd.DataFrame(rows, columns=["chunk", "keys", "counts"])


def rarest_shared(own: pd.DataFrame, known: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """key, cls, component, place: the shared ones among each class's rarest shingles, by their place in its order."""
    none = np.zeros(0, np.uint64)
    keys = np.concatenate([none, *(unpack_sorted(x) for x in known["keys"])])
    counts = np.concatenate([none.astype(np.int64), *(unpack(x, np.int64) for x in known["counts"])])
    order = np.argsort(keys)
    # A last key without a count, so that a search always ends on one.
    keys, counts = np.append(keys[order], np.uint64(2**64 - 1)), np.append(counts[order], 1)
    found = []
    for cls, component, packed in zip(own["cls"].tolist(), own["component"].tolist(), own["items"]):
        items = unpack_sorted(packed)
        at = np.searchsorted(keys, items)
        held = np.where(keys[at] == items, counts[at], 1)
        first = np.lexsort((items, held))[:prefix_length(len(items), similarity)]
        place = np.flatnonzero(held[first] > 1)
        found.append((items[first[place]].view(np.int64), np.full(len(place), cls), np.full(len(place), component), place))
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [none.astype(np.int64)] * 4
    return pd.DataFrame(dict(zip(("key", "cls", "component", "place"), columns)))


class Members:
    """Classes of one key's blocks i and j, as arrays."""

    COLUMNS = ("cls", "component", "n_shingles", "place", "block")

    def __init__(self, rows: pd.DataFrame):
        self.cls, self.component, self.size, self.place, self.block = (rows[c].to_numpy(np.int64) for c in self.COLUMNS)
        self.signature = _signatures(rows["signature"])
        self.bitmap = np.frombuffer(b"".join(map(bytes, rows["bitmap"])), np.uint64).reshape(-1, BITS // 64)
        self.after = self.size - self.place

    def pairs(self, start: int, end: int, group: np.ndarray, distance: int, similarity: int) -> np.ndarray:
        """a, b, apart: pairs across blocks i and j of different components, within the distance, that bitmaps allow.

        `group` is i, j. Of a pair whose first common shingle is the key, at most as many are common as either has from
        there on; so a pair that is similar passes at its first common key, though it may not at others.
        """
        i, j = group.tolist()
        own = np.arange(start, end)
        left, right = own[self.block[own] == i], own[self.block[own] == j]
        after, found = self.after, []
        for nth, at in enumerate(left.tolist()):
            others = right[nth + 1:] if i == j else right
            others = others[self.component[others] != self.component[at]]
            most = np.minimum(after[others], after[at])
            others = others[(100 + similarity) * most >= similarity * (self.size[others] + self.size[at])]
            if len(others):
                apart = (self.signature[others] != self.signature[at]).sum(1)
                others, apart = others[apart <= distance], apart[apart <= distance]
                alone = np.bitwise_count(self.bitmap[others] ^ self.bitmap[at]).sum(1, dtype=np.int64)
                allowed = (100 + similarity) * alone <= (100 - similarity) * (self.size[others] + self.size[at])
                others, apart = others[allowed], apart[allowed]
                ends = np.minimum(self.cls[others], self.cls[at]), np.maximum(self.cls[others], self.cls[at])
                found.append(np.stack([*ends, apart], 1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def compare_groups(batches: Iterator[pd.DataFrame], distance: int, similarity: int) -> Iterator[pd.DataFrame]:
    """Pairs within each (key, i, j), whose rows follow one another; the last group of a batch waits for the next."""
    waiting = None
    for batch in chain(batches, [None]):
        rows = waiting if batch is None else batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if rows is None or rows.empty:
            continue
        groups = rows[["key", "i", "j"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]).any(1)]))
        last = len(rows) if batch is None else int(starts[-1])
        waiting = rows.iloc[last:].reset_index(drop=True)
        members, found = Members(rows.iloc[:last]), [np.zeros((0, 3), np.int64)]
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            if start < last:
                found.append(members.pairs(start, end, groups[start, 1:], distance, similarity))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "apart": pairs[:, 2].astype(np.int32)})


class NearDuplicates:
    """One run over `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int, similarity: int):
        for module in (__name__, blobs.__name__):
            send_to_tasks(module)
        self.words, self.similarity = words, similarity
        self.items: DataFrame | None = None
        self.texts = docs.select(
            F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
        with arrow_rows(docs.sparkSession, TEXT_ROWS):
            self.sets = written(self.texts.mapInPandas(lambda b: describe(b, words), SETS), "near-sets")
        grouped = self.sets.where("n_shingles > 0").groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"))
        self.classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()), "near-classes")

    def star_links(self) -> DataFrame:
        """a, b: the links of all stars. Sets under 4 shingles (at 80 of 100) are similar to none but their copies."""
        least_size = math.ceil(self.similarity / (100 - self.similarity)) if self.similarity < 100 else math.inf
        indexed = self.classes.where(F.col("n_shingles") >= least_size).select("cls", "signature")
        similarity = self.similarity
        bits = max(0, math.ceil(math.log2(max(1, indexed.count() * len(key_places(similarity)) / BUCKET_KEYS))))
        local = large_rows_written(indexed.mapInPandas(lambda b: local_stars(b, similarity, bits), STARS), "near-stars")
        across = local.where("bucket IS NOT NULL").select("bucket", "keys", "least").groupBy("bucket").applyInPandas(
            join_stars, "a long, b long")
        return written(local.where("a IS NOT NULL").select("a", "b").union(across).distinct(), "near-stars")

    def plausible(self, links: DataFrame) -> DataFrame:
        """a, b, apart: the links whose sizes allow the similarity and whose signatures are within the distance."""

        @F.pandas_udf("int")
        def distance(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series((_signatures(x) != _signatures(y)).sum(1).astype(np.int32))

        known = self.classes.select("cls", "n_shingles", "signature")
        for x in "ab":
            links = links.join(known.toDF(x, f"size_{x}", f"signature_{x}"), x)
        sized = links.where(100 * F.least("size_a", "size_b") >= self.similarity * F.greatest("size_a", "size_b"))
        measured = sized.select("a", "b", distance("signature_a", "signature_b").alias("apart"))
        return measured.where(F.col("apart") <= distance_for(self.similarity))

    def sets_of(self, links: DataFrame) -> DataFrame:
        """cls, items: the full sets of these links' classes, each cut from its text once in a run."""
        words, wanted = self.words, links.select("a").union(links.select("b")).distinct().toDF("cls")
        if self.items is not None:
            wanted = wanted.join(self.items.select("cls"), "cls", "left_anti")
        wanted = written(wanted, "near-needed")
        if self.items is not None and wanted.isEmpty():
            return self.items
        needed = self.classes.join(wanted, "cls", "left_semi").select(
            "cls", "set_key", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
        # The first time one plan at every size, as what is needed grows with the texts; later it is little, as a rule.
        needed = needed.hint("merge") if self.items is None else needed
        texts = self.texts.join(needed, ["doc_id", "text_key"]).select("cls", "set_key", "text")
        with arrow_rows(texts.sparkSession, TEXT_ROWS):
            cut = large_rows_written(texts.mapInPandas(lambda b: packed_sets(b, words), "cls long, items binary"), "near-cut")
        more = large_rows_written(cut.dropDuplicates(["cls"]), "near-items")
        self.items = more if self.items is None else self.items.unionByName(more)
        return self.items

    def confirm(self, links: DataFrame, count: int) -> DataFrame:
        """The `count` links whose full sets are similar. A class with many links meets them in parts of PIVOT_PAIRS.

        The callers have cut the sets of all links.
        """
        similarity, items, tasks = self.similarity, self.items, math.ceil(count / TASK_LINKS) or 1
        dealt = links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).cast("int").alias("parts"))
        dealt = written(dealt.coalesce(tasks), "near-dealt")
        left = items.join(dealt, F.col("cls") == F.col("a")).select(
            "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("items").alias("items_a"))
        right = items.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
        pairs = links.join(dealt, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        # Written, so that Spark knows their size and moves no sets to a few pairs.
        pairs = written(pairs.select("a", "b", "part"), "near-pairs")

        @F.pandas_udf("boolean")
        def similar(items_a: pd.Series, items_b: pd.Series) -> pd.Series:
            return pd.Series([are_similar(unpack_sorted(x), unpack_sorted(y), similarity) for x, y in zip(items_a, items_b)], dtype=bool)

        both = pairs.join(right, "b").join(left, ["a", "part"])
        return both.where(similar("items_a", "items_b")).select("a", "b")

    def between(self, links: DataFrame, parts: DataFrame) -> DataFrame:
        """a, b, apart and x, y: links between different components x and y."""
        own = parts.select("node", "component")
        for end in "ab":
            links = links.join(own.toDF(end, f"component_{end}"), end, "left").withColumn(
                f"component_{end}", F.coalesce(f"component_{end}", end))
        apart = links.where("component_a <> component_b")
        return apart.select(
            "a", "b", "apart", F.least("component_a", "component_b").alias("x"), F.greatest("component_a", "component_b").alias("y"))

    def open_classes(self, stars: DataFrame, parts: DataFrame) -> DataFrame:
        """cls, component: all classes of keys that hold three or more of them, in different components; some others as well.

        The links of such a key's star hang together, so one of them crosses components and has another one at an end.
        A star of stars is two links deep: from the ends of any of its links, three steps reach all of it.
        """
        steps = stars.select("a", "b").union(stars.select("b", "a")).toDF("cls", "next")
        ties = steps.groupBy("cls").agg(F.count(F.lit(1)).alias("ties"))
        apart = self.between(stars.withColumn("apart", F.lit(0)), parts).select("a", "b")
        for end in "ab":
            apart = apart.join(ties.toDF(end, f"ties_{end}"), end)
        apart = apart.where("ties_a > 1 OR ties_b > 1")
        found = written(apart.select("a").union(apart.select("b")).distinct().toDF("cls"), "near-open")
        for _ in range(3):
            found = written(steps.join(found, "cls").select("next").union(found).distinct().toDF("cls"), "near-open")
        named = found.join(parts.toDF("cls", "component"), "cls", "left")
        return written(named.select("cls", F.coalesce("component", "cls").alias("component")), "near-open")

    def rarest(self, members: DataFrame) -> DataFrame:
        """key, cls, component, place: the shingles by which members may meet."""
        similarity = self.similarity
        items = self.sets_of(members.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        held = self.classes.join(members, "cls", "left_semi").agg(F.sum("n_shingles")).first()[0] or 0
        chunks, bits = math.ceil(held / CHUNK_SHINGLES) or 1, math.ceil(math.log2(max(1, held / BUCKET_KEYS)))
        dealt = items.join(members, "cls").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.lit(chunks)))
        dealt = large_rows_written(dealt.select("chunk", "cls", "component", "items"), "near-dealt")
        asked = written(dealt.groupBy("chunk").applyInPandas(
            lambda g: ask_counts(g, bits), "bucket long, chunk long, keys binary, counts binary"), "near-asked")
        counts = written(
            asked.groupBy("bucket").applyInPandas(answer_counts, "chunk long, keys binary, counts binary"), "near-counts")
        both = dealt.groupBy("chunk").cogroup(counts.groupBy("chunk"))
        return both.applyInPandas(
            lambda own, known: rarest_shared(own, known, similarity), "key long, cls long, component long, place long")

    def unresolved(self, stars: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
        """a, b, apart: pairs that share a key, are in different components and within the distance, and may be similar.

        Only classes of some star share a key with others, and a key of two classes has its one link tested.
        """
        similarity, distance = self.similarity, distance_for(self.similarity)
        members = self.open_classes(stars, parts)
        if members.isEmpty():
            return links.limit(0)
        postings = written(self.rarest(members), "near-postings")
        open_ = written(
            postings.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
            .where("x <> y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-keys")
        held = postings.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        held = written(held, "near-held")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        own = self.items.join(members, "cls", "left_semi").mapInPandas(bitmaps, "cls long, bitmap binary")
        with arrow_rows(own.sparkSession, TEXT_ROWS):
            own = written(own.dropDuplicates(["cls"]), "near-bitmaps")
        full = self.classes.select("cls", "n_shingles", "signature").join(own, "cls")
        rows = held.withColumn("other", F.explode(every)).select(
            "key", "cls", "component", "place", "block", F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j")).join(full, "cls")
        dealt = rows.repartition(fan_out(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        pairs = dealt.mapInPandas(lambda b: compare_groups(b, distance, similarity), "a long, b long, apart int")
        return pairs.distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")

    def joined(self, parts: DataFrame, links: DataFrame) -> DataFrame:
        """The components after the links that are confirmed."""
        count = links.count()
        if not count:
            return parts
        with arrow_rows(links.sparkSession, TEXT_ROWS):
            sure = written(self.confirm(links, count), "near-sure")
        if sure.isEmpty():
            return parts
        return written(components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(sure)), "near-parts")

    def settled(self, parts: DataFrame, links: DataFrame, tested: DataFrame) -> DataFrame:
        """The components once no link between two of them is untested.

        A few of the nearest links between two components at a time: one that holds spares the others. A link inside a
        component stays inside, so each turn looks only at what the last one left.
        """
        most, rest = 1, links
        while True:
            rest = written(self.between(rest.select("a", "b", "apart").join(tested, ["a", "b"], "left_anti"), parts), "near-rest")
            if rest.isEmpty():
                return parts
            some = Window.partitionBy("x", "y").orderBy("apart", "a", "b")
            chosen = rest.withColumn("nr", F.row_number().over(some)).where(F.col("nr") <= most).select("a", "b")
            chosen = written(chosen, "near-chosen")
            parts = self.joined(parts, chosen)
            tested, most = chosen, most * 8

    def run(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id, first_text (of the component's smallest id)."""
        stars = self.star_links()
        links = written(self.plausible(stars), "near-links")
        nearest = F.min(F.struct("apart", "a"))["a"]
        first = links.groupBy("b").agg(nearest.alias("a")).select("a", "b")
        self.sets_of(links)
        none = self.classes.select(F.col("cls").alias("node"), F.col("cls").alias("component")).limit(0)
        first = written(first, "near-first")
        parts = self.settled(self.joined(none, first), links, first)
        parts = self.settled(parts, written(self.unresolved(stars, links, parts), "near-more"), first.limit(0))
        named = self.classes.join(parts.toDF("cls", "component"), "cls", "left").select(
            "set_key", "first", F.coalesce("component", "cls").alias("component"))
        named = written(named, "near-named")
        least = written(named.groupBy("component").agg(F.min("first").alias("least")), "near-least")
        ids = written(named.join(least, "component").select("set_key", "least"), "near-ids")
        return self.sets.join(ids, "set_key", "left").select(
            F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_key", "n_shingles",
            F.nullif(F.coalesce("least.doc_id", "doc_id"), F.lit(NO_ID)).alias("component_id"),
            F.coalesce("least.text_key", "text_key").alias("first_text"))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _components(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    with work_folders_removed(docs.sparkSession) as kept:
        return kept(written(NearDuplicates(docs, words, similarity).run(), "near-components"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = _components(docs, words, similarity)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` (all columns), one of each component: the first by id (null first) and digest of the text.

    Rows are known by id and text: different texts under one id, or without one, are decided apart. A text without a
    shingle is a component of its own, as often as its row is repeated.
    """
    rows = _components(docs.select("doc_id", "text"), words, similarity)
    whole = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_text"))
    keep = rows.where(whole | (F.col("n_shingles") == 0)).select(
        F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_text"), (F.col("n_shingles") == 0).alias("_bare")).distinct()
    named = docs.withColumn("_text_key", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("_text_key") == F.col("_kept_text"))
    joined = named.join(keep.hint("merge"), same).drop("_kept_id", "_kept_text")
    once = Window.partitionBy("doc_id", "_text_key").orderBy("_text_key")
    copy = F.row_number().over(once)
    return joined.withColumn("_copy", copy).where((F.col("_copy") == 1) | F.col("_bare")).select(*docs.columns)
