"""Words as numbers, and a randomised singular value decomposition of TF-IDF passages that are spread over tasks.

The words that are searched for have a number each, by their letters. All other words share `FOREIGN` numbers behind
those, by a hash; they equal nothing and only count in the length of a vector. So every matrix on the driver has as many
rows as there are words searched for. Tasks hold passages and send back sums by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.session import TEXT_ROWS, arrow_rows

FOREIGN = 1 << 16
STRIPPED = ".,;:!?\"'()[]{}"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them; a word of punctuation alone stays."""
    return [word.strip(STRIPPED) or word for word in (text or "").lower().split()]


class Numbers(dict):
    """Numbers of raw words: the known ones from 0 on, all others behind them. Forgets raw words when it gets large."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, raw: str) -> int:
        if len(self) > len(self.known) + 200_000:
            self.clear()
            self.update(self.known)
        word = raw.strip(STRIPPED) or raw
        number = self.known.get(word)
        if number is None:
            number = len(self.known) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % FOREIGN
        self[raw] = number
        return number


def numbers_of(text: str | None, numbers: Numbers) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def weighted(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's features and their TF-IDF weights, of length one in all."""
    own, times = np.unique(ids, return_counts=True)
    weights = times * idf[own]
    length = np.sqrt((weights**2).sum())
    return own, weights / length if length else weights


def document_frequencies(texts: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many texts of the whole table each number stands, and the number of texts."""
    size = len(known) + FOREIGN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows, numbers = np.zeros(size, np.int64), 0, Numbers(known)
        for batch in batches:
            for text in batch["text"]:
                total[np.unique(numbers_of(text, numbers))] += 1
            rows += len(batch)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"number": np.append(held, -1), "n": np.append(total[held], rows)})

    sums = texts.select("text").mapInPandas(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 1, np.int64)
    with arrow_rows(texts.sparkSession, TEXT_ROWS):
        rows = sums.collect()
    for number, n in rows:
        found[number] = n
    return found[:size], int(found[size])


def _summed(passages: DataFrame, rows: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]],
            width: int) -> dict[int, np.ndarray]:
    """Sums by number of the vectors that `rows` gives for each passage's features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for ids in batch["ids"]:
                for number, vector in rows(np.asarray(ids, np.int64)):
                    if number in sums:
                        sums[number] += vector
                    else:
                        sums[number] = vector.copy()
        yield pd.DataFrame({
            "number": np.array(list(sums), np.int32), "vector": pd.Series([v.tolist() for v in sums.values()], dtype=object)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        numbers, place = np.unique(group["number"].to_numpy(), return_inverse=True)
        total = np.zeros((len(numbers), width))
        np.add.at(total, place, np.stack(group["vector"].to_list()))
        return pd.DataFrame({"number": numbers.astype(np.int32), "vector": total.tolist()})

    parts = passages.mapInPandas(run, "number int, vector array<double>")
    total = parts.groupBy(F.pmod("number", F.lit(64))).applyInPandas(add, "number int, vector array<double>")
    return {n: np.array(v) for n, v in total.collect()}


def decompose(passages: DataFrame, idf: np.ndarray, rank: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The passages' features, ascending, and the leading right singular vectors of their TF-IDF rows (column `ids`).

    Random directions are pushed through the matrix and back, made orthogonal, and so again; the small matrix of what
    is left is then decomposed exactly. Tasks are sent a row per word in use.
    """
    used = np.array(sorted(r[0] for r in passages.select(F.explode("ids")).distinct().collect()), np.int64)
    rank = min(rank, len(used), passages.count())
    if not rank:
        return used, np.zeros((len(used), 0), np.float32)
    basis = np.random.default_rng(11).standard_normal((len(used), rank))

    def through(basis: np.ndarray):
        def rows(ids: np.ndarray):
            own, weights = weighted(ids, idf)
            place = np.searchsorted(used, own)
            image = weights @ basis[place]
            return ((int(f), w * image) for f, w in zip(place, weights))
        return rows

    for _ in range(rounds):
        sums = _summed(passages, through(basis.astype(np.float32)), rank)
        basis, _ = np.linalg.qr(np.stack([sums[f] for f in range(len(used))]))
    final = basis.astype(np.float32)

    def gram(ids: np.ndarray):
        own, weights = weighted(ids, idf)
        image = weights @ final[np.searchsorted(used, own)]
        return ((i, image[i] * image) for i in range(rank))

    small = _summed(passages, gram, rank)
    _, turned = np.linalg.eigh(np.stack([small[i] for i in range(rank)]))
    return used, (basis @ turned[:, ::-1]).astype(np.float32)
