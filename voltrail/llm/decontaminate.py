"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; a randomised SVD of their TF-IDF rows, weighted by how many texts of the whole
corpus hold a word, gives the latent space. Every word of the benchmark has a number of its own; all other words equal
nothing, and only their hashed frequencies count in the length of a vector. Texts are cut into windows of two blocks of
`STEP` words, a block apart. A window is a candidate for an item if the cosine of its TF-IDF vector, projected, to one of
the item's passages is at least `COSINE`: this finds reworded passages. A window whose words, each with the most that it
can add to any passage, don't reach it is not projected. The projection and the words
around a short item lower that cosine, so a stretch of three blocks is a candidate as well if the words it shares with a
passage hold `COSINE` of the passage's own weight, whatever else stands there; this finds copies, however many items
there are. The stretch of text around an item's candidate windows is then compared with the item word by word: the
longest common subsequence must hold `SHARE` of the item's words, and the item's answer must be there: more than half of
the words that follow `answer:`, or else of the rarer half of its words.

Items come in parts of `PART_ITEMS`, so what tasks are sent has a size bound: a part's words, and matrices of as many
rows. A part is two passes over the texts, one that counts and one that matches, and cuts them into words once in each;
inside it, items are matched in blocks of `ITEM_BLOCK`. No rows are shuffled. Texts longer than an item are read whole.

Defined results: a null or empty text matches nothing and is kept. Items that are null or under `MIN_WORDS` words match
nothing; the same item twice gives both ids. Null ids are kept as they are; repeated rows are judged alike, each for
itself. Extra columns are ignored. Without items everything is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm import latent, slices
from voltrail.llm.latent import Numbers, decompose, document_frequencies, numbers_of, weighted, words_of
from voltrail.llm.slices import by_slices
from voltrail.session import send_to_tasks

STEP = 16
COSINE = 0.45
SHARE = 0.6
RANK = 256
MIN_WORDS = 5
ITEM_BLOCK, PART_ITEMS = 2048, 16_384
# Words of a passage that together hold less than this share of its weight, the commonest, are looked at last.
COMMON = 0.2
PAIRS = 1 << 18
WINDOWS = 256


def passage_starts(words: int) -> range:
    """Where the passages of a text start: two steps long, a step apart, the last one at the end."""
    return range(0, max(1, words - STEP), STEP)


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    answer: np.ndarray


def make_item(item_id: int, text: str, known: Numbers, idf: np.ndarray) -> Item:
    ids = numbers_of(text, known)
    _, mark, answer = text.lower().rpartition("answer:")
    terms = numbers_of(answer, known) if mark else np.zeros(0, np.int64)
    # An answer may cut a word of the item: what is no word of the benchmark is no term.
    terms = terms[terms < len(known.known)]
    if not len(terms):
        own = np.unique(ids)
        terms = own[np.argsort(-idf[own], kind="stable")][:max(1, len(own) // 2)]
    return Item(item_id, ids, np.unique(terms))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of `a`."""
    places: dict[int, int] = {}
    for at, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << at
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        hit = row & places.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Postings:
    """Which passages hold a feature, and the share of the passage's weight that it is.

    Only a passage's rarer words have postings; `least` is the share of those that a stretch must hold to reach `COSINE`
    if it holds all the others as well, so no stretch is lost.
    """

    first: np.ndarray
    passage: np.ndarray
    share: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, passages: list[tuple[np.ndarray, np.ndarray]], size: int) -> "Postings":
        feature, passage, share, least = [], [], [], []
        for number, (own, shares) in enumerate(passages):
            order = np.argsort(shares, kind="stable")
            below = np.cumsum(shares[order])
            kept = order[below >= COMMON]
            feature.append(own[kept])
            passage.append(np.full(len(kept), number))
            share.append(shares[kept])
            least.append(COSINE - float(shares.sum() - shares[kept].sum()))
        features, order = np.concatenate(feature), np.argsort(np.concatenate(feature), kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(features, minlength=size))])
        return cls(first, np.concatenate(passage)[order], np.concatenate(share)[order], np.array(least) - 1e-9)

    def near(self, ids: np.ndarray, block: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, passage) where the three blocks from there on, in one text, hold enough of the passage.

        A word in two of the blocks counts twice, so this may be more than enough; matches are compared word by word.
        """
        many = self.first[1:] - self.first[:-1]
        size = len(many)
        held = np.flatnonzero(many[ids])
        key = np.unique(block[held] * size + ids[held])
        block, word = key // size, key % size
        # Two empty blocks stand between texts, so that no stretch reaches from one to the next.
        spaced = block + 2 * text[block]
        width = len(text) + 2 * (int(text[-1]) + 2)
        times = many[word]
        before = np.concatenate([[0], np.cumsum(times)])
        blocks, passages = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(key):
            end = max(int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1, at + 1)
            # Whole blocks, and the two behind, whose stretches the next round finds again.
            new = int(np.searchsorted(block, block[end - 1], "right"))
            last = int(np.searchsorted(spaced, spaced[new - 1] + 2, "right"))
            n = times[at:last]
            row = np.repeat(np.arange(at, last), n)
            posting = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[word[at:last]], n)
            pair = self.passage[posting] * width + spaced[row]
            order = np.argsort(pair, kind="stable")
            pair, share, row = pair[order], self.share[posting[order]], row[order]
            firsts = np.flatnonzero(np.diff(pair, prepend=-1))
            total = np.add.reduceat(share, firsts) if len(firsts) else share
            pair, row = pair[firsts], row[firsts]
            whole = total.copy()
            for n in (1, 2):
                whole[:-n] += np.where(pair[n:] - pair[:-n] <= 2, total[n:], 0)
            good = np.flatnonzero(whole >= self.least[pair // width])
            blocks.append(block[row[good]])
            passages.append(pair[good] // width)
            at = new
        return np.concatenate(blocks), np.concatenate(passages)


@dataclass
class Matcher:
    """A block of items and the latent space of their passages."""

    items: list[Item]
    owner: np.ndarray
    idf: np.ndarray
    place: np.ndarray
    basis: np.ndarray
    passages: np.ndarray
    #: The most that a word, as often as it stands in a window, adds to the window's product with any passage.
    most: np.ndarray
    postings: "Postings"

    @classmethod
    def of(cls, items: list[Item], features: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> "Matcher":
        """`basis` has a row per feature of `features`; the block keeps those of its items."""
        owner, rows, parts = [], [], []
        used = np.unique(np.concatenate([x.ids for x in items]))
        place = np.full(len(idf), -1, np.int32)
        place[used] = np.arange(len(used))
        basis = basis[np.searchsorted(features, used)]
        for number, item in enumerate(items):
            for start in passage_starts(len(item.ids)):
                own, weights = weighted(item.ids[start:start + 2 * STEP], idf)
                image = weights.astype(np.float32) @ basis[place[own]]
                owner.append(number)
                parts.append((own, weights**2))
                rows.append(image / max(float(np.linalg.norm(image)), 1e-9))
        images = np.stack(rows)
        most = np.zeros(len(idf))
        for at in range(0, len(used), 4096):
            part = used[at:at + 4096]
            most[part] = idf[part] * (basis[at:at + 4096] @ images.T).max(1).clip(0)
        return cls(items, np.array(owner), idf.astype(np.float32), place, basis, images, most, Postings.of(parts, len(idf)))

    def candidates(self, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, item) of the windows that are near an item's passage. `ids` are all texts' words."""
        blocks = -(-lengths // STEP)
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.repeat(np.arange(len(lengths)), blocks)
        if not len(text):
            return []
        in_text = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)
        starts = firsts[text] + in_text * STEP
        square = self.idf[ids] ** 2
        whole = np.add.reduceat(square, starts)
        most = np.add.reduceat(self.most[ids], starts)
        paired = np.append(text[1:] == text[:-1], False)
        whole = whole + np.where(paired, np.append(whole[1:], 0), 0)
        most = most + np.where(paired, np.append(most[1:], 0), 0)
        ends = np.minimum(starts + 2 * STEP, firsts[text] + lengths[text])
        found = []
        # A window is no shorter than the root of its words' squared weights.
        likely = np.flatnonzero(most >= (COSINE - 1e-6) * np.sqrt(whole))
        for at in range(0, len(likely), WINDOWS):
            part = likely[at:at + WINDOWS]
            near = np.nonzero(self._images(ids, starts[part], ends[part]) @ self.passages.T >= COSINE)
            for row, passage in zip(*near):
                i = part[row]
                found.append((int(text[i]), int(in_text[i]) * STEP, int(self.owner[passage])))
        block = np.repeat(np.arange(len(text)), np.append(starts[1:], len(ids)) - starts)
        for i, passage in zip(*self.postings.near(ids, block, text)):
            # Three blocks are two windows.
            found += [(int(text[i]), int(in_text[i] + n) * STEP, int(self.owner[passage])) for n in (0, 1)]
        return found

    def _images(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The windows' TF-IDF vectors of length one, projected."""
        lengths = ends - starts
        window = np.repeat(np.arange(len(starts)), lengths)
        own = ids[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        key, times = np.unique(window * len(self.idf) + own, return_counts=True)
        window, own = key // len(self.idf), key % len(self.idf)
        weights = times * self.idf[own]
        length = np.sqrt(np.add.reduceat(weights**2, np.searchsorted(window, np.arange(len(starts)))))
        held = np.flatnonzero(self.place[own] >= 0)
        window, place = window[held], self.place[own[held]]
        weights = (weights[held] / np.maximum(length[window], 1e-9)).astype(np.float32)
        firsts = np.flatnonzero(np.diff(window, prepend=-1))
        out = np.zeros((len(starts), self.basis.shape[1]), np.float32)
        if len(held):
            out[window[firsts]] = np.add.reduceat(self.basis[place] * weights[:, None], firsts)
        return out

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """Per text (item id, first word, last word, share) of the items it holds."""
        lengths = np.array([len(x) for x in texts], np.int64)
        near: dict[tuple[int, int], list[int]] = {}
        for text, start, item in self.candidates(np.concatenate(texts) if len(texts) else np.zeros(0, np.int64), lengths):
            near.setdefault((text, item), []).append(start)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for (text, number), starts in near.items():
            item, best = self.items[number], None
            for first, last in self._stretches(sorted(set(starts)), len(item.ids), len(texts[text])):
                words = texts[text][first:last]
                held = set(words.tolist())
                if 2 * sum(x in held for x in item.answer.tolist()) <= len(item.answer):
                    continue
                if sum(x in held for x in item.ids.tolist()) < SHARE * len(item.ids):
                    continue
                share = common_subsequence(item.ids, words) / len(item.ids)
                if share >= SHARE and (best is None or share > best[3]):
                    best = (item.item_id, first, last, share)
            if best:
                out[text].append(best)
        return [sorted(x) for x in out]

    @staticmethod
    def _stretches(starts: list[int], size: int, length: int) -> list[tuple[int, int]]:
        """Candidate windows with the item's length around them; those that touch are one, if not much longer."""
        out: list[tuple[int, int]] = []
        for start in starts:
            first, last = max(0, start - size), min(length, start + 2 * STEP + size)
            if out and first <= out[-1][1] and last - out[-1][0] <= 4 * size + 4 * STEP:
                out[-1] = out[-1][0], last
            else:
                out.append((first, last))
        return out


FIELDS = ("item_id", "first_word", "last_word", "share")
MATCHES = "array<struct<item_id:long,first_word:long,last_word:long,share:double>>"
FOUND = pa.list_(pa.struct([(name, pa.float64() if name == "share" else pa.int64()) for name in FIELDS]))


def match_texts(texts: list[str], numbers: Numbers, matchers: list[Matcher]) -> list[list[dict]]:
    ids = [numbers_of(t, numbers) for t in texts]
    found = [matcher.matches(ids) for matcher in matchers]
    return [[dict(zip(FIELDS, hit)) for hits in own for hit in hits] for own in zip(*found)]


def _part(texts: DataFrame, items: DataFrame, text: Column) -> Column | None:
    """The matches of one part of the benchmark, as a column over `text`."""
    own = [(i, t) for i, t in items.collect() if len(words_of(t)) >= MIN_WORDS]
    if not own:
        return None
    known = {word: number for number, word in enumerate(sorted({w for _, t in own for w in words_of(t)}))}
    counts, total = document_frequencies(texts, known)
    idf = np.log((total + 1) / (counts + 1)) + 1e-3
    numbers = Numbers(known)
    made = [make_item(i, t, numbers, idf) for i, t in sorted(own)]
    cuts = [(x.ids[s:s + 2 * STEP].tolist(),) for x in made for s in passage_starts(len(x.ids))]
    passages = texts.sparkSession.createDataFrame(cuts, "ids array<long>")
    features, basis = decompose(passages, idf, RANK)
    matchers = [Matcher.of(made[at:at + ITEM_BLOCK], features, basis, idf) for at in range(0, len(made), ITEM_BLOCK)]

    @F.arrow_udf(MATCHES)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = Numbers(known)
        for batch in batches:
            yield by_slices(lambda texts: match_texts(texts, numbers, matchers), FOUND, batch)

    return matched(text)


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """All rows and columns of `docs`, each row with what its own text holds of the benchmark."""
    for module in (__name__, latent.__name__, slices.__name__):
        send_to_tasks(module)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"))
    usable = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    parts = -(-usable.count() // PART_ITEMS)
    found = [
        _part(texts, usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part), text) for part in range(parts)]
    found = [column for column in found if column is not None]
    return docs.withColumn(name, F.concat(*found) if found else F.array().cast(MATCHES))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, kept, contaminated, item_ids, matches: a row per text."""
    rows = with_matches(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    # The column is evaluated once, below what is made of it.
    return rows.select("doc_id", "matches").select(
        "doc_id", (F.size("matches") == 0).alias("kept"), (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"),
        "matches")
