"""Quality by weak labels: overlapping heuristic labellers, a label model over all texts, and a hashed linear scorer.

Labellers look at capitals, signs, table bars, repeated words and lines, and at words of insult; each says bad or
nothing. One says good where none of these says anything, and one repeats the given labels where there are any. A label
model of two hidden classes, fitted by expectation-maximisation to how often each pattern of answers occurs in the whole
corpus, learns how telling each answer is; silence is no evidence. The number of patterns is bounded by the number of
labellers. Its posterior labels train a linear scorer over hashed words, beginnings of words and labeller answers, which
then judges every text: one with a score of at least one half is rejected, as is one whose labellers alone make the label
model `SURE`.

The insults are learned too: words and beginnings of words in at least `LEXICON_SHARE` of the texts labelled toxic and
hardly in any other. Learning from labels uses at most `FIT_ROWS` labelled texts (those with the smallest hash of their
id); texts whose hash leaves 0 by 5 stay out of the fit and serve to measure accuracy (`held_out_accuracy`).

Defined results: null or empty text has no bad sign and is kept. Null ids are kept as they are; repeated rows are judged
alike. Several labels of one text count as the worst of them. Extra columns are ignored. Without labels the heuristics
alone teach the scorer; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm import slices
from voltrail.llm.slices import by_slices
from voltrail.session import TEXT_ROWS, arrow_rows, send_to_tasks, written

FIT_ROWS = 20_000
LEXICON_SHARE, LEXICON_PURITY, LEXICON_TEXTS = 0.02, 0.97, 4
BEGINNINGS = (4, 5, 6, 7, 8)
DIMENSIONS = 1 << 20
EPOCHS, STEP, SHRINK = 12, 0.5, 1e-5
ROUNDS = 100
SURE = 0.95
STRETCH = 500
NO_ID = -(2**63)
VERDICT = pa.struct([("score", pa.float64()), ("posterior", pa.float64()), ("votes", pa.string())])

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*@^~+=<>\\/{}[]_"
EDGES = b".,;:!?\"'()"
BAD, GOOD, SILENT = 1, 0, 2

#: Labellers on measurements: name, and the value from which the text is bad.
LABELLERS = (
    ("capitals", 0.3), ("shouts", 0.2), ("signs", 0.05), ("sign_words", 0.3), ("bars", 0.15), ("bar_lines", 0.5),
    ("echo", 0.3), ("sameness", 0.75), ("same_lines", 0.5), ("insults", 1.0), ("many_insults", 3.0),
)
NAMES = tuple(name for name, _ in LABELLERS) + ("plain", "given")


def word_parts(tokens: set[bytes]) -> set[bytes]:
    """Distinct words without punctuation around them, and their beginnings, marked by a hyphen."""
    words = {t.strip(EDGES) for t in tokens}
    parts = set(words)
    for size in BEGINNINGS:
        parts.update(w[:size] + b"-" for w in words if len(w) >= size)
    return parts


def measure(text: str, insults: frozenset[bytes]) -> tuple[list[float], set[bytes]]:
    """The labellers' measurements and the text's word parts."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.lower().split()
    distinct = set(tokens)
    parts = word_parts(distinct)
    n, size = max(len(tokens), 1), max(len(raw), 1)
    lines = raw.split(b"\n")
    hits = float(len(parts & insults))
    return [
        (len(raw) - len(raw.translate(None, CAPITALS))) / size,
        raw.count(b"!!") / n,
        (len(raw) - len(raw.translate(None, SIGNS))) / size,
        sum(t[-1] in SIGNS for t in distinct) / max(len(distinct), 1),
        tokens.count(b"|") / n,
        sum(line.count(b"|") >= 3 for line in lines) / len(lines),
        sum(map(eq, tokens, tokens[1:])) / n,
        # Few words among many; short texts repeat little by nature, long ones much, so it is taken stretch by stretch.
        1 - sum(len(set(tokens[i:i + STRETCH])) for i in range(0, n, STRETCH)) / n if n >= 20 else 0.0,
        1 - len(set(lines)) / len(lines) if len(lines) >= 5 else 0.0,
        hits,
        hits,
    ], parts


def votes_of(measures: list[float]) -> list[int]:
    """The answers of all labellers but the given labels."""
    votes = [BAD if value >= bad else SILENT for value, (_, bad) in zip(measures, LABELLERS)]
    return [*votes, SILENT if BAD in votes else GOOD]


def pattern_of(votes: list[int]) -> int:
    number = 0
    for vote in votes:
        number = 3 * number + vote
    return number


def votes_from(pattern: int) -> list[int]:
    out = []
    for _ in NAMES:
        pattern, vote = divmod(pattern, 3)
        out.append(vote)
    return out[::-1]


def posterior_of(votes: np.ndarray, rates: np.ndarray, prior: float) -> np.ndarray:
    """How likely each row of answers makes a text bad; silence is no evidence."""
    answers = np.stack([votes == BAD, votes == GOOD], 2).astype(float)
    log = np.einsum("pla,lca->pc", answers, np.log(rates)) + np.log([prior, 1 - prior])
    return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))


def label_model(patterns: dict[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of `bad` for each pattern, how often each labeller says bad or good in each class (bad, good), and how
    many texts are bad."""
    if not patterns:
        return {}, np.full((len(NAMES), 2, 2), 0.5), 0.5
    # The same answers under the other given labels may not occur; they weigh nothing and get their posterior.
    patterns = {**{p - p % 3 + v: 0 for p in patterns for v in (BAD, GOOD, SILENT)}, **patterns}
    numbers = list(patterns)
    votes = np.array([votes_from(p) for p in numbers])
    n = np.array([patterns[p] for p in numbers], float)
    answers = np.stack([votes == BAD, votes == GOOD], 2).astype(float)
    # At first any heuristic that says bad is believed, and a given label more.
    posterior = np.where((votes[:, :-1] == BAD).any(1), 0.9, 0.05)
    posterior = np.where(votes[:, -1] == BAD, 0.95, np.where(votes[:, -1] == GOOD, 0.05, posterior))
    for _ in range(ROUNDS):
        rates = np.empty((len(NAMES), 2, 2))
        for cls, weight in enumerate((posterior * n, (1 - posterior) * n)):
            rates[:, cls] = (np.einsum("p,pla->la", weight, answers) + 0.01) / (weight.sum() + 0.02)
        prior = np.clip((posterior * n).sum() / n.sum(), 1e-4, 0.5)
        after = posterior_of(votes, rates, prior)
        done = np.abs(after - posterior)[n > 0].max() < 1e-6
        posterior = after
        if done:
            break
    return dict(zip(numbers, posterior.tolist())), rates, prior


def hashed(parts: set[bytes], votes: list[int]) -> np.ndarray:
    """The features of a text: its word parts, and what the labellers say of it, where they say something."""
    marks = [zlib.crc32(f"\t{name}={v}".encode()) % DIMENSIONS for name, v in zip(NAMES, votes) if v != SILENT]
    return np.unique(np.array([zlib.crc32(p) % DIMENSIONS for p in parts] + marks, np.int32))


def train_scorer(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer, the bias last; features seen in fewer than three texts have none.

    A text has a feature once. The list is left with the features that have weights, so memory holds one set of them.
    """
    texts = np.zeros(DIMENSIONS, np.int32)
    for own in features:
        texts[own] += 1
    for i, own in enumerate(features):
        features[i] = own[texts[own] >= 3]
    weights, gradients = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    bias, order = 0.0, np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in order.permutation(len(features)):
            own = features[i]
            slope = 1 / (1 + np.exp(-np.clip(weights[own].sum() + bias, -30, 30))) - labels[i]
            # Steps shrink with what a feature has already moved.
            gradients[own] += slope * slope
            weights[own] -= STEP * slope / np.sqrt(gradients[own]) / np.sqrt(len(own) + 1) + SHRINK * weights[own]
            bias -= 0.01 * slope
    return np.append(weights, bias)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def learn_insults(docs: DataFrame, labels: DataFrame) -> frozenset[bytes]:
    """Words in many texts labelled toxic and hardly in others; their number is bounded by the shares."""
    sample = fit_sample(labels)
    marked = _texts(docs).join(F.broadcast(sample), "doc_id").where("fit")
    totals = marked.agg(F.sum("toxic")).first()[0] or 0
    if not totals:
        return frozenset()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the batch's word parts."""
        for batch in batches:
            toxic, all_ = Counter(), Counter()
            for text, is_toxic in zip(batch["text"], batch["toxic"]):
                own = word_parts(set(text.encode("utf-8", "surrogatepass").lower().split()))
                all_.update(own)
                if is_toxic:
                    toxic.update(own)
            yield pd.DataFrame({"part": list(all_), "toxic": [toxic[p] for p in all_], "n": list(all_.values())})

    counts = marked.select("text", "toxic").mapInPandas(parts, "part binary, toxic long, n long").groupBy("part").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    least = max(LEXICON_TEXTS, LEXICON_SHARE * totals)
    found = counts.where(
        (F.col("toxic") >= least) & (F.col("toxic") >= LEXICON_PURITY * F.col("n")) & (F.length("part") > 0))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return frozenset(bytes(r["part"]) for r in found.select("part").collect())


def fit_sample(labels: DataFrame) -> DataFrame:
    """doc_id, bad, toxic, fit: at most FIT_ROWS labelled texts; those with `fit` false are for measuring."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    key = F.xxhash64("doc_id")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return worst.select("doc_id", bad.alias("bad"), "toxic", key.alias("key"), (F.pmod(key, F.lit(5)) != 0).alias("fit")) \
        .orderBy("key").limit(FIT_ROWS).drop("key")


class QualityModel:
    """Insults, label model and scorer, fitted to `docs` and `labels`."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        for module in (__name__, slices.__name__):
            send_to_tasks(module)
        self.sample = written(fit_sample(labels), "quality-sample")
        self.insults = learn_insults(docs, labels)
        self.posterior, self.rates, self.prior = self._label_model(docs)
        self.weights = self._scorer(docs)

    def _label_model(self, docs: DataFrame) -> tuple[dict[int, float], np.ndarray, float]:
        insults = self.insults

        def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"], "own": [pattern_of(votes_of(measure(t, insults)[0])) for t in batch["text"]]})

        own = _texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInPandas(patterns, "doc_id long, own int")
        given = self.sample.where("fit").select("doc_id", "bad")
        joined = own.join(F.broadcast(given), "doc_id", "left")
        vote = F.when(F.col("bad") == 1, BAD).when(F.col("bad") == 0, GOOD).otherwise(SILENT)
        with arrow_rows(docs.sparkSession, TEXT_ROWS):
            counts = joined.groupBy((F.col("own") * 3 + vote).alias("pattern")).count().collect()
        return label_model({r["pattern"]: r["count"] for r in counts})

    def _scorer(self, docs: DataFrame) -> np.ndarray:
        """Trained in one task on the bounded sample, whose features reach it a few texts at a time."""
        insults, posterior = self.insults, self.posterior

        def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for text, bad in zip(batch["text"], batch["bad"]):
                    measures, parts = measure(text, insults)
                    votes = votes_of(measures)
                    known = posterior.get(pattern_of([*votes, BAD if bad else GOOD]), 0.5)
                    # The scorer must do without the given label.
                    rows.append((hashed(parts, [*votes, SILENT]), known))
                yield pd.DataFrame(rows, columns=["features", "label"])

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            features, labels = [], []
            for batch in batches:
                features += [np.array(x, np.int32) for x in batch["features"]]
                labels += batch["label"].tolist()
            weights = train_scorer(features, np.array(labels))
            held = np.flatnonzero(weights)
            yield pd.DataFrame({"place": held, "weight": weights[held]})

        fit = _texts(docs).join(F.broadcast(self.sample.where("fit")), "doc_id").dropDuplicates(["doc_id"])
        rows = fit.select("text", "bad").mapInPandas(examples, "features array<int>, label double")
        out = np.zeros(DIMENSIONS + 1)
        with arrow_rows(docs.sparkSession, TEXT_ROWS):
            rows = written(rows, "quality-examples")
            if not rows.isEmpty():
                for place, weight in rows.repartition(1).mapInPandas(train, "place long, weight double").collect():
                    out[place] = weight
        return out

    def verdict(self, text: Column) -> Column:
        """score, posterior, votes and kept of a text, as one column."""
        insults, weights = self.insults, self.weights.astype(np.float32)
        posterior, rates, prior = self.posterior, self.rates, self.prior

        def believed(vote: list[int]) -> float:
            known = posterior.get(pattern_of(vote))
            return float(posterior_of(np.array([vote]), rates, prior)[0]) if known is None else known

        def judged(texts: list[str]) -> list[tuple[float, float, str]]:
            rows = []
            for one in texts:
                measures, parts = measure(one, insults)
                vote = votes_of(measures)
                linear = float(weights[hashed(parts, [*vote, SILENT])].sum() + weights[-1])
                score = 1 / (1 + np.exp(-np.clip(linear, -30, 30)))
                rows.append((float(score), believed([*vote, SILENT]), ",".join(name for name, v in zip(NAMES, vote) if v == BAD)))
            return rows

        @F.arrow_udf("score double, posterior double, votes string")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield by_slices(judged, VERDICT, batch)

        return score(text)

    def judge(self, docs: DataFrame) -> DataFrame:
        """All rows of `docs` as doc_id, score, posterior, votes, kept."""
        rows = _texts(docs).select("doc_id", self.verdict(F.col("text")).alias("of"))
        return rows.select("doc_id", "of.*", self.keeps(F.col("of")).alias("kept"))

    @staticmethod
    def keeps(of: Column) -> Column:
        return (of["score"] < 0.5) & (of["posterior"] < SURE)

    def held_out_accuracy(self, docs: DataFrame) -> tuple[float, float]:
        """The shares of bad and of good labelled texts outside the fit that are judged so."""
        judged = self.judge(docs.join(F.broadcast(self.sample.where("NOT fit")), "doc_id", "left_semi"))
        both = judged.join(self.sample, "doc_id").agg(
            F.avg(F.when(F.col("bad") == 1, (~F.col("kept")).cast("int"))),
            F.avg(F.when(F.col("bad") == 0, F.col("kept").cast("int")))).first()
        return both[0], both[1]


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, posterior, votes, kept: a row per text."""
    return QualityModel(docs, labels).judge(docs)
