"""Texts for the operators' tests, with the odd rows that each must bear."""

import random

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "and", "to", "Contact", "Ümläut", "naïve"]


def texts(n, seed=1, words=(5, 60)):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(*words))) for _ in range(n)]


def make_docs(spark, rows):
    """doc_id, text and columns whose names the operators use inside."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "x", 2.0) for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, key int, line string, score double")


def odd_rows(start):
    """Null, empty, blank, one-word and very long texts, and a repeated row."""
    long_text = " ".join(f"long{i % 997}" for i in range(60_000))
    return [
        (start, None), (start + 1, ""), (start + 2, " \t\n "), (start + 3, "single"), (start + 4, long_text),
        (start + 5, "again and again"), (start + 5, "again and again"), (None, "no id here"),
    ]
