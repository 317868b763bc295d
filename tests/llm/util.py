"""Small inputs that every operator meets: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

WORDS = "the and of to in a is it for on with as by be this from that über straße naïve 中文 été x1 42".split()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    made = [rng.choice(WORDS) if rng.random() < 0.3 else "w" + str(rng.randrange(vocabulary)) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in made)


def edited(text: str, seed: int, n: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def documents() -> list[tuple]:
    base = prose(1, 120)
    texts = [None, "", " \n\t ", "one", "two words", base, base, edited(base, 2, 1), edited(base, 3, 4), edited(base, 4, 30), prose(5, 5000), prose(6, 60), prose(7, 60)]
    texts += ["spam " * 80, "line\n" * 30, "&&& ### " * 40, "SHOUT!! " * 50, "a\0b\x1fc" + "\u00a0" + "d\u2003e", "x" * 20000, prose(8, 25)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, base), (None, "unique words without an id here")]


def frame(spark, rows=None):
    """doc_id and text, with columns named like the operators' own."""
    made = spark.createDataFrame([(*r, 1, "s", 2, True) for r in (documents() if rows is None else rows)], "doc_id long, text string, n_words long, kept string, n long, score boolean")
    return made.repartition(3)
