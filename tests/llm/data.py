"""Small tables with every awkward row."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, Words string, row string, Gone string"


def sentence(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, ids=None):
    """Documents of given texts, with further columns whose names clash."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if j % 7 == 3 else "en", f"src{j % 3}" if j % 5 else None, len(t) if t is not None else None, "x", "y", None, "r", "g") for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward() -> tuple[list, list]:
    """ids and texts: null, empty, blank, short, very long, repeated and unnumbered rows."""
    rng = random.Random(5)
    long_text = "\n".join(sentence(rng, 12) for _ in range(3000))
    texts = [None, "", "  \n \t\n ", "one", "Two words", long_text, long_text, "The MIT License.\nÉté ÄÖ\n\n\n\n", "x" * 200_000, None, "same row here for twice", "same row here for twice", "no number on this row"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None]
    return ids, texts
