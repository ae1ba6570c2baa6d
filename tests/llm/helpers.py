from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng: random.Random, n: int, size: int = 5000) -> list[str]:
    """n words of a vocabulary of `size`."""
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
