"""Small tables that hold the awkward cases, and comparison helpers."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("row", T.StringType()),
        T.StructField("print", T.StringType()),
        T.StructField("spans", T.LongType()),
        T.StructField("document", T.LongType()),
    ]
)


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)


def table(spark, texts, extra=()):
    """``texts``: text, or (doc_id, text)."""
    rows = []
    for n, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (n, t)
        rows.append((doc_id, text, "en", "s", len(text or ""), "r", "p", 1, 2))
    return spark.createDataFrame([*rows, *extra], DOCS)


def awkward(seed: int = 1) -> list:
    """Nulls, empty and long texts, ties, repeated rows, shared passages, copies."""
    rng = random.Random(seed)
    shared, other = prose(rng, 120), prose(rng, 90)
    base = prose(rng, 200)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        "", None, " \n ", "one", "two words", "ünïcödé ñandú çà " * 30, base, base, " ".join(near),
        prose(rng, 40) + shared + prose(rng, 30), prose(rng, 20) + shared + other, other + prose(rng, 50),
        "aaa " * 300, "x" * 5000, "x" * 700 + prose(rng, 5), prose(rng, 3000), "\n".join(["same line"] * 9), "a\nb\nc\nd\ne", "z\na\nb\nc\ny", "\n\n\n\n",
        "Mail a.b@c.de, call +49 (30) 1234567 or 10.0.0.255; card 4111 1111 1111 1111.", base + shared, "Ä" * 300 + shared[:400],
    ]
    rows = list(enumerate(texts))
    return [*rows, (7, base), (None, base), (None, None), (3, "another text under a used id " + shared)]
