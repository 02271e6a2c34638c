"""Small document sets with nulls, empties, repeats, long texts and clashing column names."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "le", "mo") for b in ("ra", "ten", "vis", "lop", "mur", "ned", "sy", "qua")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text: str, n: int, seed: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus() -> list[tuple]:
    """(doc_id, text): base texts, exact copies, near copies at many distances, odd rows."""
    base = [prose(120, s) for s in range(4)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, base[0]) for i in range(12)]
    rows += [(40 + i, edited(base[1], 1 + i % 12, i)) for i in range(36)]
    rows += [(100 + i, prose(3, 50 + i)) for i in range(4)]
    rows += [(200, ""), (201, None), (202, " \t\n "), (203, "one"), (204, "one"), (205, "ONE"), (206, prose(20_000, 9)), (207, "É é"), (0, base[0])]
    return rows


def frame(spark, rows: list[tuple]):
    """The rows with more columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", "en", 0, "x", 1) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long, rid string, node int")
