"""Small document tables with the awkward cases every operator has to bear."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["id", "key", "size", "check", "hash", "line", "lines", "part", "place", "node", "task", "row", "rank", "n", "__row", "whole", "rows"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in CLASHING})


def words(rng: random.Random, n: int, letters: str = "abcdefghij") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed: int = 0, n: int = 60):
    """(doc_id, text, lang, source) with copies, near copies, shared lines, nulls and extremes."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, 60))
    rows = []
    for i in range(n):
        own = words(rng, rng.choice([3, 12, 40, 120]))
        text = " ".join(own[: len(own) // 2]) + "\n" + " ".join(own[len(own) // 2 :])
        if i % 5 == 1:
            text = rows[-1][1] or text
        elif i % 5 == 2:
            near = (rows[-1][1] or text).split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        elif i % 7 == 3:
            text = shared + "\n" + text
        rows.append((i, text, "xx", rng.choice(["a", "a", "a", "b", "ä", None])))
    rows += [
        (100, None, None, None),
        (101, "", "xx", "a"),
        (102, " \t\n\x0b ", "xx", "b"),
        (103, "one", "xx", "b"),
        (104, "x " * 30_000, "xx", "b"),
        (105, "Éa  b\n" * 3, "xx", "ä"),
        (None, "no id " + shared, "xx", "a"),
        (None, None, None, None),
    ]
    # A repeated row, and one id with two texts.
    return rows + [rows[4], (5, "another text under an id in use", "xx", "b")]


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
