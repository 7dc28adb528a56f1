"""Small documents with the awkward cases that every operator must define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, h string, n string, rid string, key string, shard string"
EXTRA = (1, "x", "y", "z", "r", "k", "s")
WORDS = "the of and to in that wahr lich und der die das ist nicht mais pour avec dans une les".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "s", "en", "er")) + str(r.randrange(9) or "") for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    out = [
        (1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"),
        (4, None, "en", "a"), (5, "", None, None), (6, "", "de", None), (7, " \t\n ", "de", "a"), (8, "one two three", "de", "c"),
        (9, "one  two\nthree", "de", "c"), (None, "no id here", None, "a"), (None, base, "fr", "c"),
        (10, "x" * 3000 + " " * 2500 + prose(5, 20000), "fr", "c"), (11, "ÄÖÜ ß 漢字 👍🏽 " * 3, "fr", "Z"), (12, "12 34 !!", "fr", "ä"),
        (13, base.upper(), "en", "a"), (14, base + " ", "en", "a")]
    out += [(100 + i, prose(100 + i, 3 + i % 50), ("en", "de", "fr")[i % 3], ("a", "b", "c", "d")[min(i % 7, 3)]) for i in range(40)]
    return [(d, t, lang, s, None if t is None else len(t), *EXTRA) for d, t, lang, s in out]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
