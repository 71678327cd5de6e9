"""Small tables with the awkward cases: nulls, empty, blank and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows(seed: int = 1, n: int = 40):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randrange(3, 120)), rng.choice(["en", "de", None]), f"s{i % 3}", 1) for i in range(n)]
    out += [(n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \n\t", "en", "s0", 3), (None, "null id here", "en", "s1", 1)]
    out += [out[3], out[3], (n + 3, out[4][1], "en", "s2", 1), (n + 4, "word " * 3000, "de", "s0", 1)]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(frame):
    """The same with columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ("size", "score", "tag", "key", "k", "shard", "fp", "kept", "target", "component", "_row", "_tag", "spans", "n", "h", "bucket")
    return frame.select("*", *[F.lit(7).alias(c) for c in names])
