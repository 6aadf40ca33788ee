"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with working columns."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return " ".join(rng.choice(pool) for _ in range(n))


def edited(text, k, seed=0):
    rng, w = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{i}x{seed}"
    return " ".join(w)


def rows():
    base, other = prose(1, 300), prose(2, 250)
    out = [(10, base, "a", "en"), (11, base, "a", "en"), (12, edited(base, 2), "b", "en"), (13, edited(base, 9), "b", None), (14, edited(base, 4, 5), None, "de"),
           (20, other, "c", "de"), (20, other, "c", "de"), (20, prose(3, 40), "c", "de"), (21, None, "c", "fr"), (22, "", None, "fr"), (23, " \t\n", "a", "fr"),
           (24, "one", "a", "en"), (25, "One", "a", "en"), (26, "two words", "b", "en"), (27, "Ünï – çødé\x00  日本", "b", None), (-5, prose(4, 3000), "d", "en"),
           (None, base, "a", "en"), (None, None, None, None), (30, "x" * 60 + other, "d", "en"), (31, "y" * 300, "d", "en"), (32, "y" * 120, "d", "en"),
           (40, "A note.\nReleased under  the MIT license.\nApache License, Version 2.0", "a", "en"), (41, "cc by-nc and cc by nc cc", "a", "en")]
    return [(*r, 1, 2, 3, "t") for r in out]


SCHEMA = "doc_id bigint, text string, source string, lang string, size int, shard int, node int, h string"


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
