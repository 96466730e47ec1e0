"""Small awkward inputs shared by the corpus tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, rejected string, fp string, n string, kept string"
_rng = random.Random(4)
WORDS = {"en": "the of and river water stone house light under every morning people".split(), "de": "der die und haus wasser stein licht unter jeden morgen leute straße".split()}


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ",", "."]) for _ in range(n))


def documents(spark, extra=()):
    """Nulls in every column, empty and very long texts, copies, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, prose("en" if i % 2 else "de", 30 + i % 7, i), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "", None), (103, "   \n\t ", "de"), (104, "12345 !!!", "en"), (None, "no id at all here", "en")]
    rows += [(110, prose("en", 60, 900), "en"), (111, prose("en", 60, 900), "en"), (112, prose("en", 60, 900), "en"), (112, prose("en", 60, 900), "en"), (113, prose("en", 60, 900) + "x", None)]
    rows += [(120, prose("de", 40_000, 7), "de"), (121, "a" * 200_000, None), (122, prose("de", 40_000, 7), "de"), (123, prose("de", 40_000, 7) + "!", "de")]
    rows += list(extra)
    return spark.createDataFrame([(i, t, lang, None, None, "x", "y", "z", "f", None, "k") for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
