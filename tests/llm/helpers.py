"""Small documents for the corpus operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, at string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if k % 3 else None, "src0" if k % 2 else None, len(t or ""), "k", 7, "a") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def odd_texts():
    """Null, empty, blank, repeated, short and very long texts."""
    return [None, "", " \n\t ", "One two", "one TWO", "a\x1cb", "naïve café 日本 🙂", "x" * 5000, prose(1, 6000), "same same same same same same same", None, ""]
