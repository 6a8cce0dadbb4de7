"""Invented texts for the tests of this folder."""

import random

WORDS = "the a of river stone light quiet garden seven window paper cloud winter market silver road music evening letter bridge".split()


def prose(n, seed, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def swap_words(text, n, seed):
    rng = random.Random(seed)
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None):
    """texts: (doc_id, text) pairs."""
    rows = [(i, t, (langs or {}).get(i, "en"), "src0", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)
