import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import decontaminate

from .texts import DOCS, documents, prose, swap_words

VOCABULARY = [f"term{k}" for k in range(4000)]
ITEM = "item_id long, text string"


def passage(n, seed):
    return prose(n, seed, VOCABULARY)


def found(spark, texts, items):
    got = decontaminate.find_overlaps(documents(spark, texts), spark.createDataFrame(items, ITEM)).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def brute(doc, item, least=12, percent=80):
    """Whether any aligned run has enough words and equal words."""
    import re

    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    d, t = words(doc), words(item)
    need = min(least, -(-len(t) * percent // 100))
    for shift in range(-len(t) + 1, len(d)):
        same = [0 <= shift + k < len(d) and d[shift + k] == t[k] for k in range(len(t))]
        for a in range(len(t)):
            for b in range(a + need, len(t) + 1):
                inside = all(0 <= shift + k < len(d) for k in (a, b - 1))
                if inside and same[a] and same[b - 1] and 100 * sum(same[a:b]) >= percent * (b - a):
                    return True
    return False


def test_against_brute_force(spark):
    items = [(k, passage(n, 100 + k)) for k, n in enumerate((15, 25, 40, 56, 8))]
    texts, n = [], 0
    for k, item in items:
        size = len(item.split())
        for edits in (0, 1, size // 10, size // 6, size // 3):
            n += 1
            texts.append((n, f"{passage(30, n)} {swap_words(item, edits, n) if edits else item.upper().replace(' ', ', ')}. {passage(60, 900 + n)}"))
        words = item.split()
        texts.append((n := n + 1, f"{passage(20, n)} {' '.join(words[: len(words) // 2])} {passage(20, n + 500)}"))
        texts.append((n := n + 1, passage(200, 5000 + n)))
    got = set(found(spark, texts, items))
    want = {(i, k) for i, t in texts for k, item in items if brute(t, item)}
    assert got == want and len(want) >= 15


def good_run(same, least=12, percent=80):
    """Whether a run of equal (1) and other words, beginning and ending with equal ones, is long and equal enough."""
    need = min(least, -(-len(same) * percent // 100))
    return any(same[a] and same[b - 1] and 100 * sum(same[a:b]) >= percent * (b - a) for a in range(len(same)) for b in range(a + need, len(same) + 1))


@pytest.mark.parametrize("size", [*range(1, 17), 20])
def test_no_overlap_is_without_a_seed(size):
    """For every choice of replaced words of items of these lengths (of up to five for the longest)."""
    masks = decontaminate.MASKS[decontaminate.mask_class(size)]
    choices = itertools.product((0, 1), repeat=size) if size <= 14 else ([k not in out for k in range(size)] for n in range(6) for out in itertools.combinations(range(size), n))
    for same in choices:
        if good_run(list(map(int, same))):
            seeded = any(all(same[at + k] for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(size - len(m) + 1))
            assert seeded, same


def test_best_overlap_against_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        item, doc = rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 3, n + 5).astype(np.uint64)
        diagonal = int(rng.integers(-3, 6))
        lo, hi = max(0, -diagonal), min(n, len(doc) - diagonal)
        same = [int(doc[k + diagonal] == item[k]) for k in range(lo, hi)]
        need = int(rng.integers(1, 8))
        runs = [(b - a, -a) for a in range(len(same)) for b in range(a + need, len(same) + 1) if same[a] and same[b - 1] and 100 * sum(same[a:b]) >= 80 * (b - a)]
        length, start = max(runs, default=(0, 0))
        got = decontaminate.best_overlap(doc, item, diagonal, need, 80)
        assert got == ((length, sum(same[-start : -start + length]), -start + lo + diagonal) if runs else (0, 0, 0))


def test_short_items(spark):
    """Items of 1 to 10 words are found with as many words replaced as four fifths allow, and not with one more."""
    items = [(k, passage(k, 50 + k)) for k in range(1, 11)]
    texts, want = [], set()
    for k, item in items:
        words = item.split()
        for n, out in enumerate([(), (k // 2,), (k // 3, 2 * k // 3 + 1)]):
            changed = " ".join("other" if at in out else w for at, w in enumerate(words))
            texts.append((100 * k + n, f"{passage(30, 800 + 10 * k + n)} {changed} {passage(30, 900 + 10 * k + n)}"))
    got = set(found(spark, texts, items))
    want = {(i, k) for i, t in texts for k, item in items if brute(t, item)}
    assert got == want and {(500, 5), (501, 5), (600, 6), (601, 6)} <= want


def test_query_against_brute_force(spark):
    """All columns of the whole query, for documents with leaks of every kind."""
    items = [(k, passage(14 + 3 * k, 300 + k)) for k in range(6)]
    texts = [(k, f"{passage(20, 40 + k)} {swap_words(items[k % 6][1], k % 4, k)} {passage(25, 70 + k)}") for k in range(24)]
    rows = decontaminate.decontamination_hits(documents(spark, texts), spark.createDataFrame(items, ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, k) for i, t in texts for k, item in items if brute(t, item)}
    by = dict(texts)
    for r in rows:
        d, t = by[r.doc_id].split(), items[r.item_id][1].split()
        shift = 20
        same = [d[shift + k] == w for k, w in enumerate(t)]
        runs = [(b - a, -a) for a in range(len(t)) for b in range(a + 12, len(t) + 1) if same[a] and same[b - 1] and 5 * sum(same[a:b]) >= 4 * (b - a)]
        length, start = max(runs)
        assert (r.n_words, r.n_matched, r.word_start, r.contaminated) == (length, sum(same[-start : -start + length]), shift - start, True)


def test_leaks_without_an_id_are_dropped(spark):
    item = passage(20, 1)
    docs = documents(spark, [(None, item), (None, passage(20, 2)), (3, f"{item} x"), (3, "clean text"), (4, None)])
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], ITEM)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text) == [("3", "clean text"), ("None", passage(20, 2))] and len(left) == 3


def test_places_and_lengths(spark):
    item = passage(30, 1)
    row = found(spark, [(1, f"{passage(50, 2)} {item} {passage(10, 3)}")], [(7, item)])[1, 7]
    assert (row.n_words, row.n_matched, row.word_start) == (30, 30, 50)


def test_clean_and_odd_rows(spark):
    item = passage(20, 1)
    texts = [(1, passage(500, 2)), (2, None), (3, ""), (4, item), (4, item), (None, item), (5, f"{item} " * 300)]
    got = found(spark, texts, [(1, item), (1, item), (2, None), (3, "..."), (None, passage(20, 9))])
    assert set(got) == {(4, 1), (None, 1), (5, 1)}


def test_a_passage_in_very_many_documents(spark):
    item = passage(40, 1)
    texts = [(k, f"{passage(20, 9000 + k)} {item}") for k in range(1, 301)]
    assert len(found(spark, texts, [(0, item), (1, passage(40, 2))])) == 300


def test_empty_tables_and_columns(spark):
    none = spark.createDataFrame([], ITEM)
    docs = documents(spark, [(1, passage(20, 1))]).withColumns({"row": F.lit("x"), "start": F.lit(1), "words": F.lit(2), "h1": F.lit(3), "c1": F.lit(4), "key": F.lit(5)})
    assert decontaminate.drop_contaminated(docs, none).collect() == docs.collect()
    items = spark.createDataFrame([(1, passage(20, 1))], ITEM)
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 0
    assert decontaminate.decontamination_hits(spark.createDataFrame([], DOCS), items).count() == 0
