import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import bitmap, components, near_dedup, textkit

from .texts import DOCS, documents, prose, swap_words


def shingle_set(text, width=5):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts}
    ids = sorted(sets)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, n = [], 0
    for g in range(12):
        base = prose(rng.randint(40, 200), g, vocabulary)
        for k in range(rng.randint(1, 12)):
            edits = rng.choice((0, 0, 1, 2, 3, 6))
            texts.append((n := n + 1, swap_words(base, edits, 1000 + n) if edits else base.upper() if k % 2 else base))
    texts += [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one two"), (n + 5, "One  two"), (n + 6, "one"), (n + 7, prose(20_000, 9, vocabulary)), (n + 8, "a b c d e"), (n + 9, "É b c d e"), (n + 10, "é b c d e")]
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    texts = corpus()
    got = near_dedup.near_duplicates(documents(spark, texts), percent=percent).collect()
    assert sorted(map(tuple, got)) == brute(texts, percent)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group larger than a block is compared block by block, with chains across blocks kept."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = prose(120, 3, vocabulary)
    texts = [(k, swap_words(base, 1 + k % 4, k)) for k in range(1, 91)]
    got = near_dedup.near_duplicates(documents(spark, texts).repartition(5), percent=85).collect()
    assert sorted(map(tuple, got)) == brute(texts, 85)


def test_work_on_a_large_group_grows_in_proportion(spark, monkeypatch):
    """Rows compared for a bucket of near copies stay in proportion to its size, and the components are whole."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    counts, plain = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda rows, *a: counts.append(rows.count()) or plain(rows, *a))
    vocabulary = [f"w{k}" for k in range(3000)]
    base = prose(150, 3, vocabulary)
    texts = [(k, swap_words(base, 1, k)) for k in range(1, 401)]
    got = near_dedup.near_duplicates(documents(spark, texts).repartition(5), percent=85).collect()
    assert {r.component_id for r in got} == {1}
    assert counts[0] <= 400 * near_dedup.plan_bands(0.85)[1] and sum(counts[1:]) < counts[0] / 4


def test_texts_that_share_a_band_only(spark, monkeypatch):
    """A bucket of several blocks whose texts are mostly not linked: whatever is, is found."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "plan_bands", lambda threshold: (1, 200))
    vocabulary = [f"w{k}" for k in range(3000)]
    common = prose(60, 1, vocabulary)
    texts = [(k, f"{common} {prose(60 if k % 3 else 8, k // 2, vocabulary)}" + (" x" if k % 2 else "")) for k in range(1, 60)]
    got = near_dedup.near_duplicates(documents(spark, texts).repartition(3), percent=85).collect()
    assert sorted(map(tuple, got)) == brute(texts, 85)


def test_query_against_sql(spark):
    import duckdb

    texts = corpus()
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted(map(tuple, near_dedup.near_dedup_digest(docs).collect()))
    assert got == sorted(con.sql(near_dedup.ORACLE).fetchall()) == brute(texts, 85)


def test_bitmap(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(-(1 << 63), 1 << 63, 2000)
    made = bitmap.build(spark.createDataFrame([(int(v),) for v in values], "v long"), "v", 1 << 16)
    assert bitmap.holds(made, values).all() and bitmap.holds(made, rng.integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.01


def test_exact_copies_form_one_class(spark):
    texts = [(k, "the same words in every one of these copies") for k in range(300)]
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {(r.component_id, r.kept) for r in got} == {(0, True), (0, False)} and sum(r.kept for r in got) == 1


def test_nulls_repeats_and_columns(spark):
    text = "six words stand in this text"
    docs = documents(spark, [(None, text), (5, text), (5, text), (6, text), (7, None)])
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True)], key=str)
    docs = docs.withColumns({"kept": F.lit("x"), "rep": F.lit(1), "n": F.lit(2), "h": F.lit(3)})
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == [5, 5, 7, None]
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_bands_find_pairs_at_the_threshold():
    for t in (0.8, 0.85, 0.9):
        rows, bands = near_dedup.plan_bands(t)
        assert (1 - t**rows) ** bands < 1e-5 and rows * bands <= near_dedup.N_HASHES


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = near_dedup.hash_family()
    x = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    one, two = x[:2000], x[500:2500]  # similarity 0.6
    same = np.mean(near_dedup.signature(one, a, b) == near_dedup.signature(two, a, b))
    assert abs(same - 0.6) < 0.12


def test_word_hashes_follow_words():
    texts = ["Alpha beta\tALPHA", "", "beta", "x" * 10, "a b a"]
    import pyarrow as pa

    raw, offsets = textkit.arrow_bytes(pa.array([*texts, None]))
    hashes, first = textkit.word_hashes(raw, offsets)
    per_text = [hashes[first[k] : first[k + 1]].tolist() for k in range(6)]
    assert [len(x) for x in per_text] == [3, 0, 1, 1, 2, 0]
    assert per_text[0][0] == per_text[0][2] and per_text[0][1] == per_text[2][0] != per_text[0][0]


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    import pyarrow as pa

    text = prose(500, 4)
    raw, offsets = textkit.arrow_bytes(pa.array([text, text]))
    whole = textkit.word_hashes(raw, offsets)
    monkeypatch.setattr(textkit, "PIECE", 64)
    pieces = textkit.word_hashes(raw, offsets)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(500, 600 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e if n is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
