import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as near_copies
from .texts import documents, prose, swap_words

pipeline = pytest.importorskip("corpus_pipeline")
EN = "the quick garden that would think and thing with nothing between".split()
DE = "der schnelle garten und nicht durch zwischen schule sich auch über".split()
SHARED = "this very line is shared by all of these documents"


def corpus():
    """(id, text, lang): clean texts, near and exact copies, shared lines, leaks, and odd rows."""
    items = [" ".join(f"q{k}x{j}" for j in range(20 + k)) for k in range(3)]
    rows = []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        own = " ".join(f"{w}" for w in prose(70, k, DE if lang == "de" else EN).split()) + " " + " ".join(f"own{k}word{j}" for j in range(30))
        rows.append((k, own + (f"\n{SHARED}" if k % 5 == 0 else ""), lang))
    rows += [(100 + k, swap_words(rows[k + 1][1], 1, k), "en") for k in range(4)]
    rows += [(200, rows[7][1], "en"), (201, rows[7][1], "en")]
    rows += [(300 + k, f"{prose(30, 500 + k, EN)} {item} {prose(30, 600 + k, EN)}", "en") for k, item in enumerate(items)]
    rows += [(400, None, "en"), (401, "", None), (402, "123 456", "en"), (403, f"{SHARED}\n{SHARED}", "en"), (None, f"{prose(40, 700, EN)} {items[0]}", None), (None, prose(60, 701, EN), "en"), (500, rows[9][1], "en"), (500, rows[9][1], "en")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = documents(spark, [(i, t) for i, t, _ in rows], None).drop("lang")
    langs = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string").dropDuplicates()
    docs = docs.join(langs, (docs.doc_id.eqNullSafe(langs.doc_id)) & docs.text.eqNullSafe(langs.text)).select(docs.doc_id, docs.text, langs.lang, docs.source, docs.n_chars)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def key(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_each_stage_against_brute_force(spark, folder):
    """What every stage keeps and changes, given what the one before it kept."""
    _, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        after = docs.collect()
        made[name] = before, after
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(after, docs.schema)
    before, after = made["language_id"]
    assert key(after) == key([r for r in before if r.text and any(map(str.isalpha, r.text))])
    before, after = made["line_dedup"]
    holders = {}
    for r in before:
        for line in r.text.split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), set()).add(-1 if r.doc_id is None else r.doc_id)
    common = {line: max(ids) for line, ids in holders.items() if len(line) >= 20 and len(ids) >= 3}
    stays = lambda line, i: common.get(line.strip(" \t\n\x0b\x0c\r").lower(), i) == i
    want = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if stays(x, -1 if r.doc_id is None else r.doc_id))) for r in before]
    assert SHARED in common and key(after) == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in after)
    before, after = made["near_dedup"]
    kept = {i for i, _, _, keep in near_copies([(r.doc_id, r.text) for r in before if r.doc_id is not None], 80) if keep}
    assert key(after) == key([r for r in before if r.doc_id is None or r.doc_id in kept]) and len(after) < len(before)
    before, after = made["decontaminate"]
    assert key(after) == key([r for r in before if not any(leaks(r.text, x) for x in items)]) and len(before) - len(after) == 4
    before, after = made["bpe"]
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    assert len(after) == len(before)
    texts = {}
    for r in before:
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in after:
        some = [library.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        assert r.ids in some and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    ids = sorted((str(r.doc_id) for r in rows))
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert not {"400", "402", "300", "301", "302"} & set(ids) and {"12", "201"} <= set(ids) and ids.count("None") == 1


def test_empty_table_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("mine") for c in ("__text", "r1", "h1", "key", "rep", "component_id", "score", "drops", "row", "c0")})
    for at, table in (("full", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        now = spark.read.parquet(f"{tmp_path}/{at}/documents.parquet")
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{at}")
            assert now.columns == docs.columns, name
        got = now.collect()
        assert all(r.key == r.c0 == r.score == "mine" for r in got) and bool(got) == (at == "full")
        assert pipeline.run(spark, f"{tmp_path}/{at}").count() == len(got)
