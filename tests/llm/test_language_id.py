import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinlink.llm import language_id

from .texts import DOCS, documents, prose

EN = "the quick garden that would think and thing with nothing between".split()
DE = "der schnelle garten und nicht durch zwischen schule sich auch über".split()


def corpus(n=60):
    texts = [(k, prose(40, k, EN if k % 2 else DE)) for k in range(n)]
    return texts, {k: "en" if k % 2 else "de" for k in range(n)}


def test_held_out_accuracy(spark):
    texts, langs = corpus()
    texts += [(100, "thinkable withing the"), (101, "schulgarten durchschnitt")]
    langs |= {100: "de", 101: "en"}  # wrong on purpose, and without influence if held out
    got = {r.doc_id: r for r in language_id.language_id_digest(documents(spark, texts, langs)).collect()}
    for k in range(60):
        assert got[k].lang_pred == langs[k] and got[k].score > 0.99
    import zlib

    assert {k: r.held_out for k, r in got.items()} == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in got}


def test_backoff_scores(spark):
    """Votes against a plain computation: words, then the longest n-grams known."""
    texts, langs = corpus(20)
    model = language_id.train(documents(spark, texts, langs))
    counts = {lang: Counter() for lang in ("de", "en")}
    for k, t in texts:
        counts[langs[k]].update(t.split())
    gram = {size: {lang: Counter() for lang in counts} for size in language_id.ORDERS}
    for size in gram:
        for lang, c in counts.items():
            for w, n in c.items():
                for g in language_id.grams_of(w, size):
                    gram[size][lang][g] += n

    def logs(table, key):
        return np.array([math.log(table[lang][key] + 0.5) - math.log(sum(table[lang].values()) + 2) for lang in ("de", "en")])

    for word in ("the", "schule", "thinking", "gartenschule", "xyz", "üüü", "q"):
        if any(counts[lang][word] for lang in counts):
            want = logs(counts, word)
        else:
            want = np.zeros(2)
            for size in language_id.ORDERS:
                known = [g for g in language_id.grams_of(word, size) if any(gram[size][lang][g] for lang in counts)]
                if known:
                    want = np.mean([logs(gram[size], g) for g in known], axis=0)
                    break
        want = np.maximum(want - want.max(), -language_id.VOTE)
        assert np.allclose(model.vote(word), want)
        assert np.allclose(language_id.Predictor(model).scores([word, "the"])[0], want)


def test_query_against_brute_force(spark):
    """Every prediction and score of the query, from plain counts over the rows it may learn from."""
    import zlib

    texts, langs = corpus(40)
    odd = {100: "thinkable schulgarten the the", 101: "xyz über qqq", 102: None, 103: "1 2 3", 104: "durchschnitt, withinn; THE Garten!", 105: prose(400, 9, EN + DE)}
    langs |= {100: None, 101: "fr", 102: "en", 103: "de", 104: None, 105: "en"}
    texts += list(odd.items())
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k, _ in texts}
    counts = {}
    for k, t in texts:
        if t and langs[k] and not held[k]:
            counts.setdefault(langs[k], Counter()).update(language_id.words_in(t))
    names = sorted(counts)
    gram = {size: {lang: Counter() for lang in names} for size in language_id.ORDERS}
    for size in gram:
        for lang, c in counts.items():
            for w, n in c.items():
                for g in language_id.grams_of(w, size):
                    gram[size][lang][g] += n

    def vote(word):
        score = np.zeros(len(names))
        tables = [(counts, [word]), *((gram[size], language_id.grams_of(word, size)) for size in language_id.ORDERS)]
        for table, keys in tables:
            known = [k for k in keys if any(table[lang][k] for lang in names)]
            if known:
                score = np.mean([[math.log(table[lang][k] + 0.5) - math.log(sum(table[lang].values()) + 2) for lang in names] for k in known], axis=0)
                break
        return np.maximum(score - score.max(), -language_id.VOTE)

    got = {r.doc_id: r for r in language_id.language_id_digest(documents(spark, texts, langs)).collect()}
    for k, t in texts:
        words = language_id.words_in(t)
        assert got[k].held_out == held[k]
        if not words:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        total = sum(vote(w) for w in words)
        share = np.exp(total - total.max())
        assert got[k].lang_pred == names[int(total.argmax())] and abs(got[k].score - share.max() / share.sum()) < 1e-9, k


def test_undetermined_and_odd_rows(spark):
    texts, langs = corpus(12)
    odd = [(50, None), (51, ""), (52, "123 ... ½ ²"), (53, "the " * 50_000), (54, "the"), (54, "the"), (None, "garten und")]
    got = language_id.language_id_digest(documents(spark, [*texts, *odd], langs | {50: None, 52: None})).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[50] == by[51] == by[52] == ("und", 0.0)
    assert by[53][0] == by[54][0] == "en" and by[None][0] == "de" and len(got) == 19
    assert all(0 <= r.score <= 1 for r in got)


def test_no_training_rows_and_empty(spark):
    docs = documents(spark, [(1, "some text")], {1: None})
    assert language_id.language_id_digest(docs).first().lang_pred == "und"
    assert language_id.language_id_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_words_keep_combining_marks():
    assert language_id.words_in("हिन्दी भाषा x12y ภาษาไทย e\u0301te\u0301 a_b") == ["हिन्दी", "भाषा", "x", "y", "ภาษาไทย", "e\u0301te\u0301", "a", "b"]
    latin = "".join(map(chr, range(32, 0x300))).lower().replace("\u0307", "")
    assert language_id._LETTERS.findall(latin) == language_id._LATIN_LETTERS.findall(latin)
    assert language_id.words_in("a½b ² ß") == ["a", "b", "ß"] and language_id.words_in(None) == []


def test_filter_keeps_columns(spark):
    texts, langs = corpus(12)
    docs = documents(spark, [*texts, (90, "123")], langs).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(3), "__text": F.lit(4), "__row": F.lit(5), "c0": F.lit(6)})
    assert set(language_id.predict_languages(docs, language_id.train(docs)).columns) == set(docs.columns)
    kept = language_id.keep_identified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"mine"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))


def test_bounds_on_tables(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_WORDS", 3)
    texts = [(k, "alpha alpha alpha alpha beta beta gamma delta") for k in range(4)]
    model = language_id.train(documents(spark, texts))
    assert set(model.tables[0][0]) == {"alpha", "beta"}


def test_words_beyond_the_broadcast_count(spark, monkeypatch):
    """Scores do not depend on how many words are broadcast, nor on the size of the packs of n-grams."""
    texts, langs = corpus(20)
    odd = {100: "schule the the garten", 101: "thinkable schulgarten", 102: "nothing", 103: "q"}
    docs = documents(spark, [*texts, *odd.items()], langs | dict.fromkeys(odd))
    model = language_id.train(docs)
    want = {k: sum(model.vote(w) for w in t.split()) for k, t in [*texts, *odd.items()]}
    monkeypatch.setattr(language_id, "MAX_WORDS", 2)
    monkeypatch.setattr(language_id, "PACK_VALUES", 60)
    small = language_id.train(docs)
    assert len(small.common[0]) <= 4
    for r in language_id.predict_languages(docs, small).collect():
        share = np.exp(want[r.doc_id] - want[r.doc_id].max())
        assert r.lang_pred == ("de", "en")[int(want[r.doc_id].argmax())] and abs(r.score - share.max() / share.sum()) < 1e-9


def test_no_cap_on_languages_and_long_runs(spark):
    langs = {k: f"l{k:03d}" for k in range(203)}
    texts = [(k, chr(0x4E00 + 2 * k) * 50 + " " + chr(0x4E01 + 2 * k) * 3) for k in range(203)]
    docs = documents(spark, texts, langs)
    model = language_id.train(docs)
    assert len(model.langs) == 203
    asked = documents(spark, [(1, chr(0x4E00 + 2 * 202) * 7), (2, texts[201][1])], {1: None, 2: None})
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(asked, model).collect()}
    assert got == {1: "l202", 2: "l201"}
