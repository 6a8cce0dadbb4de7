import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import quality_lm

from .texts import DOCS, documents, prose

LABEL = "doc_id long, quality int, toxic int"
N = quality_lm.ORDER


def events(text):
    framed = " " * (N - 1) + " ".join(text.split()) + " "
    return [(framed[i - N + 1 : i], framed[i]) for i in range(N - 1, len(framed))] if text.split() else []


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters, by dictionaries: the logarithms of a text's events."""
    counts = [Counter() for _ in range(N)]
    for t in texts:
        counts[N - 1].update(events(t))
    for size in range(N - 2, -1, -1):
        for ctx, c in counts[size + 1]:
            counts[size][ctx[1:], c] += 1
    levels = []
    for table in counts:
        tally = Counter(table.values())
        d = quality_lm.discounts(*(tally[k] for k in (1, 2, 3, 4)))
        total, mass = defaultdict(float), defaultdict(float)
        for (ctx, c), n in table.items():
            total[ctx] += n
            mass[ctx] += d[min(n, 3) - 1]
        levels.append((table, d, total, mass))

    def p(ctx, c):
        table, d, total, mass = levels[len(ctx)]
        lower = p(ctx[1:], c) if ctx else 1 / (len(table) + 1)
        if ctx not in total:
            return lower
        n = table.get((ctx, c), 0)
        return (n - (d[min(n, 3) - 1] if n else 0)) / total[ctx] + mass[ctx] / total[ctx] * lower

    return lambda text: [math.log(p(*e)) for e in events(text)]


def figures(logs, text):
    """Sum, number and mean rate of the worst words."""
    rates, at = [], 0
    for w in text.split():
        rates.append(sum(logs[at : at + len(w) + 1]) / (len(w) + 1))
        at += len(w) + 1
    worst = sorted(rates)[: quality_lm.WORST]
    return sum(logs), len(logs), sum(worst) / max(len(worst), 1)


TRAIN = [prose(200, k) for k in range(3)] + ["a zig zag", "bridge! over, river"]
TEXTS = ["the river", "river of stone zebra", "Ünseen wörds", "x", "light-quiet! 12 \t a\n\nb", prose(300, 8), "", "### ### zig", "a\0b"]


def trained(spark, rows):
    return quality_lm.train(quality_lm.count(spark.createDataFrame(rows, "fold int, lang string, text string")))


@pytest.fixture(scope="module")
def model(spark):
    return trained(spark, [(0, "en", t) for t in TRAIN])


@pytest.mark.parametrize(("most", "bits"), [(None, 64), (400, 1 << 20), (400, 64), (60, 1 << 20), (1, 64)])
def test_against_brute_force(spark, model, most, bits, monkeypatch):
    """Whatever is broadcast, all, some or nothing, and however full the bitmap is, the figures are the same."""
    monkeypatch.setattr(quality_lm, "BITMAP_BITS", bits)
    rows = spark.createDataFrame([(k, False, "0:en", t) for k, t in enumerate(TEXTS)], "doc_id long, trusted boolean, model string, text string")
    got = {r.doc_id: (r.logp, r.n, r.worst) for r in quality_lm.score(rows, model, most).collect()}
    logs = brute_model(TRAIN)
    assert (quality_lm.hot_entries(model, most or quality_lm.HOT_ENTRIES)[-2] is None) == (most is None)
    for k, t in enumerate(TEXTS):
        assert got[k] == pytest.approx(figures(logs(t), t), rel=1e-5)


def test_probabilities_add_up_and_levels_nest(model):
    rows = model.where("model = '0:en'").collect()
    assert sum(math.exp(r.logp) for r in rows if r.logp is not None and len(r.s) <= 1) == pytest.approx(1.0, abs=1e-5)
    level = {r.s: r.level for r in rows if r.back_off is not None}
    assert all(level[s[1:]] >= n for s, n in level.items() if len(s) > 1)


def test_words_out_of_order_score_worse(spark):
    text = "winter market silver road music evening letter bridge"
    model = trained(spark, [(0, "en", f"{text} {text}")] * 4)
    rows = [(1, False, "0:en", text), (2, False, "0:en", " ".join(sorted(text.split()))), (3, False, "0:en", "road " * 8)]
    got = {r.doc_id: r.logp / r.n for r in quality_lm.score(spark.createDataFrame(rows, "doc_id long, trusted boolean, model string, text string"), model).collect()}
    assert got[1] > got[2] + 0.05 and got[1] > got[3] + 0.05


def test_long_texts_in_pieces(monkeypatch):
    text = prose(3000, 5) + " " + "y" * 700
    whole = [e for part in quality_lm.pieces(text) for e in range(N - 1, len(part))]
    monkeypatch.setattr(quality_lm, "PIECE", 500)
    parts = list(quality_lm.pieces(text))
    assert len(parts) > 20 and max(map(len, parts)) <= 500 + N
    assert sum(len(p) - N + 1 for p in parts) == len(whole) + 1  # the overlong word is cut once
    assert "".join(p[N - 1 :] for p in parts).replace(" ", "") == text.replace(" ", "")


def test_counts_of_used_models(spark):
    top = quality_lm.count(spark.createDataFrame([(0, "en", "ab"), (0, "de", "ab"), (1, "en", "ab"), (0, None, "cd")], "fold int, lang string, text string"))
    used = spark.createDataFrame([("0:de",), ("0:*",)], "model string")
    got = {(r.model, r.ctx, r.c): r.n for r in quality_lm.count_for(top, used).collect()}
    assert {m for m, _, _ in got} == {"0:de", "0:*"}
    assert got["0:de", "   a", "b"] == 1 and got["0:*", "   a", "b"] == 2 and got["0:*", "   c", "d"] == 1


def test_key_table():
    keys = np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64)
    inverse = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    keys[1000:1400] = np.arange(1, 401, dtype=np.uint64) * inverse  # one place for all
    table = quality_lm.KeyTable(keys, np.arange(5000.0))
    found, values = table.look_up(keys)
    assert found.all() and (values == np.arange(5000)).all()
    assert not table.look_up(keys ^ np.uint64(1 << 50))[0].any()
    assert not quality_lm.KeyTable(keys[:0], np.zeros(0)).look_up(keys)[0].any()


def by_id(got):
    return {r.doc_id: r for r in got}


def test_verdicts_against_brute_force(spark):
    """Perplexities, thresholds and verdicts of the whole query, with models by fold and language."""
    texts = [(k, prose(60 + k, k)) for k in range(40)] + [(50, "moron qvxz " + prose(60, 51)), (51, "### $$$ " * 30)]
    docs = documents(spark, texts, {k: "de" if k % 4 == 0 else "en" for k, _ in texts})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], LABEL)
    got = by_id(quality_lm.quality_lm_digest(docs, labels).collect())
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    lang = {k: "de" if k % 4 == 0 else "en" for k, _ in texts}
    models, want = {}, {}
    for f in (0, 1):
        for name in ("de", "en"):
            models[f, name] = brute_model([t for k, t in texts if k < 30 and fold[k] == f and lang[k] == name])
    for k, t in texts:
        logp, n, worst = figures(models[1 - fold[k], lang[k]](t), t)
        want[k] = math.exp(-logp / n), math.exp(-worst)
        assert (got[k].perplexity, got[k].worst) == pytest.approx(want[k], rel=1e-4)
    for name in ("de", "en"):
        held = [k for k in range(30) if lang[k] == name]
        limit = [max(got[k][c] for k in held) for c in ("perplexity", "worst")]  # the 0.995 quantile of so few is the greatest
        for k, _ in texts:
            if lang[k] == name:
                assert [got[k].threshold, got[k].worst_threshold] == limit
                assert got[k].kept == (got[k].perplexity <= limit[0] and got[k].worst <= limit[1])
    assert not got[50].kept and not got[51].kept and all(got[k].kept and got[k].trusted for k in range(30))


def test_odd_rows(spark):
    texts = [(k, prose(80, k)) for k in range(40)]
    texts += [(200, None), (201, ""), (202, " \n"), (203, prose(80, 99)), (203, prose(80, 99)), (None, prose(80, 98)), (204, prose(30_000, 3))]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(30, 0, 0), (31, None, None), (5, 1, 1), (None, 1, 0)], LABEL)
    got = quality_lm.quality_lm_digest(documents(spark, texts, {203: None, 204: "xx"}), labels).collect()
    by = by_id(got)
    assert len(got) == len(texts)
    assert all(by[k].perplexity is None and not by[k].kept for k in (200, 201, 202))
    assert by[203].lang == by[204].lang == "*" and by[203].perplexity and by[204].perplexity < 3 and by[None].perplexity
    assert not by[5].trusted and by[6].trusted and by[6].kept
    again = [(r.perplexity, r.kept) for r in got if r.doc_id == 203]
    assert len(again) == 2 and len(set(again)) == 1


def test_one_trusted_text(spark):
    """All trusted text in one fold: its models serve both."""
    labels = spark.createDataFrame([(1, 1, 0)], LABEL)
    got = by_id(quality_lm.quality_lm_digest(documents(spark, [(k, prose(50, k)) for k in range(6)]), labels).collect())
    assert all(r.perplexity for r in got.values()) and got[1].kept


def test_without_trusted_text_and_empty(spark):
    labels = spark.createDataFrame([], LABEL)
    got = quality_lm.quality_lm_digest(documents(spark, [(1, "some text")]), labels).collect()
    assert [(r.doc_id, r.perplexity, r.kept) for r in got] == [(1, None, False)]
    assert quality_lm.quality_lm_digest(spark.createDataFrame([], DOCS), labels).count() == 0


def test_extra_columns(spark):
    docs = documents(spark, [(k, prose(50, k)) for k in range(5)]).withColumns({"row": F.lit("x"), "model": F.lit(1), "trusted": F.lit(2), "fold": F.lit("y")})
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)], LABEL).withColumns({"text": F.lit("y"), "lang": F.lit("z")})
    assert all(r.kept for r in quality_lm.quality_lm_digest(docs, labels).collect())
