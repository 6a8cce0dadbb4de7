import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.llm import quality_rules

from .texts import DOCS, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measured(spark, texts):
    got = quality_rules.quality_rules_digest(documents(spark, list(enumerate(texts)))).collect()
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}, {r.doc_id: r for r in got}


def test_against_brute_force(spark):
    texts = [None, "", " \n\t ", "one", "a b c a b c a b", "x x x x x", prose(400, 1), f"{prose(60, 2)}\n" * 4, "# | & <b> $5 %", "é ü ß\nÉ\né ü ß", "a b c d", prose(30_000, 3)]
    got, _ = measured(spark, texts)
    assert got == {k: brute(t) for k, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é|", max_size=60), min_size=1, max_size=40))
def test_random_texts(spark, texts):
    got, _ = measured(spark, texts)
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_verdicts(spark):
    clean = " ".join(f"{w}{k}" if k % 3 else "the" for k, w in enumerate(prose(200, 5).split()))
    texts = [clean, "too short the", f"{prose(30, 6)} " * 5, " ".join(f"w{k} |" for k in range(100)), " ".join(f"zz{k}" for k in range(100)), None]
    _, rows = measured(spark, texts)
    assert [rows[k].base_failed for k in range(6)] == [False, True, True, False, False, True]
    assert [rows[k].kept for k in range(6)] == [True, False, False, False, False, False]


def test_no_python_in_the_plan_and_columns_pass(spark):
    docs = documents(spark, [(1, "a b c")]).withColumns({"n_words": F.lit("mine"), "extra": F.lit(1)})
    judged = quality_rules.judge(docs)
    assert "Python" not in judged._jdf.queryExecution().toString() and "Arrow" not in judged._jdf.queryExecution().toString()
    assert judged.first().extra == 1 and judged.first().n_words == 3
    assert quality_rules.quality_rules_digest(spark.createDataFrame([], DOCS)).count() == 0
