import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from kinlink.llm import line_dedup

from .texts import DOCS, documents

SPACE = " \t\n\x0b\x0c\r"
SHARED = "This line is common to very many documents"


def brute(texts, least=20, docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(lower)
    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


TEXTS = [
    (1, f"first\n  {SHARED.upper()}\t\nlast"),
    (2, f"{SHARED}\n{SHARED}\n\nÀ LA FIN"),
    (3, SHARED),
    (9, f"{SHARED}\nonly here\n{SHARED}"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "short\nshort"),
    (8, "short"),
    (10, "x" * 200_000 + "\n" + SHARED),
    (11, "a line with exactly20\n" * 3),
    (12, "a line with exactly20"),
]


def test_against_brute_force(spark):
    got = line_dedup.line_dedup_digest(documents(spark, TEXTS)).collect()
    assert sorted(map(tuple, got)) == brute(TEXTS)


def test_hot_line_and_partitions(spark):
    texts = [(i, f"{SHARED}\nown line of document number {i}") for i in range(400)]
    for n in (1, 7):
        got = line_dedup.line_dedup_digest(documents(spark, texts).repartition(n)).collect()
        assert sorted(map(tuple, got)) == brute(texts)


def test_repeated_rows_share_their_result(spark):
    texts = [(1, SHARED), (1, SHARED), (2, SHARED)]
    got = sorted(map(tuple, line_dedup.line_dedup_digest(documents(spark, texts)).collect()))
    assert [r[2] for r in got] == [0, 0, 0]  # two documents only
    got = line_dedup.line_dedup_digest(documents(spark, [*texts, (3, SHARED)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 0)]


def test_rows_without_id_rank_lowest(spark):
    got = line_dedup.line_dedup_digest(documents(spark, [(None, SHARED), (1, SHARED), (2, SHARED)])).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {None: 1, 1: 1, 2: 0}


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.line_dedup_digest(spark.createDataFrame([], DOCS)).count() == 0
    docs = documents(spark, TEXTS).withColumns({"n_lines": F.lit("x"), "drops": F.lit(1), "key": F.lit(2), "h1": F.lit(3)})
    cleaned = line_dedup.clean_lines(docs)
    assert cleaned.columns == docs.columns
    assert all(r.n_lines == "x" and r.n_chars == len(r.text or "") for r in cleaned.where("text is not null").collect())
