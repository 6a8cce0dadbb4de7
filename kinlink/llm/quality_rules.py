"""Document quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions evaluated row by row in the JVM; nothing is shuffled and no
user function runs. Words are runs of anything but ASCII white space.

Defined results: a null or empty text has no words, zero measures, and fails the base rule;
repeated rows are judged alike; very long texts cost n log n; columns of the input that share a
measure's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for as was with be on not he by are this at from or "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par au "
    "el los y las se del por con no su para lo es"
).split()

_SPACE = r"[ \t\n\x0B\f\r]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Applied to texts that pass the base rule.
RULES = (
    Rule("n_words", low=50, high=10_000_000),
    Rule("mean_word_chars", low=2.0, high=16.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.6),
)


def words_of(text: Column) -> Column:
    """The words in order; an empty array for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE, -1))


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash for each run of three words, by position of its first."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered_words(words: Column, sorted_windows: Column) -> Column:
    """How many words lie in a three-word window that occurs again in the text.

    sorted_windows: (hash, place) of each window in order, so that equal windows are neighbours, in the order of their places. Neighbours
    count only if their words are equal; a window between two equal ones would need all 64 bits of their hash.
    """

    def same(p: Column, q: Column) -> Column:
        equal = p["h"] == q["h"]
        for k in range(3):
            equal = equal & (F.get(words, p["i"] + k) == F.get(words, q["i"] + k))
        return F.coalesce(equal, F.lit(False))

    twice = F.filter(sorted_windows, lambda p, k: same(p, F.get(sorted_windows, k - 1)) | same(p, F.get(sorted_windows, k + 1)))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures of each text added as columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), mean_word_chars,
    symbol_ratio, stop_word_ratio, dup_line_ratio (double).
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    made |= {"mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio"}
    own = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in made}
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Inner names, so that no column of docs clashes with the ones made here.
    split = docs.select(
        *[F.col(c).alias(n) for c, n in own.items()],
        words_of(F.col(text_col)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE_CHARS)) != "").alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    hashed = split.select("*", _window_hashes(F.col("words")).alias("hashes"))
    windows = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = hashed.select("*", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), windows).alias("windows")).drop("hashes")
    stop = F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))
    counted = placed.select(
        *own.values(),
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        stop.alias("n_stop"),
        F.when(F.col("windows").isNull(), F.lit(0)).otherwise(_covered_words(F.col("words"), F.col("windows"))).cast("long").alias("n_repeat_words"),
    )
    per_word = F.greatest("n_words", F.lit(1))
    return counted.select(
        *[F.col(n).alias(c) for c, n in own.items()],
        *sorted(made & set(counted.columns)),
        (F.col("word_chars") / per_word).alias("mean_word_chars"),
        (F.col("n_symbols") / per_word).alias("symbol_ratio"),
        (F.col("n_stop") / per_word).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for a whole threshold table."""
    fits = F.lit(True)
    for r in rules:
        if r.low is not None:
            fits = fits & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            fits = fits & (F.col(r.measure) <= F.lit(r.high))
    return fits


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all measures, base_failed (too few words, or over half of them in repeats) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measure(docs, text_col).withColumn("base_failed", base)
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = (
    r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, rowid_ AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), again AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains(["""
    + ", ".join(f"'{w}'" for w in STOP_WORDS)
    + r"""], lower(x)))) AS n_stop
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 16.0
        AND n_symbols / greatest(n_words, 1) <= 0.1 AND n_stop / greatest(n_words, 1) >= 0.02
        AND n_dup_lines / greatest(n_lines, 1) <= 0.6) AS kept
FROM b
"""
)
