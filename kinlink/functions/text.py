"""Normalisation of names, addresses and countries, and the keys made from them.

Everything is built from Spark expressions but one step: taking apart letters that carry marks. For Latin letters that step
is a translation table in the JVM; text in other scripts goes through an Arrow function (see to_latin).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions import indic
from kinlink.functions.wordlists import COMPANY_WORDS, LEGAL_SUFFIXES, LIGATURES, NAME_ABBREVIATIONS, STREET_WORDS

WORD = r"\p{L}\p{N}_"
_SPACES = r"[\s\p{Z}]+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


@lru_cache
def _latin_table() -> tuple[str, str]:
    """Letters with marks in the Latin blocks and their base letters; marks themselves are deleted."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            pairs[chr(code)] = parts[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


def fold_latin(c: Column) -> Column:
    """Ligatures spelt out and marks dropped from Latin letters, in the JVM."""
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *_latin_table())


def latin_text(text: str) -> str:
    """Indic scripts in Latin letters, ligatures spelt out, compatibility forms taken apart, marks dropped."""
    text = indic.transliterate(text).translate(str.maketrans(LIGATURES))
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _latin_udf(texts: pd.Series) -> pd.Series:
    return texts.map(latin_text, na_action="ignore")


def to_latin(c: Column) -> Column:
    """latin_text for any script. Pure ASCII text passes by the Arrow function as null."""
    plain = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, c).otherwise(_latin_udf(F.when(~plain, c)))


def normalize_name(c: Column, fold: Callable[[Column], Column] = to_latin) -> Column:
    """A business name without marks, brackets, legal forms, punctuation and words with digits; null becomes empty."""
    c = F.lower(fold(text_or_empty(c)))
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    suffix = r"\b(?:" + "|".join(LEGAL_SUFFIXES) + r")\b"
    for _ in range(3):
        c = F.regexp_replace(c, suffix, " ")
    for pattern, word in NAME_ABBREVIATIONS:
        c = F.regexp_replace(c, pattern, word)
    c = F.translate(c, "&'/,.", "     ")
    c = collapse(F.regexp_replace(c, rf"[^{WORD}\s\p{{Z}}]", " "))
    return collapse(F.regexp_replace(c, rf"[{WORD}]*\p{{Nd}}[{WORD}]*", ""))


def normalize_address(c: Column, fold: Callable[[Column], Column] = to_latin) -> Column:
    """An address without marks and punctuation, street words in short; digits stay; null becomes empty."""
    c = F.lower(fold(text_or_empty(c)))
    for word, short in STREET_WORDS:
        c = F.regexp_replace(c, rf"\b{word}\b", short)
    return collapse(F.regexp_replace(c, rf"[^{WORD}\s\p{{Z}}]", " "))


def normalize_country(c: Column) -> Column:
    return F.lower(F.trim(text_or_empty(c)))


def is_non_latin(c: Column) -> Column:
    """1 if any letter is not Latin."""
    return F.coalesce(c.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), F.lit(False)).cast("int")


def has_indic(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[ऀ-ൿ]"), F.lit(False))


def has_unmapped(c: Column) -> Column:
    """Whether transliteration drops a character of an Indic script, as it has no letters for it."""
    return F.coalesce(c.rlike(f"[{indic.UNMAPPED}]"), F.lit(False))


def untransliterated(df: DataFrame, columns: tuple[str, ...] = ("business_name", "business_address")) -> DataFrame:
    """(column, rows, indic_rows, unmapped_rows): how many rows have Indic script, and how many lose characters of it."""
    count = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    each = [F.struct(F.lit(c).alias("column"), count(has_indic(F.col(c))).alias("indic_rows"), count(has_unmapped(F.col(c))).alias("unmapped_rows")) for c in columns]
    found = df.agg(F.count("*").alias("rows"), F.array(*each).alias("s")).select("rows", F.explode("s").alias("s"))
    return found.select("s.column", "rows", "s.indic_rows", "s.unmapped_rows")


def apply_normalization(df: DataFrame, fold: Callable[[Column], Column] = to_latin) -> DataFrame:
    """df with clean columns and script flags beside the raw ones, for those columns that exist."""
    made = {}
    for column, rule in (("business_name", normalize_name), ("business_address", normalize_address)):
        if column in df.columns:
            made[f"{column}_clean"] = rule(F.col(column), fold)
            made[f"{column}_is_non_latin"] = is_non_latin(F.col(column))
    if "country" in df.columns:
        made["country_clean"] = normalize_country(F.col("country"))
    return df.withColumns(made) if made else df


def tokens(c: Column) -> Column:
    """The words of clean text, in order."""
    bare = F.trim(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def initialism(c: Column) -> Column:
    """A short word itself in capitals, else the first letters of the words."""
    short = F.upper(F.trim(c))
    letters = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0), lambda w: F.upper(F.substring(w, 1, 1)))
    return F.when(short.rlike(r"\A\p{L}{2,6}\z"), short).otherwise(F.array_join(letters, ""))


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(F.lower(c))), " ")


def is_company_name(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"\b(?:" + "|".join(COMPANY_WORDS) + r")\b"), F.lit(False)).cast("int")


#: Legal forms as whole words, without the optional endings of their patterns.
CORE_STOP_WORDS = tuple(s.rstrip("?.\\") for s in LEGAL_SUFFIXES)


def name_core_key(name: Column, address: Column) -> Column:
    """The name without legal forms and the last two words of the address; null if the core is shorter than three."""
    core = F.array_join(F.filter(tokens(name), lambda t: ~t.isin(*CORE_STOP_WORDS)), " ")
    words = tokens(address)
    tail = F.when(F.size(words) > 2, F.slice(words, -2, 2)).otherwise(words)
    return F.when(F.length(core) >= 3, F.concat_ws("|", core, F.array_join(tail, " ")))


def pin_keys(address: Column) -> Column:
    """Runs of five or six digits that stand alone."""
    return F.regexp_extract_all(address, F.lit(r"\b\d{5,6}\b"), 0)


def digit_runs(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit(r"\d+"), 0))


def trigrams(c: Column) -> Column:
    """The set of runs of three characters of text without blanks; a shorter text is its only member."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    runs = F.transform(F.sequence(F.lit(1), F.length(bare) - 2), lambda i: F.substring(bare, i, F.lit(3)))
    return F.when(F.length(bare) < 3, F.array(bare)).otherwise(F.array_distinct(runs))


def shingles(c: Column) -> Column:
    """Trigrams of lower-cased text that has word characters only."""
    return trigrams(F.regexp_replace(F.lower(c), rf"[^{WORD}]", ""))


def views(df: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """df with nine views of each record as columns, from raw to phonetic."""
    first = df.withColumns(
        {
            "raw": text_or_empty(F.col(name)),
            "light": collapse(F.lower(text_or_empty(F.col(name)))),
            "aggressive": normalize_name(F.col(name)),
            "transliterated": to_latin(text_or_empty(F.col(name))),
            "parsed_components": F.split(text_or_empty(F.col(address)), r"\s*,\s*"),
            "_address": normalize_address(F.col(address)),
        }
    )
    return first.withColumns(
        {
            "tokens": tokens(F.col("aggressive")),
            "character_ngrams": trigrams(F.col("aggressive")),
            "numeric_tokens": digit_runs(F.col("_address")),
            "phonetic": F.soundex("aggressive"),
        }
    ).drop("_address")
