"""The functions that Spark's expressions lack, under names for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions import fuzzy, indic, phonetic, text


@F.pandas_udf(T.StringType())
def _indic_to_latin(texts: pd.Series) -> pd.Series:
    return texts.map(indic.transliterate, na_action="ignore")


#: Arrow functions by their names in SQL.
FUNCTIONS = {
    "kin_indic_to_latin": _indic_to_latin,
    "kin_latin_text": text._latin_udf,
    "kin_ratio": fuzzy.ratio_column,
    "kin_partial_ratio": fuzzy.partial_ratio_column,
    "kin_token_sort_ratio": fuzzy.token_sort_ratio_column,
    "kin_weighted_ratio": fuzzy.weighted_ratio_column,
    "kin_jaro_winkler": fuzzy.jaro_winkler_column,
    "kin_metaphone": phonetic._metaphone_udf,
    "kin_nysiis": phonetic._nysiis_udf,
}


def register(spark: SparkSession) -> list[str]:
    """Make every function known to the session's SQL; returns their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return list(FUNCTIONS)
