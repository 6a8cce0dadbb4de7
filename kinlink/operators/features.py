"""Pairwise similarity features of anchor (a) and gallery (b) records.

Per-record parts (words, trigrams, digit runs, phonetic codes) are made once for each record, before pairing, so a pair only
costs comparisons. Inputs are clean text: name, addr, country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions import fuzzy, phonetic, text
from kinlink.functions.wordlists import STREET_WORDS

SET_FEATURES = (
    "name_jaccard", "name_edit_ratio", "name_trigram_jaccard", "name_soundex_match", "name_length_ratio", "addr_jaccard",
    "addr_trigram_jaccard", "addr_length_ratio", "same_country", "name_addr_jaccard_avg", "is_company", "surname_length_diff",
    "combined_trigram", "name_a_present", "name_b_present", "addr_a_present", "addr_b_present", "both_names_present",
    "both_addrs_present", "country_conflict", "addr_number_conflict", "city_conflict", "contradiction_count",
)
FUZZY_FEATURES = (
    "name_token_sort_ratio", "name_partial_ratio", "name_WRatio", "name_jaro_winkler", "name_metaphone_match",
    "addr_token_sort_ratio", "addr_partial_ratio", "addr_WRatio", "name_addr_WRatio_avg", "name_addr_WRatio_max",
    "name_addr_WRatio_min", "name_phonetic_vote",
)
#: Ratios that one Arrow pass over both sides makes.
RATIOS = {"token_sort_ratio": "token_sort", "partial_ratio": "partial", "WRatio": "weighted"}
#: The fixed order of the 35 features.
FEATURE_NAMES = (
    "name_token_sort_ratio", "name_partial_ratio", "name_WRatio", "name_jaro_winkler", "name_jaccard", "name_edit_ratio",
    "name_trigram_jaccard", "name_soundex_match", "name_metaphone_match", "name_length_ratio", "addr_token_sort_ratio",
    "addr_partial_ratio", "addr_WRatio", "addr_jaccard", "addr_trigram_jaccard", "addr_length_ratio", "same_country",
    "name_addr_WRatio_avg", "name_addr_WRatio_max", "name_addr_WRatio_min", "name_addr_jaccard_avg", "is_company",
    "name_phonetic_vote", "surname_length_diff", "combined_trigram", "name_a_present", "name_b_present", "addr_a_present",
    "addr_b_present", "both_names_present", "both_addrs_present", "country_conflict", "addr_number_conflict", "city_conflict",
    "contradiction_count",
)


def record_parts(records: DataFrame, fuzzy_parts: bool = True) -> DataFrame:
    """entity_id and a struct of everything that comparisons need of one record.

    records: entity_id, business_name_clean, business_address_clean, country_clean.
    """
    name, addr, country = (F.coalesce(c, F.lit("")) for c in ("business_name_clean", "business_address_clean", "country_clean"))
    base = records.select("entity_id", name.alias("name"), addr.alias("addr"), country.alias("country"))
    n, a = F.col("name"), F.col("addr")
    parts = {
        "name_words": text.tokens(n),
        "addr_words": text.tokens(a),
        "name_grams": text.trigrams(n),
        "addr_grams": text.trigrams(a),
        "both_grams": text.trigrams(F.concat(n, F.lit(" "), a)),
        "digits": text.digit_runs(a),
        "soundex": phonetic.soundex(n),
        "company": text.is_company_name(n),
    }
    if fuzzy_parts:
        parts |= {"metaphone": phonetic.metaphone(n), "nysiis": phonetic.nysiis(n)}
    return base.withColumns(parts)


def pair_up(pairs: DataFrame, anchors: DataFrame, gallery: DataFrame, unknown: str = "drop") -> DataFrame:
    """pairs (s1_id, cand_id, ...) with structs a and b of record_parts.

    unknown: "drop" leaves pairs with unknown ids out, "empty" takes empty texts for what is not known.
    """
    if unknown not in ("drop", "empty"):
        raise ValueError("unknown is drop or empty")
    as_struct = lambda df, key, name: df.select(F.col("entity_id").alias(key), F.struct(*df.columns).alias(name))
    how = "inner" if unknown == "drop" else "left"
    joined = pairs.join(as_struct(anchors, "s1_id", "a"), "s1_id", how).join(as_struct(gallery, "cand_id", "b"), "cand_id", how)
    if unknown == "drop":
        return joined
    blank = pairs.sparkSession.createDataFrame([("", "", "", "")], "entity_id string, business_name_clean string, business_address_clean string, country_clean string")
    empty = record_parts(blank, "metaphone" in anchors.columns).first()
    filler = lambda df: F.struct(*[F.lit(empty[c]).cast(t).alias(c) for c, t in df.dtypes])
    return joined.withColumns({"a": F.coalesce("a", filler(anchors)), "b": F.coalesce("b", filler(gallery))})


def jaccard(x: Column, y: Column) -> Column:
    """Shared members over all members; two empty sets give 0."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def edit_ratio(x: Column, y: Column) -> Column:
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def length_ratio(x: Column, y: Column) -> Column:
    m, n = F.greatest(F.length(x), F.lit(1)), F.greatest(F.length(y), F.lit(1))
    return F.least(m, n) / F.greatest(m, n)


def present(c: Column) -> Column:
    return (F.trim(c) != "").cast("double")


def _last(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def set_features() -> dict[str, Column]:
    """The features that are plain Spark expressions over structs a and b."""
    a, b = F.col("a"), F.col("b")
    double = lambda c: c.cast("double")
    f = {
        "name_jaccard": jaccard(a["name_words"], b["name_words"]),
        "name_edit_ratio": edit_ratio(a["name"], b["name"]),
        "name_trigram_jaccard": jaccard(a["name_grams"], b["name_grams"]),
        "name_soundex_match": double(phonetic.agree(a["soundex"], b["soundex"])),
        "name_length_ratio": length_ratio(a["name"], b["name"]),
        "addr_jaccard": jaccard(a["addr_words"], b["addr_words"]),
        "addr_trigram_jaccard": jaccard(a["addr_grams"], b["addr_grams"]),
        "addr_length_ratio": length_ratio(a["addr"], b["addr"]),
        "same_country": double(a["country"] == b["country"]),
        "is_company": double(F.greatest(a["company"], b["company"])),
        "combined_trigram": jaccard(a["both_grams"], b["both_grams"]),
        "name_a_present": present(a["name"]),
        "name_b_present": present(b["name"]),
        "addr_a_present": present(a["addr"]),
        "addr_b_present": present(b["addr"]),
    }
    f["name_addr_jaccard_avg"] = (f["name_jaccard"] + f["addr_jaccard"]) / 2
    m, n = F.length(_last(a["name_words"])), F.length(_last(b["name_words"]))
    f["surname_length_diff"] = F.abs(m - n) / F.greatest(m, n, F.lit(1))
    f["both_names_present"] = f["name_a_present"] * f["name_b_present"]
    f["both_addrs_present"] = f["addr_a_present"] * f["addr_b_present"]
    x, y = F.lower(F.trim(a["country"])), F.lower(F.trim(b["country"]))
    f["country_conflict"] = double((x != "") & (y != "") & (x != y))
    numbers = (F.size(a["digits"]) > 0) & (F.size(b["digits"]) > 0)
    f["addr_number_conflict"] = double(numbers & (F.size(F.array_intersect(a["digits"], b["digits"])) == 0))
    u, v = _last(a["addr_words"]), _last(b["addr_words"])
    towns = (F.size(a["addr_words"]) >= 2) & (F.size(b["addr_words"]) >= 2)
    f["city_conflict"] = double(towns & (u != v) & ~u.contains(v) & ~v.contains(u))
    f["contradiction_count"] = f["country_conflict"] + f["addr_number_conflict"] + f["city_conflict"]
    return {name: f[name] for name in SET_FEATURES}


def fuzzy_features() -> dict[str, Column]:
    """The features that need Arrow functions, over structs a and b, and name_ratios and addr_ratios as of fuzzy.ratios_column."""
    a, b = F.col("a"), F.col("b")
    ratios = {f"{side}_{name}": F.col(f"{side}_ratios")[part] for side in ("name", "addr") for name, part in RATIOS.items()}
    return ratios | {
        "name_jaro_winkler": fuzzy.jaro_winkler_column(a["name"], b["name"]),
        "name_metaphone_match": phonetic.agree(a["metaphone"], b["metaphone"]).cast("double"),
        "name_phonetic_vote": phonetic.vote([(a[k], b[k]) for k in ("soundex", "metaphone", "nysiis")]),
    }


def compute_features(pairs: DataFrame, anchors: DataFrame, gallery: DataFrame, keep: tuple[str, ...] = (), unknown: str = "drop") -> DataFrame:
    """s1_id, cand_id, the kept columns and all 35 features as doubles, in their fixed order. unknown: see pair_up."""
    paired = pair_up(pairs, record_parts(anchors), record_parts(gallery), unknown)
    ratios = [fuzzy.ratios_column(f"a.{part}", f"b.{part}").alias(f"{part}_ratios") for part in ("name", "addr")]
    made = paired.select("s1_id", "cand_id", *keep, "a", "b", *ratios)
    made = made.select("s1_id", "cand_id", *keep, "a", "b", *[c.alias(n) for n, c in fuzzy_features().items()])
    w = F.col("name_WRatio"), F.col("addr_WRatio")
    cross = {
        "name_addr_WRatio_avg": (w[0] + w[1]) / 2,
        "name_addr_WRatio_max": F.greatest(*w),
        "name_addr_WRatio_min": F.least(*w),
    }
    made = made.withColumns(cross | set_features())
    return made.select("s1_id", "cand_id", *keep, *FEATURE_NAMES)


def blocker_evidence(legs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per pair and blocking leg: in_<leg> (0 or 1), rank_<leg> (from 0; 99 where it did not retrieve) and cos.

    legs: s1_id, cand_id, leg, cos (null for exact legs).
    """
    w = Window.partitionBy("s1_id", "leg").orderBy(F.desc_nulls_last("cos"), "cand_id")
    ranked = legs.withColumn("r", F.row_number().over(w) - 1)
    aggs = [F.coalesce(F.max("cos"), F.lit(0.0)).alias("cos")]
    for leg in names:
        here = F.when(F.col("leg") == leg, 1)
        aggs += [F.coalesce(F.max(here), F.lit(0)).alias(f"in_{leg}"), F.coalesce(F.min(here * F.col("r")), F.lit(99)).alias(f"rank_{leg}")]
    return ranked.groupBy("s1_id", "cand_id").agg(*aggs)


def competition(candidates: DataFrame) -> DataFrame:
    """Numbers of candidates of each side, and ranks by cosine from 1. candidates: s1_id, cand_id, cos."""
    by_a, by_b = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    order = [F.desc("cos")]
    return candidates.withColumns(
        {
            "n_cand_s1": F.count("*").over(by_a),
            "n_cand_r": F.count("*").over(by_b),
            "cos_rank_in_s1": F.rank().over(by_a.orderBy(*order)),
            "cos_rank_in_r": F.rank().over(by_b.orderBy(*order)),
        }
    )


def structure(a: Column, b: Column) -> dict[str, Column]:
    """num_jacc, house_eq and r_addr_empty of two record structs; -1 where a side has nothing to compare."""
    both = (F.size(a["digits"]) > 0) & (F.size(b["digits"]) > 0)
    first = lambda s: F.try_element_at(s["digits"], F.lit(1))
    return {
        "num_jacc": F.when(both, jaccard(a["digits"], b["digits"])).otherwise(F.lit(-1.0)),
        "house_eq": F.when(both, (first(a) == first(b)).cast("double")).otherwise(F.lit(-1.0)),
        "r_addr_empty": (F.trim(b["addr"]) == "").cast("double"),
    }


def word_weights(records: DataFrame, column: str = "name_words") -> DataFrame:
    """(word, idf) over records: ln((1 + n) / (1 + df)) + 1. The count of records is a scalar, joined by value."""
    n = records.count()
    df = records.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.select("word", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame, column: str, rare_idf: float) -> DataFrame:
    """(s1_id, cand_id, wjacc, rare_miss_s1, rare_miss_r): IDF-weighted Jaccard, and rare words that one side lacks."""

    def side(df: DataFrame, key: str, flag: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), F.explode(F.array_distinct(column)).alias("word")).withColumn(flag, F.lit(1))

    a = pairs.select("s1_id", "cand_id").join(side(left, "s1_id", "x"), "s1_id")
    b = pairs.select("s1_id", "cand_id").join(side(right, "cand_id", "y"), "cand_id")
    words = a.withColumn("y", F.lit(0)).unionByName(b.withColumn("x", F.lit(0))).groupBy("s1_id", "cand_id", "word").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    words = words.join(weights, "word")
    idf, x, y = F.col("idf"), F.col("x"), F.col("y")
    rare = (idf >= rare_idf).cast("int")
    return words.groupBy("s1_id", "cand_id").agg(
        (F.sum(idf * x * y) / F.sum(idf)).alias("wjacc"),
        F.sum(rare * x * (1 - y)).alias("rare_miss_s1"),
        F.sum(rare * y * (1 - x)).alias("rare_miss_r"),
    )


def text_frequency(records: DataFrame, column: str, out: str) -> DataFrame:
    """records with the number of records of the same country and text."""
    return records.withColumn(out, F.count("*").over(Window.partitionBy("country", column)))


def _conflict(x: Column, y: Column) -> Column:
    """1 where both sides have members and share none."""
    return ((F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)).cast("double")


def street_words(addr: Column) -> Column:
    """The words of a clean address between its first number and the first short street word behind it; none without either."""
    ends = "|".join(sorted({short for _, short in STREET_WORDS}))
    return F.filter(F.split(F.regexp_extract(addr, rf"\d+\S*\s+(.*?)\s+(?:{ends})\b", 1), " "), lambda x: x != "")


def address_conflicts(a: Column, b: Column) -> dict[str, Column]:
    """Conflicts of postal keys, house numbers and streets, where both sides tell; and how many, with that of the towns."""
    first = lambda s: F.slice(F.regexp_extract_all(s["addr"], F.lit(r"\d+"), 0), 1, 1)
    f = {
        "postal_conflict": _conflict(text.pin_keys(a["addr"]), text.pin_keys(b["addr"])),
        "house_conflict": _conflict(first(a), first(b)),
        "street_conflict": _conflict(street_words(a["addr"]), street_words(b["addr"])),
    }
    return f | {"confident_contradictions": f["postal_conflict"] + f["house_conflict"] + f["street_conflict"] + set_features()["city_conflict"]}


def word_evidence(pairs: DataFrame, left: DataFrame, right: DataFrame, records: DataFrame, column: str = "name_words", rare_df: int = 20, generic_share: float = 0.01) -> DataFrame:
    """(s1_id, cand_id, rare_token_overlap, distinctive_token_count, generic_token_ratio, idf_match) of pairs with words.

    Words in at most rare_df of records are rare; in more than generic_share of them generic; the others of either side are distinctive. idf_match
    adds up the weights of the shared words.
    """
    n = records.count()
    df = records.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))

    def side(table: DataFrame, key: str, flag: str) -> DataFrame:
        return table.select(F.col("entity_id").alias(key), F.explode(F.array_distinct(column)).alias("word")).withColumn(flag, F.lit(1))

    a = pairs.select("s1_id", "cand_id").join(side(left, "s1_id", "x"), "s1_id").withColumn("y", F.lit(0))
    b = pairs.select("s1_id", "cand_id").join(side(right, "cand_id", "y"), "cand_id").withColumn("x", F.lit(0))
    words = a.unionByName(b).groupBy("s1_id", "cand_id", "word").agg(F.max("x").alias("x"), F.max("y").alias("y")).join(df, "word", "left").na.fill(0, ["df"])
    both, generic = F.col("x") * F.col("y"), F.col("df") > generic_share * n
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    return words.groupBy("s1_id", "cand_id").agg(
        F.sum(both * (F.col("df") <= rare_df).cast("int")).alias("rare_token_overlap"),
        F.sum((~generic).cast("int")).alias("distinctive_token_count"),
        F.avg(generic.cast("double")).alias("generic_token_ratio"),
        F.sum(both * idf).alias("idf_match"),
    )


def region_overlap(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """pairs with region_overlap: 1 where the sides share a region, 0 where not, -1 where a side has none. regions: entity_id, region."""
    lists = regions.groupBy("entity_id").agg(F.collect_set("region").alias("r"))
    x, y = (lists.select(F.col("entity_id").alias(k), F.col("r").alias(f"_{k}")) for k in ("s1_id", "cand_id"))
    joined = pairs.join(x, "s1_id", "left").join(y, "cand_id", "left")
    return joined.withColumn("region_overlap", F.coalesce(F.arrays_overlap("_s1_id", "_cand_id").cast("double"), F.lit(-1.0))).drop("_s1_id", "_cand_id")


def script_flag(records: DataFrame, name: str = "business_name") -> DataFrame:
    """(entity_id, r_nonlatin): 1 for raw names with letters that are not Latin."""
    return records.select("entity_id", text.is_non_latin(F.col(name)).alias("r_nonlatin"))
