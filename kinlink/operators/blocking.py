"""Candidate generation: a union of equi-joins on keys, TF-IDF joins and exact joins on trigram sets.

Candidates are rows (s1_id, cand_id); each leg adds its name, so provenance survives the union. Buckets of the gallery
beyond a cap are dropped before the join, as counts by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions import phonetic, text
from kinlink.sources.store import keep

ADDRESS_MIN, ADDRESS_CAP, KEY_CAP = 12, 200, 30
CLEAN_NAME, CLEAN_ADDRESS = "business_name_clean", "business_address_clean"


def capped(gallery_keys: DataFrame, most: int | None) -> DataFrame:
    """(key, cand_id) without keys of more than `most` rows; repeated ids count. None: all."""
    if most is None:
        return gallery_keys
    sizes = gallery_keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") <= most)
    return gallery_keys.join(sizes.select("key"), "key")


def key_join(anchors: DataFrame, gallery: DataFrame, key: Column, leg: str, most: int | None, many: bool = False, drop_empty: bool = True) -> DataFrame:
    """(s1_id, cand_id, leg): equality of a key of both sides. many: key is an array of keys."""
    made = F.explode(F.array_distinct(key)) if many else key
    sides = [df.select(F.col("entity_id").alias(i), made.alias("key")) for df, i in ((anchors, "s1_id"), (gallery, "cand_id"))]
    if drop_empty:
        sides = [s.where("key is not null and key <> ''") for s in sides]
    left, right = sides[0].distinct(), spread(capped(sides[1], most).distinct(), "key")
    return distinct_join(left, lambda a: spread(a, "key").join(right, "key")).select("s1_id", "cand_id", F.lit(leg).alias("leg"))


def spread(side: DataFrame, key: str) -> DataFrame:
    """A side of a join that gives far more rows than it reads: in all the shuffle's partitions, however small they are."""
    return side.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def distinct_join(left: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(s1_id, cand_id), each pair once, of a join of left, which has no equal rows, with rows that give no pair twice for one of its rows.

    Only anchors of several rows can find a pair again, so only their pairs are compared with each other; the others are not shuffled.
    """
    counted = left.withColumn("_n", F.count("*").over(Window.partitionBy("s1_id")))
    once, often = (join(counted.where(c).drop("_n")).select("s1_id", "cand_id") for c in ("_n = 1", "_n > 1"))
    return once.union(often.distinct())


def _name() -> Column:
    return F.coalesce(F.col(CLEAN_NAME), F.lit(""))


def _address() -> Column:
    return F.coalesce(F.col(CLEAN_ADDRESS), F.lit(""))


def exact_name(anchors: DataFrame, gallery: DataFrame) -> DataFrame:
    """Equal names, without a cap; empty names match each other."""
    return key_join(anchors, gallery, _name(), "exact", None, drop_empty=False)


def address_key(anchors: DataFrame, gallery: DataFrame, least: int = ADDRESS_MIN, most: int | None = ADDRESS_CAP) -> DataFrame:
    return key_join(anchors, gallery, F.when(F.length(_address()) >= least, _address()), "address", most)


def name_core(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    return key_join(anchors, gallery, text.name_core_key(_name(), _address()), "name_core", most)


def pin(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    return key_join(anchors, gallery, text.pin_keys(_address()), "pin", most, many=True)


def soundex_leg(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    return key_join(anchors, gallery, phonetic.soundex(_name()), "soundex", most)


def metaphone_leg(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    return key_join(anchors, gallery, phonetic.metaphone(_name()), "metaphone", most)


def phonetic_legs(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    both = soundex_leg(anchors, gallery, most).union(metaphone_leg(anchors, gallery, most))
    return both.select("s1_id", "cand_id", F.lit("phonetic").alias("leg")).distinct()


def initialism_leg(anchors: DataFrame, gallery: DataFrame, most: int | None = KEY_CAP) -> DataFrame:
    return key_join(anchors, gallery, text.initialism(_name()), "initialism", most)


def key_legs(anchors: DataFrame, gallery: DataFrame) -> DataFrame:
    """Address, core-name and PIN keys together."""
    return union_legs(address_key(anchors, gallery), name_core(anchors, gallery), pin(anchors, gallery))


def rare_words(anchors: DataFrame, gallery: DataFrame, most_df: int = 20) -> DataFrame:
    """Shared name words that at most `most_df` gallery records have."""
    return key_join(anchors, gallery, text.tokens(_name()), "rare_word", most_df, many=True)


def prefix_leg(anchors: DataFrame, gallery: DataFrame, length: int = 6, most: int | None = KEY_CAP) -> DataFrame:
    prefix = F.substring(F.replace(_name(), F.lit(" "), F.lit("")), 1, length)
    return key_join(anchors, gallery, F.when(F.length(prefix) == length, prefix), "prefix", most)


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, scoped: bool = False) -> DataFrame:
    """(ta, tb) of distinct texts (column t) whose trigram sets have a Jaccard similarity of at least the threshold; none is lost.

    scoped: t is a scope, U+0001 and the text, and only texts of one scope are compared.

    Trigrams are put in order, rarest first. A pair that reaches the threshold shares one of the first
    n - ceil(threshold * n) + 1 trigrams of both sides, and after the first it shares enough are left on both.
    """
    both = left.select("t").union(right.select("t")).distinct()
    bare = F.substring_index("t", "\u0001", -1)
    made = F.array_distinct(text.shingles(bare))
    if scoped:
        made = F.transform(made, lambda g: F.concat(F.substring_index("t", "\u0001", 1), F.lit("\u0001"), g))
    grams = both.select("t", F.explode(made).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    sets = grams.join(df, "g").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    sets = sets.select("t", F.transform("s", lambda x: x["g"]).alias("set"), F.size("s").alias("n"))
    # Rounding up must not shorten the prefix of a pair that just reaches the threshold.
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    first = sets.select("t", "n", F.posexplode(F.slice("set", F.lit(1), length.cast("int"))).alias("at", "g"))
    sides = []
    for side, x in ((left, "a"), (right, "b")):
        mine = first.join(side.select("t").distinct(), "t", "left_semi")
        sides.append(mine.select("g", F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")))
    least = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    found = sides[0].join(sides[1], "g").where(F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= least)
    pairs = found.select("ta", "tb").distinct()
    a, b = (sets.select(F.col("t").alias(f"t{x}"), F.col("set").alias(f"s{x}")) for x in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(a, "ta").join(b, "tb").where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold)
    return near.select("ta", "tb")


def minhash_leg(anchors: DataFrame, gallery: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Names whose sets of character trigrams have a Jaccard similarity of at least the threshold, all of them.

    Compared exactly, between distinct names, before they are expanded to records; the leg has the name of the estimate it replaced.
    """
    name = F.lower(_name())
    a = anchors.select(F.col("entity_id").alias("s1_id"), name.alias("ta")).where("ta <> ''")
    b = gallery.select(F.col("entity_id").alias("cand_id"), name.alias("tb")).where("tb <> ''")
    pairs = keep(similar_sets(a.select(F.col("ta").alias("t")), b.select(F.col("tb").alias("t")), threshold))
    # Equal ids under several names of the gallery: distinct by id and anchor's name, before anchors are expanded.
    b = b.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("cand_id")))
    found = lambda some: pairs.join(b.where(some), "tb").select("ta", "cand_id")
    near = spread(found("_n = 1").union(found("_n > 1").distinct()), "ta")
    return distinct_join(a.distinct(), lambda x: spread(x, "ta").join(near, "ta")).select("s1_id", "cand_id", F.lit("minhash").alias("leg"))


def union_legs(*legs: DataFrame) -> DataFrame:
    """All legs' rows; a pair may come from several."""
    return reduce(DataFrame.unionByName, [leg.select("s1_id", "cand_id", "leg") for leg in legs])


def distinct_pairs(legs: DataFrame) -> DataFrame:
    """(s1_id, cand_id, n_legs): each pair once, with the number of legs that found it."""
    return legs.groupBy("s1_id", "cand_id").agg(F.count_distinct("leg").alias("n_legs"))


def cap_candidates(candidates: DataFrame, most: int | None, score: str | None = None) -> DataFrame:
    """At most `most` candidates of each anchor: the best by score, then the lowest ids; without a score the lowest ids."""
    if most is None:
        return candidates
    order = ([F.desc(score)] if score else []) + [F.col("cand_id")]
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("s1_id").orderBy(*order)))
    return ranked.where(F.col("_r") <= most).drop("_r")


def adaptive_prune(scored: DataFrame, kmin: int, kmax: int, gap: float, by: str = "s1_id", other: str = "cand_id") -> DataFrame:
    """Of each query's ranking: the first kmin, and up to kmax those within `gap` of the best score. scored: by, other, cos."""
    w = Window.partitionBy(by)
    ranked = scored.withColumn("_r", F.row_number().over(w.orderBy(F.desc("cos"), other))).where(F.col("_r") <= kmax)
    ranked = ranked.withColumn("_top", F.max("cos").over(w))
    return ranked.where((F.col("_r") <= kmin) | (F.col("cos") >= F.col("_top") - gap)).drop("_r", "_top")


def blocking_quality(candidates: DataFrame, truth: DataFrame, n_gallery: int) -> DataFrame:
    """One row: candidate_pairs, reduction_ratio, matches_retained, total_matches, pair_recall.

    truth: s1_id, cand_id (null for an anchor without a match); its anchors are the denominator.
    """
    pairs = candidates.select("s1_id", "cand_id").distinct()
    found = truth.where("cand_id is not null").join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    kept = found.agg(F.count("*").alias("total_matches"), F.count("hit").alias("matches_retained"))
    roster = truth.agg(F.count_distinct("s1_id").alias("n_s1"))
    n = pairs.agg(F.count("*").alias("candidate_pairs"))
    whole = F.col("n_s1") * F.lit(n_gallery)
    one = n.withColumn("k", F.lit(1)).join(kept.withColumn("k", F.lit(1)), "k").join(roster.withColumn("k", F.lit(1)), "k")
    return one.select(
        "candidate_pairs",
        F.round(F.when(whole > 0, 1 - F.col("candidate_pairs") / whole).otherwise(0.0), 4).alias("reduction_ratio"),
        "matches_retained",
        "total_matches",
        F.round(F.when(F.col("total_matches") > 0, F.col("matches_retained") / F.col("total_matches")).otherwise(0.0), 4).alias("pair_recall"),
    )


def recall_curve(scored: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """(k, recall): the share of true pairs among each anchor's k best. scored: s1_id, cand_id, cos."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("cos"), "cand_id")
    ranked = scored.withColumn("r", F.row_number().over(w))
    real = truth.where("cand_id is not null").select("s1_id", "cand_id").distinct()
    ranks = real.join(ranked.select("s1_id", "cand_id", "r"), ["s1_id", "cand_id"], "left")
    wide = ranks.agg(*[F.avg((F.coalesce(F.col("r"), F.lit(1 << 30)) <= k).cast("int")).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.col(str(k)) for k in ks]))).alias("k", "recall"))


def candidate_quantiles(candidates: DataFrame, roster: DataFrame) -> DataFrame:
    """p50, p90, p95, p99 and max of the number of candidates of an anchor; roster: s1_id."""
    n = candidates.groupBy("s1_id").agg(F.count("*").alias("n"))
    counts = roster.join(n, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(*[F.percentile("n", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max("n").alias("max"))


def region_leg(anchors: DataFrame, gallery: DataFrame, share: float = 0.0005) -> DataFrame:
    """(s1_id or cand_id side, region): comma parts of raw addresses that at least `share` of a country's anchors have.

    Returns regions by entity for both sides, to restrict other legs with same_region.
    """
    parts = lambda df: df.select("entity_id", "country_clean", F.explode(F.array_distinct(F.transform(F.split(F.lower("business_address"), ","), lambda x: F.trim(x)))).alias("region")).where("region <> ''")
    a = parts(anchors)
    sizes = anchors.groupBy("country_clean").agg(F.count("*").alias("n"))
    common = a.groupBy("country_clean", "region").agg(F.count("*").alias("c")).join(sizes, "country_clean").where(F.col("c") >= share * F.col("n"))
    common = common.select("country_clean", "region")
    return a.unionByName(parts(gallery)).join(common, ["country_clean", "region"]).select("entity_id", "region")


def same_region(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates that share a region, or of which a side has none."""
    lists = regions.groupBy("entity_id").agg(F.collect_set("region").alias("r"))
    x, y = (lists.select(F.col("entity_id").alias(k), F.col("r").alias(f"r_{k}")) for k in ("s1_id", "cand_id"))
    joined = candidates.join(x, "s1_id", "left").join(y, "cand_id", "left")
    ok = F.col("r_s1_id").isNull() | F.col("r_cand_id").isNull() | F.arrays_overlap("r_s1_id", "r_cand_id")
    return joined.where(ok).drop("r_s1_id", "r_cand_id")


def mutual_best(scored: DataFrame) -> DataFrame:
    """Pairs that are each other's best by cos, ties to the lower id."""
    a = Window.partitionBy("s1_id").orderBy(F.desc("cos"), "cand_id")
    b = Window.partitionBy("cand_id").orderBy(F.desc("cos"), "s1_id")
    return scored.withColumns({"_a": F.row_number().over(a), "_b": F.row_number().over(b)}).where("_a = 1 and _b = 1").drop("_a", "_b")


def without_candidates(roster: DataFrame, candidates: DataFrame) -> DataFrame:
    """Anchors that no leg found anything for; a relaxed pass may follow."""
    return roster.join(candidates.select("s1_id").distinct(), "s1_id", "left_anti")
