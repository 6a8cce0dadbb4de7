"""The best partners of each text by a sum over shared terms, exactly, without pairing texts that share common terms only.

A few terms are in so many texts that a join on them pairs nearly everything. What they add to a score depends on nothing but a
text's combination of them, and of those there are few: combinations are compared with each other, and of each one the first
records are enough. Texts that share any other term are joined on it and scored in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.sources.store import keep

#: Numbers of common terms that are weighed up against each other.
CUTS = (0, 4, 16, 64, 256)
#: Scores are compared to nine places; what is nearer than this may be equal.
NEAR = 4e-9


def _common(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term): those whose combinations are compared, so that pairs of combinations and pairs of texts joined on the others are fewest."""
    sizes = [side.groupBy("term").agg(F.count("*").alias(n)) for side, n in ((left, "nl"), (right, "nr"))]
    costs = sizes[0].join(sizes[1], "term").select("term", (F.col("nl").cast("double") * F.col("nr")).alias("cost"))
    top = costs.orderBy(F.desc("cost"), "term").limit(max(CUTS)).collect()
    whole = costs.agg(F.sum("cost")).first()[0] or 0.0
    spark = left.sparkSession
    ranked = spark.createDataFrame([(r.term, k) for k, r in enumerate(top)], "term string, place int")
    kinds = []
    for side in (left, right):
        prints = side.join(F.broadcast(ranked), "term").groupBy("t").agg(*[F.sum(F.when(F.col("place") < c, F.shiftright(F.xxhash64("term", "w"), 8))).alias(str(c)) for c in CUTS])
        kinds.append(prints.agg(*[F.count_distinct(str(c)).alias(str(c)) for c in CUTS]).first())
    cost = lambda c: whole - sum(r.cost for r in top[:c]) + (kinds[0][str(c)] or 0) * (kinds[1][str(c)] or 0)
    cut = min(CUTS, key=cost)
    return ranked.where(F.col("place") < cut).select("term")


def _combined(side: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, norm, sig) of texts with a common term, and (sig, term, w) of each combination; sig is its least text."""
    mine = side.join(F.broadcast(common), "term", "left_semi")
    packed = mine.groupBy("t", "norm").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("s"))
    named = packed.groupBy("s").agg(F.min("t").alias("sig"))
    of_text = keep(packed.join(named, "s").select("t", "norm", "sig"))
    return of_text, mine.join(of_text.where("t = sig").select("t"), "t", "left_semi").select(F.col("t").alias("sig"), "term", "w")


def best_pairs(left: DataFrame, right: DataFrame, records: DataFrame, most: int, threshold: float = 0.0) -> DataFrame:
    """(tl, id, score): for each left text the `most` right records of the highest score of at least the threshold, ties to the lower id.

    left, right: t, term, w, norm, a row for each term of a text; one t for all texts of equal terms and weights. records: t, id of the
    right side. The score is the sum of w * w over shared terms, divided by both norms; it is rounded to nine places.
    """
    common = keep(_common(left, right))
    (l_sig, l_terms), (r_sig, r_terms) = _combined(left, common), _combined(right, common)
    listed = keep(records.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy("id"))).where(F.col("_r") <= most).groupBy("t").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    dots = keep(_dots(l_terms, r_terms))
    ranked = _by_combinations(l_sig, r_sig, dots, listed, most, threshold)
    joined = _by_other_terms(left, right, common, l_sig, r_sig, dots, listed, most, threshold)
    whole = ranked.unionByName(joined).groupBy("tl", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("tl").orderBy(F.desc("score"), "id")
    return whole.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def _ahead(by: str, order: str, near: float) -> Column:
    """How many records (n) lie ahead by more than near, in rising order."""
    return F.coalesce(F.expr(f"sum(n) over (partition by {by} order by {order} range between unbounded preceding and {near:.17g}D preceding)"), F.lit(0))


def _dots(l_terms: DataFrame, r_terms: DataFrame) -> DataFrame:
    r = r_terms.select(F.col("sig").alias("sr"), "term", F.col("w").alias("wr"))
    return l_terms.withColumnRenamed("sig", "sl").join(r, "term").groupBy("sl", "sr").agg(F.sum(F.col("w") * F.col("wr")).alias("dot"))


def _by_combinations(l_sig: DataFrame, r_sig: DataFrame, dots: DataFrame, listed: DataFrame, most: int, threshold: float) -> DataFrame:
    """(tl, id, score) by common terms alone: at least the records that no `most` others of their combination, or of all, are ahead of.

    A record that shares other terms too has a higher score than here, and stands in the other table with it.
    """
    # Within a combination a smaller norm is better. Norms of equal terms differ by the order of their sums.
    alike = r_sig.join(listed, "t").select("sig", "norm", F.round("norm", 10).alias("about"), F.explode("ids").alias("id"))
    alike = alike.withColumn("_r", F.row_number().over(Window.partitionBy("sig", "about").orderBy("id"))).where(F.col("_r") <= most)
    classes = alike.groupBy(F.col("sig").alias("sr"), "about").agg(F.min("norm").alias("nr"), F.collect_list("id").alias("ids"), F.count("*").alias("n")).drop("about")
    classes = classes.withColumn("lg", F.log("nr")).withColumn("_a", _ahead("sr", "lg", NEAR / max(threshold, 1e-3))).where(F.col("_a") < most).drop("_a", "lg")
    widest = l_sig.groupBy(F.col("sig").alias("sl")).agg(F.max("norm").alias("widest"), F.min("norm").alias("least"))
    scored = dots.join(classes, "sr").join(widest, "sl").withColumn("s", F.col("dot") / F.col("nr"))
    scored = scored.where(F.col("s") / F.col("least") >= threshold - 1e-9).withColumn("down", -F.col("s") / F.col("widest"))
    first = scored.withColumn("_a", _ahead("sl", "down", NEAR)).where(F.col("_a") < most).select("sl", "s", F.explode("ids").alias("id"))
    rows = l_sig.select(F.col("t").alias("tl"), F.col("norm").alias("nl"), F.col("sig").alias("sl")).join(first, "sl")
    return rows.withColumn("score", F.col("s") / F.col("nl")).where(F.col("score") >= threshold).select("tl", "id", F.round("score", 9).alias("score"))


def _by_other_terms(left: DataFrame, right: DataFrame, common: DataFrame, l_sig: DataFrame, r_sig: DataFrame, dots: DataFrame, listed: DataFrame, most: int, threshold: float) -> DataFrame:
    """(tl, id, score) of texts that share a term that is not common, in full."""
    sides = []
    for side, sig, x in ((left, l_sig, "l"), (right, r_sig, "r")):
        rows = side.join(F.broadcast(common), "term", "left_anti").join(sig.select("t", "sig"), "t", "left")
        sides.append(rows.select("term", *[F.col(c).alias(f"{n}{x}") for c, n in (("t", "t"), ("w", "w"), ("norm", "n"), ("sig", "s"))]))
    shared = sides[0].join(sides[1], "term").groupBy("tl", "tr").agg(F.sum(F.col("wl") * F.col("wr")).alias("rare"), *[F.first(c).alias(c) for c in ("nl", "nr", "sl", "sr")])
    scored = shared.join(dots, ["sl", "sr"], "left")
    scored = scored.withColumn("score", (F.col("rare") + F.coalesce("dot", F.lit(0.0))) / (F.col("nl") * F.col("nr"))).where(F.col("score") >= threshold)
    scored = scored.select("tl", F.col("tr").alias("t"), F.round("score", 9).alias("score")).join(listed, "t").withColumns({"n": F.size("ids"), "down": -F.col("score")})
    first = scored.withColumn("_a", _ahead("tl", "down", 1e-10)).where(F.col("_a") < most)
    return first.select("tl", F.explode("ids").alias("id"), "score")
