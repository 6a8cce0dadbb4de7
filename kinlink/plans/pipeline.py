"""End-to-end runs: train on labelled anchors, score an unseen split, write results, and evaluate them."""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions.text import apply_normalization
from kinlink.operators import blocking, decision, features, metrics, models, tfidf, training
from kinlink.sources import tsv
from kinlink.sources.store import keep

NAME, ADDRESS = blocking.CLEAN_NAME, blocking.CLEAN_ADDRESS


def generate_candidates(anchors: DataFrame, gallery: DataFrame, most: int | None = 30, by_id: bool = False) -> DataFrame:
    """(s1_id, cand_id, n_legs, cos): seven legs united and capped for each anchor.

    by_id caps to the lowest ids instead of the best found ones.
    """
    name, address = F.coalesce(F.col(NAME), F.lit("")), F.coalesce(F.col(ADDRESS), F.lit(""))
    cosines = [
        ("tfidf", tfidf.tfidf_bidirectional(anchors, gallery, name)),
        ("tfidf_sorted", tfidf.tfidf_adaptive(anchors, gallery, _sorted(name), threshold=0.25)),
        ("tfidf_address", tfidf.tfidf_join(anchors, gallery, address, threshold=0.25, max_features=5000, top_k=most)),
    ]
    legs = [df.select("s1_id", "cand_id", F.lit(leg).alias("leg"), "cos") for leg, df in cosines]
    exact = (blocking.phonetic_legs, blocking.initialism_leg, blocking.key_legs, lambda a, g: blocking.minhash_leg(a, g, threshold=0.3))
    legs += [leg(anchors, gallery).withColumn("cos", F.lit(None).cast("double")) for leg in exact]
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    found = every.groupBy("s1_id", "cand_id").agg(F.count_distinct("leg").alias("n_legs"), F.max("cos").alias("cos"))
    rank = F.col("n_legs") + F.coalesce("cos", F.lit(0.0))
    return blocking.cap_candidates(found.withColumn("_s", rank), most, None if by_id else "_s").drop("_s")


def _sorted(name):
    from kinlink.functions.text import token_sort

    return token_sort(name)


class Linker:
    """A fitted stack with the steps around it."""

    def __init__(self, stack: models.Stack):
        self.stack = stack

    @classmethod
    def train(cls, anchors: DataFrame, gallery: DataFrame, truth: DataFrame, work_dir: str, trials: int = 3, seed: int = 42, space: dict | None = None) -> Linker:
        """anchors, gallery: normalised. truth: long. 80 in 100 anchors fit the stack, 10 calibrate it; 10 stay unseen."""
        pool = generate_candidates(anchors, gallery)
        pairs = training.training_pairs(anchors, gallery, truth, seed, pool).withColumn("part", training.hash_part(seed))
        made = features.compute_features(pairs, anchors, gallery, keep=("label", "part"))
        made.write.mode("overwrite").parquet(f"{work_dir}/features")
        rows = anchors.sparkSession.read.parquet(f"{work_dir}/features")
        stack = models.Stack.fit(rows.where("part < 80"), rows.where("part >= 80 and part < 90"), trials=trials, seed=seed, space=space or models.BASES)
        return cls(stack)

    def infer(self, anchors: DataFrame, gallery: DataFrame, work_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(candidates, scored pairs, selected pairs). Candidates are written once, since they are both output and scored."""
        generate_candidates(anchors, gallery).write.mode("overwrite").parquet(f"{work_dir}/candidates")
        candidates = anchors.sparkSession.read.parquet(f"{work_dir}/candidates")
        scored = self.stack.score(features.compute_features(candidates, anchors, gallery)).select("s1_id", "cand_id", "p")
        scored.write.mode("overwrite").parquet(f"{work_dir}/scores")
        scored = anchors.sparkSession.read.parquet(f"{work_dir}/scores")
        return candidates, scored, decision.select_expected_f(scored)


def report(truth: DataFrame, selected: DataFrame, candidates: DataFrame, scores: DataFrame | None, threshold: float | None, countries: DataFrame, sizes: DataFrame) -> dict:
    """The evaluation as a bounded dict: segments, errors, intervals and the worst anchors."""
    counts = metrics.anchor_counts(truth, selected, candidates).persist()
    errors = metrics.classify_errors(truth, selected, candidates, scores, threshold).persist()
    rows = metrics.segments(counts, countries, sizes).collect()
    out = {
        "segments": [r.asDict() for r in rows],
        "errors": metrics.error_totals(errors).first().asDict(),
        "worst": [r.asDict() for r in metrics.worst_entities(counts, errors).collect()],
        "macro_ci": metrics.bootstrap_ci(counts).first().asDict(),
        "oracle_ci": metrics.bootstrap_ci(counts, "oracle_f05").first().asDict(),
    }
    whole = next(r for r in out["segments"] if r["segment_kind"] == "all")
    out["selector_loss"] = whole["oracle_f05"] - whole["macro_f05"]
    counts.unpersist()
    errors.unpersist()
    return out


def oof_hard_negatives(pairs: DataFrame, spare: DataFrame, rounds: int = 3, k: int = 3, most: int | None = None, cut: float = 0.5, seed: int = 42, names: tuple[str, ...] = features.FEATURE_NAMES) -> tuple[DataFrame, list[dict]]:
    """Training rows with hard negatives added in rounds, and what each round did. Nothing outside the training part is looked at.

    pairs: s1_id, cand_id, label and features of the training part. spare: negatives of its anchors that are not in pairs. In each round spare
    negatives are scored by models that have not seen their anchor; those above `cut` (the `most` highest, None: all) join the training rows. It
    ends when none is found or average precision out of fold no longer rises.
    """
    fold = F.pmod(training.hash_key(seed, "s1_id"), F.lit(k))
    now, left, best, log = pairs, spare, -1.0, []
    for r in range(rounds):
        rows, rest = (keep(models.assemble(x, names).withColumn("fold", fold)) for x in (models.balanced(now), left))
        scored, found = [], []
        for f in range(k):
            train = rows.where(F.col("fold") != f)
            if train.select("label").distinct().count() < 2:
                continue
            model = models.fit_assembled(train, seed)
            scored.append(models.probability(rows.where(F.col("fold") == f), model, "p").select("label", "p"))
            found.append(models.probability(rest.where(F.col("fold") == f), model, "p").where(F.col("p") >= cut).select("s1_id", "cand_id", "p"))
        if not scored:
            break
        ap = models.average_precision(reduce(DataFrame.union, scored))
        hard = reduce(DataFrame.union, found)
        hard = keep(hard.orderBy(F.desc("p"), "s1_id", "cand_id").limit(most) if most is not None else hard)
        n = hard.count()
        log.append({"round": r + 1, "average_precision": ap, "added": n if ap > best else 0})
        if not n or ap <= best:
            break
        best = ap
        more = left.join(hard.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
        now = keep(now.unionByName(more.select(*now.columns)))
        left = keep(left.join(hard.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti"))
    return now, log


def _two(x: float | None) -> float | None:
    return None if x is None else round(x, 4)


def country_holdout(anchors: DataFrame, gallery: DataFrame, truth: DataFrame, first: str, second: str, pool: DataFrame | None = None, target: float = 0.95, seed: int = 42, full: bool = True, least: int = 5) -> dict:
    """Train on one country, evaluate on the other, both ways; and the cutoff for countries never seen.

    Each direction is judged against hard negatives, and with `full` also against every other record of the gallery (for small data). Its margin is
    how far the threshold that keeps precision in the new country lies above the own one. The cutoff is the threshold of a
    model of both countries plus the larger margin, 0.95 at most. Records of other countries never train, not even as negatives.
    """
    of = lambda *cs: truth.join(anchors.where(F.col("country_clean").isin(list(cs))).select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    others = sorted(r.c for r in gallery.select(F.col("country_clean").alias("c")).distinct().collect())

    def rows(t: DataFrame, mode: str, exclude: tuple[str, ...] = ()) -> DataFrame:
        made = training.build_pairs(anchors, gallery, t, mode, seed, exclude_countries=exclude, pool=pool)
        return keep(features.compute_features(made, anchors, gallery, keep=("label",)))

    def fitted(*home: str) -> tuple:
        """A model of some countries, and the part of their anchors that it has not seen."""
        mine = training.split_by_anchor(of(*home), seed)
        fit, check = (keep(mine.where(c).drop("is_train")) for c in ("is_train", "not is_train"))
        model = models.fit_single(rows(fit, "train", tuple(c for c in others if c not in home)), seed)
        return (lambda t, mode: keep(models.probability(models.assemble(rows(t, mode)), model, "p").select("s1_id", "cand_id", "label", "p"))), check

    out: dict = {"directions": {}}
    margins, unreachable = [], []
    for home, away in ((first, second), (second, first)):
        name, sizes = f"{home}->{away}", [of(c).select("s1_id").distinct().count() for c in (home, away)]
        if min(sizes) < least:
            out["directions"][name] = {"skipped": f"too few anchors ({sizes[0]} and {sizes[1]})"}
            continue
        score, check = fitted(home)
        near = score(check, "eval_hard")
        cut = metrics.precision_threshold(near, target).first().threshold
        cut = cut if cut is not None else 0.95
        found = {"threshold": cut, "in_country": metrics.pair_metrics(near, cut).first().asDict(), "in_country_macro": _two(metrics.macro_at(near, cut))}
        for regime in ("hard", "full") if full else ("hard",):
            far = score(of(away), f"eval_{regime}")
            kept = metrics.precision_threshold(far, target).first().threshold
            best = metrics.best_macro_threshold(far).first()
            found[f"transfer_{regime}"] = {
                **metrics.pair_metrics(far, cut).first().asDict(),
                "macro_f05": _two(metrics.macro_at(far, cut)),
                "threshold_preserving": kept,
                "threshold_best": best.threshold,
                "best_macro_f05": best.macro_f05,
            }
        hard = found["transfer_hard"]
        found["gaps"] = {"precision": _two(hard["precision"] - found["in_country"]["precision"]), "macro_f05": _two(hard["macro_f05"] - found["in_country_macro"])}
        found["margin"] = _two(hard["threshold_preserving"] - cut) if hard["threshold_preserving"] is not None else None
        if found["margin"] is None:
            unreachable.append(name)
        else:
            margins.append(found["margin"])
        out["directions"][name] = found
    if of(first, second).select("s1_id").distinct().count() < 2 * least:
        out["pooled"] = {"skipped": "too few anchors"}
    else:
        score, check = fitted(first, second)
        near = score(check, "eval_hard")
        best = metrics.best_macro_threshold(near).first()
        out["pooled"] = {"threshold": best.threshold, "macro_f05": best.macro_f05, **metrics.pair_metrics(near, best.threshold).first().asDict()}
    start = out["pooled"].get("threshold")
    uncapped = None if start is None or not margins else _two(start + max(margins))
    out |= {"uncapped_cutoff": uncapped, "unseen_country_cutoff": None if uncapped is None else min(uncapped, 0.95), "capped": uncapped is not None and uncapped > 0.95, "unreachable": unreachable}
    return out


def run(spark: SparkSession, data_dir: str, output_dir: str, fast: bool = False) -> None:
    """Train on dataset/train, infer on dataset/test, write matching_results and candidate_pairs and the model."""
    space, trials = (models.QUICK_BASES, 1) if fast else (models.BASES, 3)
    train, test = tsv.load_training_data(spark, data_dir), tsv.load_test_data(spark, data_dir)

    def normalised(name: str, df: DataFrame) -> DataFrame:
        """Each record is normalised once and written."""
        apply_normalization(df).write.mode("overwrite").parquet(f"{output_dir}/work/{name}")
        return spark.read.parquet(f"{output_dir}/work/{name}")

    normal = {k: normalised(f"train_{k}", v) for k, v in train.items() if k != "truth"}
    linker = Linker.train(normal["s1"], tsv.combine_sources(normal["s2"], normal["s3"]), tsv.truth_long(train["truth"]), f"{output_dir}/work", trials, space=space)
    unseen = {k: normalised(f"test_{k}", v) for k, v in test.items()}
    candidates, _, selected = linker.infer(unseen["s1"], tsv.combine_sources(unseen["s2"], unseen["s3"]), f"{output_dir}/work")
    roster = test["s1"].select(F.col("entity_id").alias("s1_id"), F.monotonically_increasing_id().alias("pos"))
    tsv.write_tsv(tsv.match_lists(selected, roster), f"{output_dir}/matching_results")
    tsv.write_tsv(tsv.match_lists(candidates, roster, "candidate_entity_ids"), f"{output_dir}/candidate_pairs")
    linker.stack.save(f"{output_dir}/model")


def main() -> None:
    parser = argparse.ArgumentParser(description="Link business records")
    parser.add_argument("--data-dir", default=os.environ.get("DATA_DIR", "."))
    parser.add_argument("--output-dir", default=os.environ.get("OUTPUT_DIR", "output"))
    parser.add_argument("--fast", action="store_true")
    args = parser.parse_args()
    run(SparkSession.builder.getOrCreate(), args.data_dir, args.output_dir, args.fast)


if __name__ == "__main__":
    main()
