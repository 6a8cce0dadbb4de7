"""Where errors come from: a run with few and one with many candidates for each anchor, over anchors held out.

Candidates are the most similar names; a single model is fitted on four fifths of the anchors and scores the rest; match sets are
chosen by expected F0.5. Retrieval bounds the first run, the decision the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import decision, features, models, scan, training
from kinlink.plans.pipeline import report
from kinlink.sources import tsv
from kinlink.sources.store import keep


def error_demo(anchors: DataFrame, gallery: DataFrame, truth: DataFrame, top_k: int = 15, seed: int = 42, threshold: float = 0.5, out_dir: str | None = None) -> dict:
    """The report on the held-out anchors; with out_dir also the artefacts: predictions, candidates, pair scores and truth.

    anchors, gallery: normalised records. truth: long.
    """
    mine = training.split_by_anchor(truth, seed)
    fit, held = mine.where("is_train").drop("is_train"), keep(mine.where("not is_train").drop("is_train"))
    of = lambda t: anchors.join(t.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    candidates = keep(scan.brute_top_k(of(mine), gallery, top_k).select("s1_id", "cand_id"))
    real = training.positives(fit)
    pairs = real.unionByName(training.negatives_from_candidates(candidates.join(fit.select("s1_id").distinct(), "s1_id", "left_semi"), fit))
    model = models.fit_single(keep(features.compute_features(pairs, anchors, gallery, keep=("label",))), seed)
    asked = candidates.join(held.select("s1_id").distinct(), "s1_id", "left_semi")
    made = models.assemble(features.compute_features(asked, anchors, gallery))
    scored = keep(models.probability(made, model, "p").select("s1_id", "cand_id", "p"))
    chosen = decision.select_expected_f(scored)
    countries = anchors.select(F.col("entity_id").alias("s1_id"), F.col("country_clean").alias("country"))
    sizes = gallery.groupBy(F.col("country_clean").alias("country")).agg(F.count("*").alias("n"))
    if out_dir:
        roster = held.select("s1_id").distinct().withColumn("pos", F.col("s1_id"))
        tsv.write_tsv(tsv.match_lists(chosen, roster), f"{out_dir}/predictions")
        tsv.write_tsv(tsv.match_lists(asked, roster, "candidate_entity_ids"), f"{out_dir}/candidates")
        tsv.write_tsv(tsv.pair_score_rows(scored), f"{out_dir}/pair_scores")
        tsv.write_tsv(tsv.match_lists(held.where("cand_id is not null"), roster), f"{out_dir}/held_out_truth")
    return report(held, chosen, asked, scored.withColumnRenamed("p", "score"), threshold, countries, sizes)
