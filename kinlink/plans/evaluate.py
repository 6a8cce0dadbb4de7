"""Evaluation and validation of result files as commands.

python -m kinlink.plans.evaluate --truth T --matches M [--candidates C] [--scores S --threshold X] [--s1 F --gallery F ...] [--json OUT]
prints the report; with --validate it checks the files instead and exits with 1 if there is an error (warnings never fail).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import features, metrics, validate
from kinlink.plans.pipeline import report
from kinlink.functions.text import apply_normalization
from kinlink.sources import tsv

MATCHES, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


def _pairs(spark: SparkSession, path: str, value: str) -> DataFrame:
    return tsv.read_id_lists(spark, path, value).select("s1_id", F.explode("ids").alias("cand_id"))


def _percent(x: float | None) -> str:
    return "-" if x is None else f"{x:.4f}"


def lines_of(found: dict) -> list[str]:
    """The report as text: the whole, then segments by kind and name, errors, intervals and the worst anchors."""
    rows = sorted(found["segments"], key=lambda r: (r["segment_kind"] != "all", r["segment_kind"], str(r["segment"])))
    shown = ("macro_f05", "micro_f05", "micro_precision", "micro_recall", "oracle_f05", "pair_recall", "reduction_ratio", "complete_match_coverage")
    out = ["segment                 anchors  " + "  ".join(f"{n[:16]:>16}" for n in shown)]
    out += [f"{r['segment_kind']}:{r['segment']}".ljust(22) + f"{r['n_entities']:>9}  " + "  ".join(f"{_percent(r.get(n)):>16}" for n in shown) for r in rows]
    out.append(f"selector loss {found['selector_loss']:.4f}")
    for name in ("macro_ci", "oracle_ci"):
        ci = found[name]
        out.append(f"{name}: {_percent(ci['point'])} [{_percent(ci['low'])}, {_percent(ci['high'])}] over {ci['n']}")
    out.append("errors: " + ", ".join(f"{k} {v}" for k, v in found["errors"].items()))
    for r in found["worst"]:
        out.append(f"  {r['s1_id']}: f05 {r['f05']:.4f}, {r['n_true']} true, {r['root_cause']}")
        out += [f"    {e['rank']}. {e['cand_id']} " + ", ".join(f"{n}={e[n]}" for n in metrics.EVIDENCE) for e in found.get("evidence", {}).get(r["s1_id"], [])]
    return out


def evaluate_files(spark: SparkSession, truth: str, matches: str, candidates: str, scores: str | None = None, threshold: float | None = None, s1: str | None = None, gallery: list[str] | None = None) -> dict:
    """The report on files; with the records of both sides also by country, and with evidence for the worst anchors' predictions."""
    real = tsv.truth_long(tsv.read_tsv(spark, truth, tsv.list_schema(MATCHES)))
    selected, cand = _pairs(spark, matches, MATCHES), _pairs(spark, candidates, CANDIDATES)
    scored = tsv.read_pair_scores(spark, scores) if scores else None
    if s1 and gallery:
        a, g = (apply_normalization(tsv.read_records(spark, path)) for path in (s1, gallery))
        countries = a.select(F.col("entity_id").alias("s1_id"), F.col("country_clean").alias("country"))
        sizes = g.groupBy(F.col("country_clean").alias("country")).agg(F.count("*").alias("n"))
    else:
        countries = real.select("s1_id", F.lit("?").alias("country")).distinct()
        sizes = cand.select("cand_id").distinct().agg(F.lit("?").alias("country"), F.count("*").alias("n"))
    found = report(real, selected, cand, scored, threshold, countries, sizes)
    if s1 and gallery and found["worst"]:
        worst = spark.createDataFrame([(r["s1_id"],) for r in found["worst"]], "s1_id string")
        mine = selected.join(F.broadcast(worst), "s1_id", "left_semi")
        known = mine.join(scored, ["s1_id", "cand_id"], "left") if scored is not None else mine.withColumn("score", F.lit(None).cast("double"))
        made = features.compute_features(mine, a.join(F.broadcast(worst), F.col("entity_id") == F.col("s1_id"), "left_semi"), g)
        evidence: dict[str, list] = {}
        for r in metrics.feature_evidence(worst, known, made).orderBy("s1_id", "rank").collect():
            evidence.setdefault(r.s1_id, []).append(r.asDict())
        found["evidence"] = evidence
    return found


def validate_files(spark: SparkSession, matches: str, candidates: str | None = None, s1: str | None = None, gallery: list[str] | None = None) -> DataFrame:
    """(rule, severity, n, examples) of everything wrong with the files; only rules that were broken."""
    broken = validate.check_file(spark, matches, ("source1_entity_id", MATCHES))
    if candidates:
        broken += validate.check_file(spark, candidates, ("source1_entity_id", CANDIDATES), optional=True)
    schema = "rule string, severity string, n long, examples string"
    found = spark.createDataFrame(broken, schema) if broken else spark.createDataFrame([], schema)
    if any(r[0] in ("file_absent", "file_empty", "comma_separated", "header") and r[1] == "E" for r in broken):
        return found
    required = tsv.read_ids(spark, s1).withColumnRenamed("id", "s1_id") if s1 else None
    known = tsv.read_records(spark, gallery).select(F.col("entity_id").alias("cand_id")) if gallery else None
    lists = tsv.read_tsv(spark, matches, tsv.list_schema(MATCHES)).select(F.col("source1_entity_id").alias("s1_id"), F.coalesce(MATCHES, F.lit("")).alias("ids"))
    found = found.unionByName(validate.check_lists(lists, required, known))
    if candidates and not any(r[0] == "file_absent" for r in broken):
        found = found.unionByName(validate.check_subset(_pairs(spark, matches, MATCHES), _pairs(spark, candidates, CANDIDATES)))
    return found.where("n > 0")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Evaluate or validate result files")
    parser.add_argument("--matches", required=True)
    for name in ("--truth", "--candidates", "--scores", "--s1", "--json"):
        parser.add_argument(name)
    parser.add_argument("--gallery", nargs="*")
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--validate", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.validate:
        found = validate_files(spark, args.matches, args.candidates, args.s1, args.gallery).orderBy("severity", "rule").collect()
        for r in found:
            print(f"{'ERROR' if r.severity == 'E' else 'WARNING'} {r.rule}: {r.n} {r.examples}")
        print("not valid" if any(r.severity == "E" for r in found) else "valid")
        return int(any(r.severity == "E" for r in found))
    if not args.truth or not args.candidates:
        parser.error("--truth and --candidates are needed to evaluate")
    found = evaluate_files(spark, args.truth, args.matches, args.candidates, args.scores, args.threshold, args.s1, args.gallery)
    print("\n".join(lines_of(found)))
    if args.json:
        tsv.write_report(found, args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
