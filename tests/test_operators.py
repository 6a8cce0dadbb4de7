import pytest
from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.functions.text import apply_normalization
from kinlink.operators import blocking, decision, features, metrics, tfidf, training, validate
from kinlink.sources import tsv

CLEAN = "entity_id string, business_name_clean string, business_address_clean string, country_clean string"
PAIRS = "s1_id string, cand_id string, p double"


def records(spark, rows):
    return spark.createDataFrame([(i, n, a, c) for i, n, a, c in rows], CLEAN)


def pairs(df):
    return sorted((r.s1_id, r.cand_id) for r in df.collect())


def test_bucket_caps(spark):
    a = records(spark, [("S1-1", "acme", "", "")])
    g = records(spark, [(f"S2-{k}", "acme", "", "") for k in range(40)])
    assert blocking.soundex_leg(a, g, 30).count() == 0 and blocking.soundex_leg(a, g, 40).count() == 40
    assert blocking.exact_name(a, g).count() == 40


def test_acronyms_and_full_names(spark):
    a = records(spark, [("S1-1", "ibm", "", ""), ("S1-2", "international business machines", "", "")])
    g = records(spark, [("S2-1", "international business machines", "", ""), ("S2-2", "ibm", "", "")])
    assert pairs(blocking.initialism_leg(a, g)) == [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1"), ("S1-2", "S2-2")]


def test_key_legs(spark):
    a = records(spark, [("S1-1", "acme robotics", "500 market st san jose 95113", "us"), ("S1-2", "", "", "")])
    g = records(spark, [("S2-1", "other", "500 market st san jose 95113", "us"), ("S2-2", "acme robotics", "9 x jose 95113", "us"), ("S2-3", "", "", "")])
    found = {(r.cand_id, r.leg) for r in blocking.key_legs(a, g).collect()}
    assert found == {("S2-1", "address"), ("S2-1", "pin"), ("S2-2", "pin"), ("S2-2", "name_core")}


def test_minhash_leg_finds_close_names(spark):
    a = records(spark, [("S1-1", "acme robotics systems", "", "")])
    g = records(spark, [("S2-1", "acme robotics system", "", ""), ("S2-2", "bright cafe", "", "")])
    assert pairs(blocking.minhash_leg(a, g)) == [("S1-1", "S2-1")]


def test_trigram_join_loses_no_pair(spark):
    import random

    rng = random.Random(4)
    words = "antique blush coral dodger frosted gainsboro honeydew indian lawn metallic navajo olive peach sienna tomato".split()
    names = sorted({" ".join(rng.sample(words, 4)) for _ in range(120)})
    a = records(spark, [(f"S1-{k}", n, "", "") for k, n in enumerate(names[:60])])
    g = records(spark, [(f"S2-{k}", n, "", "") for k, n in enumerate(names[60:])])
    sets = {r.t: set(r.s) for r in spark.createDataFrame([(n,) for n in names], "t string").select("t", text.shingles(F.col("t")).alias("s")).collect()}
    for threshold in (0.3, 0.4, 0.5):
        want = sorted((f"S1-{i}", f"S2-{j}") for i, x in enumerate(names[:60]) for j, y in enumerate(names[60:]) if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= threshold)
        assert want and pairs(blocking.minhash_leg(a, g, threshold)) == want


def test_adaptive_prune_and_cap(spark):
    rows = [("q", f"c{k}", s) for k, s in enumerate((0.9, 0.85, 0.5, 0.4))]
    scored = spark.createDataFrame(rows, "s1_id string, cand_id string, cos double")
    assert [c for _, c in pairs(blocking.adaptive_prune(scored, 1, 3, 0.1))] == ["c0", "c1"]
    assert [c for _, c in pairs(blocking.adaptive_prune(scored, 3, 3, 0.1))] == ["c0", "c1", "c2"]
    assert [c for _, c in pairs(blocking.adaptive_prune(scored, 1, 1, 0.9))] == ["c0"]
    assert [c for _, c in pairs(blocking.cap_candidates(scored.withColumn("cos", -F.col("cos")), 2, "cos"))] == ["c2", "c3"]
    assert [c for _, c in pairs(blocking.cap_candidates(scored, 2))] == ["c0", "c1"] and blocking.cap_candidates(scored, None) is scored


def test_blocking_quality(spark):
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", None)], "s1_id string, cand_id string")
    cands = spark.createDataFrame([("a", "x"), ("a", "w")], "s1_id string, cand_id string")
    r = blocking.blocking_quality(cands, truth, 6).first()
    assert (r.candidate_pairs, r.matches_retained, r.total_matches, r.pair_recall) == (2, 1, 3, 0.3333)
    assert r.reduction_ratio == round(1 - 2 / 18, 4)


def test_tfidf_is_the_same_for_any_partitions(spark):
    a = records(spark, [(f"S1-{k}", f"alpha beta w{k % 5}", "", "") for k in range(20)])
    g = records(spark, [(f"S2-{k}", f"beta alpha w{k % 7}", "", "") for k in range(20)])
    got = [sorted((r.s1_id, r.cand_id, round(r.cos, 9)) for r in tfidf.tfidf_join(a.repartition(n), g.repartition(n), F.col("business_name_clean"), 0.3, top_k=3).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 60
    both = tfidf.tfidf_bidirectional(a, g, F.col("business_name_clean"))
    assert both.count() == both.select("s1_id", "cand_id").distinct().count() > 0


def test_feature_semantics(spark):
    a = records(spark, [("S1-1", "acme robotics", "500 market st san jose", "us"), ("S1-2", "", "", "")])
    g = records(spark, [("S2-1", "acme robotics", "500 market st san jose", "us"), ("S2-2", "bright cafe", "12 oak ave new dover", "india"), ("S2-3", "", "", "")])
    want = spark.createDataFrame([("S1-1", c) for c in ("S2-1", "S2-2", "S2-3")] + [("S1-2", "S2-3"), ("S1-9", "S2-1")], "s1_id string, cand_id string")
    rows = {(r.s1_id, r.cand_id): r for r in features.compute_features(want, a, g).collect()}
    assert set(rows) == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3"), ("S1-2", "S2-3")}
    same, other, blank, empty = (rows[k] for k in (("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3"), ("S1-2", "S2-3")))
    assert same.name_WRatio == same.name_jaccard == same.name_edit_ratio == 1.0 and same.contradiction_count == 0
    assert other.contradiction_count == 3 and other.name_WRatio < 0.6 and other.name_jaccard <= 0.1
    assert blank.contradiction_count == 0 and blank.addr_b_present == 0
    assert empty.name_trigram_jaccard == empty.name_edit_ratio == empty.same_country == 1.0 and empty.name_jaccard == 0.0
    assert all(v is not None and v == v for r in rows.values() for v in tuple(r)[2:])
    assert list(same.asDict())[2:] == list(features.FEATURE_NAMES) and len(features.FEATURE_NAMES) == 35


def test_planned_features(spark):
    legs = spark.createDataFrame([("a", "x", "t", 0.9), ("a", "y", "t", 0.8), ("a", "y", "n", None)], "s1_id string, cand_id string, leg string, cos double")
    rows = {r.cand_id: r for r in features.blocker_evidence(legs, ("t", "n")).collect()}
    assert (rows["x"].in_t, rows["x"].rank_t, rows["x"].in_n, rows["x"].rank_n) == (1, 0, 0, 99)
    assert (rows["y"].rank_t, rows["y"].rank_n, rows["y"].cos) == (1, 0, 0.8)
    a = features.record_parts(records(spark, [("1", "n", "12 x", ""), ("2", "n", "x", "")]), False)
    both = a.select(F.struct(*a.columns).alias("a"), F.struct(*a.columns).alias("b"))
    got = [tuple(r) for r in both.select(*features.structure(F.col("a"), F.col("b")).values()).collect()]
    assert got == [(1.0, 1.0, 0.0), (-1.0, -1.0, 0.0)]


def test_exclusivity_and_expected_f(spark):
    rows = [("a", "x", 0.9), ("b", "x", 0.9), ("b", "y", 0.02), ("a", "z", 0.3)]
    assert pairs(decision.exclusivity(spark.createDataFrame(rows, PAIRS))) == [("a", "x"), ("a", "z")]
    chosen = lambda ps, **k: [c for _, c in pairs(decision.select_expected_f(spark.createDataFrame([("a", f"c{i}", p) for i, p in enumerate(ps)], PAIRS), **k))]
    assert chosen([0.95]) == ["c0"] and chosen([0.10]) == [] and chosen([0.95, 0.90, 0.60]) == ["c0", "c1"]
    assert chosen([1.0, 0.2], empty_mode="product") == ["c0"]
    roster = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    none = spark.createDataFrame([], PAIRS)
    assert [r.cand_ids for r in decision.with_roster(decision.select_expected_f(none), roster).collect()] == [[], []]


LONG = "s1_id string, cand_id string"


def test_metrics_by_hand(spark):
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("c", "z"), ("d", "w")], LONG)
    pred = spark.createDataFrame([("a", "x"), ("b", "q"), ("d", "w"), ("nobody", "x")], LONG)
    cand = spark.createDataFrame([("a", "x"), ("b", "q"), ("d", "w")], LONG)
    counts = metrics.anchor_counts(truth, pred, cand)
    f = {r.s1_id: (round(r.f05, 6), round(r.oracle_f05, 6)) for r in counts.collect()}
    assert f == {"a": (round(5 / 6, 6), round(5 / 6, 6)), "b": (0.0, 1.0), "c": (0.0, 0.0), "d": (1.0, 1.0)}
    e = metrics.evaluate(counts).first()
    assert (e.n_entities, e.n_empty_truth, e.n_single_match) == (4, 1, 2)
    assert e.macro_f05 == pytest.approx((5 / 6 + 1) / 4) and e.micro_precision == pytest.approx(2 / 3) and e.micro_recall == 0.5
    countries = spark.createDataFrame([("a", "us"), ("b", "us"), ("c", "in")], "s1_id string, country string")
    sizes = spark.createDataFrame([("us", 4), ("in", 2)], "country string, n long")
    seg = {(r.segment_kind, r.segment): r for r in metrics.segments(counts, countries, sizes).collect()}
    assert set(seg) == {("country", "us"), ("country", "in"), ("country", "?"), ("bucket", "0"), ("bucket", "1"), ("bucket", "2"), ("all", "all")}
    assert seg["all", "all"].reduction_ratio == pytest.approx(1 - 3 / 24) and seg["country", "us"].reduction_ratio == pytest.approx(1 - 2 / 8)


def test_error_kinds(spark):
    truth = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("a", "m3"), ("a", "m4")], LONG)
    pred = spark.createDataFrame([("a", "e1"), ("a", "e2"), ("a", "e3"), ("a", "e4")], LONG)
    cand = spark.createDataFrame([("a", x) for x in ("m2", "m3", "m4", "e2", "e3", "e4")], LONG)
    scores = spark.createDataFrame([("a", "m2", 0.1), ("a", "m3", 0.9), ("a", "e2", 0.9), ("a", "e3", 0.1)], "s1_id string, cand_id string, score double")
    r = metrics.classify_errors(truth, pred, cand, scores, 0.5).first()
    assert [r[k] for k in metrics.ERROR_KINDS] == [1, 2, 2, 1, 1, 1]
    r = metrics.classify_errors(truth, pred, cand).first()
    assert [r[k] for k in metrics.ERROR_KINDS] == [1, 0, 0, 1, 3, 3]


def test_sweeps_against_loops(spark):
    rows = [(f"s{k % 7}", f"c{k}", int(k * 7 % 3 == 0), round((k * 37 % 100) / 100, 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, p double")
    for r in metrics.pair_sweep(df).collect():
        hit = [x for x in rows if x[3] >= r.threshold - 1e-9]
        tp = sum(x[2] for x in hit)
        assert r.precision == pytest.approx(tp / len(hit) if hit else 0) and r.recall == pytest.approx(tp / sum(x[2] for x in rows))
    target = metrics.precision_threshold(df, 0.5).first().threshold
    assert target == next((t / 100 for t in range(5, 96) if (h := [x for x in rows if x[3] >= t / 100 - 1e-9]) and sum(x[2] for x in h) / len(h) >= 0.5), None)
    assert metrics.best_macro_threshold(df).first().macro_f05 <= 1


def test_bootstrap(spark):
    df = spark.createDataFrame([(f"s{k}", float(k % 2)) for k in range(60)], "s1_id string, f05 double")
    a, b = (metrics.bootstrap_ci(df.repartition(n), n_boot=200).first() for n in (1, 5))
    assert a.low == pytest.approx(b.low) and a.low < a.point == 0.5 < a.high and 0.05 < a.high - a.low < 0.5
    assert metrics.bootstrap_ci(df, n_boot=0).first().low is None


def test_duds_and_separation(spark):
    df = spark.createDataFrame([(k % 2, float(k), float(k), 1.0, float("nan"), float(k % 2)) for k in range(40)], "label int, x double, y double, c double, n double, z double")
    problems = {r.feature: r.problem for r in metrics.dud_features(df, ("x", "y", "c", "n", "z", "gone")).collect()}
    assert problems == {"y": "duplicate_of x", "c": "constant", "n": "all_nan", "gone": "missing"}
    assert metrics.separation(df, ("z",)).first().delta == 1.0


def test_validation(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S3-9"), ("S1-2", "S1-3,X-1"), ("S1-9", None)], "s1_id string, ids string")
    roster = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "cand_id string")
    got = {r.rule: r.n for r in validate.check_lists(lists, roster, known).collect()}
    assert got == {"duplicate_row": 1, "repeated_id": 1, "anchor_in_list": 1, "bad_prefix": 1, "unknown_id": 1, "missing_row": 1, "extra_row": 1}
    assert not validate.passes(validate.check_lists(lists)) and validate.passes(validate.check_lists(lists.limit(0)))


def test_training_pairs(spark):
    rows = [(f"S1-{k}", f"name{k} shop", "", "us" if k % 2 else "in") for k in range(12)]
    gal = [(f"S2-{k}", f"name{k} shop", "", "us" if k % 2 else "in") for k in range(12)] + [(f"S3-{k}", f"name{k} shops", "", "us" if k % 2 else "in") for k in range(12)]
    a, g = records(spark, rows), records(spark, gal)
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}" if k else None) for k in range(12)], LONG)
    neg = training.hard_negatives(a, g, truth)
    country = {r[0]: r[3] for r in rows + gal}
    by = {}
    for r in neg.collect():
        by.setdefault(r.s1_id, []).append(country[r.s1_id] == country[r.cand_id])
    assert set(by) == {f"S1-{k}" for k in range(12)} and all(sorted(v) == [False, True] for v in by.values())
    assert training.positives(truth).join(neg, ["s1_id", "cand_id"]).count() == 0
    hard = training.build_pairs(a, g, truth, "eval_hard")
    assert hard.where("label = 0").groupBy("s1_id").count().agg(F.max("count")).first()[0] == 6
    assert training.build_pairs(a, g, truth, "eval_full").count() == 12 * 24
    clean = training.build_pairs(a, g, truth, "train", exclude_countries=("in",))
    assert all(country[r.cand_id] == "us" or country[r.s1_id] == "in" for r in clean.where("label = 0").collect())
    split = training.training_pairs(a, g, truth)
    assert split.groupBy("s1_id").agg(F.count_distinct("is_train").alias("n")).where("n > 1").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2, S2-1,,S2-2\nS1-2\t\nS1-1\tS3-3\n")
    lists = {r.s1_id: r.ids for r in tsv.read_id_lists(spark, str(tmp_path / "m.tsv"), "matched_entity_ids").collect()}
    assert lists == {"S1-1": ["S3-3"], "S1-2": []}
    (tmp_path / "p.tsv").write_text("source1_entity_id\tcandidate_entity_id\tscore\na\tx\t0.5\na\ty\tbad\na\tx\t0.7\n")
    assert [tuple(r) for r in tsv.read_pair_scores(spark, str(tmp_path / "p.tsv")).collect()] == [("a", "x", 0.7)]
    roster = spark.createDataFrame([("b", 0), ("a", 1)], "s1_id string, pos long")
    tsv.write_tsv(tsv.match_lists(spark.createDataFrame([("a", "y"), ("a", "x")], LONG), roster), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nb\t\na\tx,y\n"
    assert sorted(r.id for r in tsv.read_ids(spark, str(tmp_path / "m.tsv")).collect()) == ["S1-1", "S1-2"]
    assert validate.check_file(spark, str(tmp_path / "m.tsv"), ("source1_entity_id", "matched_entity_ids")) == []
    assert validate.check_file(spark, str(tmp_path / "m.tsv"), ("a", "b"))[0][0] == "header"
    assert validate.check_file(spark, str(tmp_path / "none"), ("a", "b"))[0][:2] == ("file_absent", "E")


def test_streaming_links(spark, tmp_path):
    from kinlink.streaming import upsert

    raw = "entity_id string, business_name string, business_address string, country string"
    anchors = apply_normalization(spark.createDataFrame([("S1-1", "Acme Robotics Inc", "500 Market Street, San Jose", "US")], raw))
    for k, name in enumerate(("Acme Robotics", "Other Shop")):
        spark.createDataFrame([(f"S2-{k}", name, "500 Market St San Jose" if k == 0 else "1 Elsewhere", "US")], raw).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw).parquet(f"{tmp_path}/in")
    q = upsert.start_linking(stream, anchors, f"{tmp_path}/out", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").select("s1_id", "cand_id").collect()
    assert [tuple(r) for r in got] == [("S1-1", "S2-0")]
