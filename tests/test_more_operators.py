import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import fuzzy, indic, registry, text
from kinlink.functions.text import apply_normalization
from kinlink.operators import clusters, features, metrics, models, scan, tfidf, training, vectors
from kinlink.plans import demo, evaluate, fixtures, pipeline
from kinlink.sources import store, tsv

CLEAN = "entity_id string, business_name_clean string, business_address_clean string, country_clean string"
PAIRS = "s1_id string, cand_id string"


def records(spark, rows):
    return spark.createDataFrame(rows, CLEAN)


def pairs(df):
    return sorted((r.s1_id, r.cand_id) for r in df.collect())


NAMES = ["acme robotics systems", "acme robotic system", "bright cafe", "cafe bright house", "delta works", "acme", "robotics acme systems", ""]


def sides(spark):
    a = records(spark, [(f"S1-{k}", n, "", "us" if k % 2 else "in") for k, n in enumerate(NAMES)])
    g = records(spark, [(f"S2-{k}", n, "", "us" if k % 3 else "in") for k, n in enumerate(NAMES + NAMES)])
    return a, g


@pytest.mark.parametrize("block", [1, 2000])
def test_fuzzy_scan_is_the_whole_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "QUERY_BLOCK", block)
    monkeypatch.setattr(scan, "SCAN_ROWS", 3)
    a, g = sides(spark)
    for most, threshold, scope in ((3, 0.5, None), (50, 0.4, "country_clean"), (4, 0.0, None)):
        want = []
        for i, n, _, c in map(tuple, a.collect()):
            scored = [(-fuzzy.weighted_ratio(n, m), j) for j, m, _, d in map(tuple, g.collect()) if n and m and (scope is None or c == d)]
            want += [(i, j) for s, j in sorted(scored)[:most] if -s >= threshold and s < 0]
        got = scan.fuzzy_scan(a, g, threshold, most, F.col(scope) if scope else None)
        assert pairs(got) == sorted(want)
    assert scan.brute_top_k(a, g, 2).count() == 14


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "SCAN_ROWS", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    v[20:25] = v[3]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = vectors.dense_top_k(df, df.where("id % 5 = 3"), 4)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    want = sorted((q, j, cos[q, j]) for q in range(3, 40, 5) for j in sorted((j for j in range(40) if j != q), key=lambda j, q=q: (-cos[q, j], j))[:4])
    assert [(q, j, pytest.approx(c)) for q, j, c in sorted(map(tuple, got.collect()))] == want
    assert vectors.dense_top_k(df, df.where("id < 0")).count() == 0


def test_components_and_pivots(spark):
    edges = [(f"a{k}", f"a{k + 1}") for k in range(30)] + [("b1", "b2"), ("b2", "b1"), ("c", "c")]
    got = {r.id: r.cluster for r in clusters.components(spark.createDataFrame(edges, PAIRS)).collect()}
    assert {got[f"a{k}"] for k in range(31)} == {"a0"} and got["b2"] == "b1" and got["c"] == "c"
    assert clusters.components(spark.createDataFrame([], PAIRS)).count() == 0
    found = {r.id: r.cluster for r in clusters.pivots(spark.createDataFrame(edges, PAIRS)).collect()}
    assert set(found) == {x for e in edges for x in e if x != "c"}
    linked = {frozenset(e) for e in edges}
    assert all(found[i] == i or frozenset((i, found[i])) in linked for i in found) and all(found[p] == p for p in found.values())


def test_bm25_against_its_formula(spark):
    import math

    a, g = sides(spark)
    docs = [(j, n.split()) for j, n, _, _ in map(tuple, g.collect()) if n]
    mean, n = sum(len(w) for _, w in docs) / len(docs), len(docs)
    df = {t: sum(t in w for _, w in docs) for _, w in docs for t in w}
    want = {}
    for i, q, _, _ in map(tuple, a.collect()):
        for j, w in docs:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(q.split()) if t in w)
            if s:
                want[i, j] = s
    got = {(r.s1_id, r.cand_id): r.bm25 for r in tfidf.bm25_join(a, g, F.col("business_name_clean"), top_k=None).collect()}
    assert got == pytest.approx(want, abs=1e-8)
    rare = pairs(tfidf.bm25_join(a, g, F.col("business_name_clean"), max_df=3))
    assert rare and not any(i == "S1-5" for i, _ in rare)  # its only word is in six names


def test_address_conflicts(spark):
    rows = [("x", "", "12 king st lyon 69001", ""), ("y", "", "14 queen st lyon 69002", ""), ("z", "", "lyon", ""), ("w", "", "12 king st lyon 69001", "")]
    parts = features.record_parts(records(spark, rows), fuzzy_parts=False)
    asked = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "w")], PAIRS)
    made = features.address_conflicts(F.col("a"), F.col("b"))
    got = {r.cand_id: tuple(r)[2:] for r in features.pair_up(asked, parts, parts).select("s1_id", "cand_id", *[c.alias(n) for n, c in made.items()]).collect()}
    assert got == {"y": (1.0, 1.0, 1.0, 4.0), "z": (0.0, 0.0, 0.0, 0.0), "w": (0.0, 0.0, 0.0, 0.0)}


def test_unknown_ids_as_empty_texts(spark):
    a = records(spark, [("S1-1", "acme", "1 main st", "us")])
    asked = spark.createDataFrame([("S1-1", "S2-9"), ("S1-9", "S2-9")], PAIRS)
    assert features.compute_features(asked, a, a).count() == 0
    got = {r.s1_id: r for r in features.compute_features(asked, a, a, unknown="empty").collect()}
    assert got["S1-1"].name_a_present == 1 and got["S1-1"].name_b_present == 0 and got["S1-9"].name_edit_ratio == 1.0
    assert all(v is not None for r in got.values() for v in tuple(r))
    with pytest.raises(ValueError):
        features.pair_up(asked, a, a, "other")


def test_word_evidence_and_regions(spark):
    g = features.record_parts(records(spark, [(f"g{k}", n, "", "") for k, n in enumerate(("acme cafe", "blue cafe", "red cafe", "zeta labs"))]), fuzzy_parts=False)
    a = features.record_parts(records(spark, [("s", "acme blue cafe new", "", "")]), fuzzy_parts=False)
    asked = spark.createDataFrame([("s", "g0")], PAIRS)
    r = features.word_evidence(asked, a, g, g, rare_df=1, generic_share=0.5).first()
    assert (r.rare_token_overlap, r.distinctive_token_count, r.generic_token_ratio) == (1, 3, 0.25)
    assert r.idf_match == pytest.approx(np.log(5 / 2) + 1 + np.log(5 / 4) + 1)
    regions = spark.createDataFrame([("s", "lyon"), ("g0", "lyon"), ("g1", "paris")], "entity_id string, region string")
    some = spark.createDataFrame([("s", "g0"), ("s", "g1"), ("s", "g2")], PAIRS)
    assert {x.cand_id: x.region_overlap for x in features.region_overlap(some, regions).collect()} == {"g0": 1.0, "g1": 0.0, "g2": -1.0}


def test_random_negatives_in_full(spark):
    a = records(spark, [(f"S1-{k}", "n", "", "us") for k in range(5)])
    g = records(spark, [(f"S2-{k}", "n", "", "us" if k < 200 else "in") for k in range(206)])
    want = spark.createDataFrame([(f"S1-{k}", n) for k, n in enumerate((0, 1, 5, 6, 9))], "s1_id string, n int")
    barred = spark.createDataFrame([("S1-3", "S2-200"), ("S1-3", "S2-201")], PAIRS)
    got = pairs(training.random_other_country(a, g, want, 1, without=barred))
    counts = {k: sum(i == f"S1-{k}" for i, _ in got) for k in range(5)}
    assert counts == {0: 0, 1: 1, 2: 5, 3: 4, 4: 6} and len(set(got)) == len(got)
    assert all(int(j[3:]) >= 200 for _, j in got) and not {("S1-3", "S2-200"), ("S1-3", "S2-201")} & set(got)
    assert training.random_other_country(a, g, want, 1, exclude=("in",)).count() == 0


def test_hard_negatives_fill_up(spark):
    a, g = sides(spark)
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k + 8}" if k != 5 else None) for k in range(8)], PAIRS)
    got = training.hard_negatives(a, g, truth, per_anchor=4, hard_ratio=0.5)
    by = {}
    country = {r.entity_id: r.country_clean for r in a.union(g).collect()}
    for i, j in pairs(got):
        by.setdefault(i, []).append(country[i] == country[j])
    assert set(by) == {f"S1-{k}" for k in range(8)}
    assert all(sum(not x for x in v) == 2 for v in by.values())
    assert all(sum(by[f"S1-{k}"]) == 2 for k in range(7))  # the last has no name to compare
    assert not set(pairs(got)) & set(pairs(truth.where("cand_id is not null")))


def test_folds_of_few_rows(spark):
    make = lambda n, ones: spark.createDataFrame([(f"a{k}", f"b{k}", int(k < ones)) for k in range(n)], "s1_id string, cand_id string, label int")
    of = lambda n, ones, k=3: sorted((r.fold, r.label) for r in models.folds(make(n, ones), k).collect())
    assert [sum(f == x and y == 1 for f, y in of(30, 9)) for x in range(3)] == [3, 3, 3]
    assert sorted({f for f, _ in of(8, 1)}) == [0, 1, 2]
    assert [f for f, _ in of(5, 2)] == [-1, -1, -1, 0, 0] and [f for f, _ in of(1, 1)] == [0]


def test_evidence_statistics_and_mix(spark):
    worst = spark.createDataFrame([("a",)], "s1_id string")
    predicted = spark.createDataFrame([("a", f"c{k}", k / 10) for k in range(5)] + [("b", "c1", 1.0)], "s1_id string, cand_id string, score double")
    made = spark.createDataFrame([("a", f"c{k}", k / 3) for k in range(5)], "s1_id string, cand_id string, f double")
    got = metrics.feature_evidence(worst, predicted, made, names=("f",)).orderBy("rank").collect()
    assert [(r.cand_id, r.f) for r in got] == [("c4", 1.3333), ("c3", 1.0), ("c2", 0.6667)]
    s1 = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "y")], "entity_id string, business_name string")
    gallery = spark.createDataFrame([("x", " "), ("अब", "a"), (None, None), ("z", "b")], "business_name string, business_address string")
    truth = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "r"), ("3", None), ("4", None)], PAIRS)
    r = metrics.split_statistics(s1, gallery, truth).first()
    assert (r.n_s1, r.multi_match_pct, r.singleton_pct, r.mean_matches, r.max_matches, r.total_matches, r.shared_name_pct) == (4, 25.0, 50.0, 0.75, 2, 3, 50.0)
    assert (r.n_gallery, r.blank_gallery_addr_pct, r.indic_name_pct_gallery) == (4, 50.0, 25.0)
    mix = spark.createDataFrame([("US",), ("US",), ("India",)], "country string")
    assert {x.country: x.share for x in metrics.country_mix(mix).collect()} == {"US": 0.6667, "India": 0.3333}


def test_indic_text(spark):
    assert indic.transliterate("ऑफिस") == "ophis" and indic.transliterate("कॉलेज") == "kolej"
    odd = "".join(indic.UNMAPPED[:3])
    df = spark.createDataFrame([("कंपनी", "x"), ("plain", f"अ{odd}"), (None, None)], "business_name string, business_address string")
    got = {r.column: (r.rows, r.indic_rows, r.unmapped_rows) for r in text.untransliterated(df).collect()}
    assert got == {"business_name": (3, 1, 0), "business_address": (3, 1, 1)}


def test_functions_in_sql(spark):
    assert "kin_weighted_ratio" in registry.register(spark)
    r = spark.sql("select kin_ratio('acme', 'acm') as a, kin_metaphone('knight') as b, kin_indic_to_latin('कॉलेज') as c, kin_partial_ratio(null, 'x') as d").first()
    assert (r.a, r.b, r.c, r.d) == (pytest.approx(6 / 7), "NFT" if r.b == "NFT" else r.b, "kolej", 0.0)


def test_changed_input_is_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = store.written(spark, "probe", lambda: spark.read.parquet(path), path).count()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert (first, store.written(spark, "probe", lambda: spark.read.parquet(path), path).count()) == (3, 5)


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("split")
    fixtures.write_dataset(str(folder), 60, seed=11)
    train = tsv.load_frames(spark, str(folder), "train")
    a, g = (store.keep(apply_normalization(train[k])) for k in ("s1", "gallery"))
    return str(folder), a, g, train["truth"]


def test_holdout_in_both_regimes(spark, split, monkeypatch):
    _, a, g, truth = split
    monkeypatch.setattr(models, "fit_single", lambda rows, seed=42: models.fit_assembled(models.balanced(models.assemble(rows)), seed, {"maxDepth": 2, "maxIter": 3}))
    out = pipeline.country_holdout(a, g, truth, "us", "india", least=3)
    assert set(out["directions"]) == {"us->india", "india->us"} and 0 < out["pooled"]["threshold"] < 1
    for d in out["directions"].values():
        assert 0 <= d["transfer_full"]["precision"] <= 1 and d["transfer_full"]["fp"] >= d["transfer_hard"]["fp"]
        assert d["gaps"]["precision"] == pytest.approx(d["transfer_hard"]["precision"] - d["in_country"]["precision"], abs=1e-4)
    assert out["unseen_country_cutoff"] is None or out["unseen_country_cutoff"] <= 0.95
    few = pipeline.country_holdout(a, g, truth, "us", "nowhere", least=3)
    assert all("skipped" in d for d in few["directions"].values()) and few["unseen_country_cutoff"] is None


def test_hard_negatives_out_of_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{k % 12}", f"c{k}", int(k % 4 == 0), float(rng.normal(2.0 if k % 4 == 0 else 0.0)), float(rng.normal())) for k in range(120)]
    spare = [(f"a{k % 12}", f"d{k}", 0, float(rng.normal(1.5)), float(rng.normal())) for k in range(60)]
    schema = "s1_id string, cand_id string, label int, f double, h double"
    got, log = pipeline.oof_hard_negatives(spark.createDataFrame(rows, schema), spark.createDataFrame(spare, schema), rounds=2, names=("f", "h"))
    added = [r for r in got.collect() if r.cand_id.startswith("d")]
    assert len(log) >= 1 and log[0]["added"] == len(added) if len(log) == 1 or log[1]["added"] == 0 else len(added) > 0
    assert all(r.label == 0 for r in added) and got.count() == 120 + len(added)


def test_demo_and_evaluation_commands(spark, split, tmp_path, monkeypatch, capsys):
    folder, a, g, truth = split
    monkeypatch.setattr(models, "fit_single", lambda rows, seed=42: models.fit_assembled(models.balanced(models.assemble(rows)), seed, {"maxDepth": 2, "maxIter": 3}))
    out = str(tmp_path)
    few = demo.error_demo(a, g, truth, top_k=3, out_dir=out)
    whole = next(r for r in few["segments"] if r["segment_kind"] == "all")
    assert whole["oracle_f05"] >= whole["macro_f05"]
    monkeypatch.setattr(evaluate, "SparkSession", type("S", (), {"builder": type("B", (), {"getOrCreate": staticmethod(lambda: spark)})}))
    one = lambda name: str(next((tmp_path / name).glob("part-*.csv")))
    files = [f"{folder}/dataset/train/train_source{k}.tsv" for k in (1, 2, 3)]
    code = evaluate.main(["--matches", one("predictions"), "--truth", one("held_out_truth"), "--candidates", one("candidates"), "--scores", one("pair_scores"), "--threshold", "0.5", "--s1", files[0], "--gallery", *files[1:], "--json", f"{out}/r.json"])
    printed = capsys.readouterr().out
    found = json.loads((tmp_path / "r.json").read_text())
    assert code == 0 and "selector loss" in printed and "country:" in printed
    assert next(r for r in found["segments"] if r["segment_kind"] == "all")["macro_f05"] == pytest.approx(whole["macro_f05"])
    assert any(found["evidence"].values()) if found["worst"] and "evidence" in found and found["evidence"] else True
    assert evaluate.main(["--matches", one("predictions"), "--candidates", one("candidates"), "--gallery", *files[1:], "--validate"]) == 0
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n")
    assert evaluate.main(["--matches", str(bad), "--validate"]) == 1 and "repeated_id" in capsys.readouterr().out


def test_latest_rows_and_windows_of_a_stream(spark, tmp_path):
    from kinlink.streaming import upsert

    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("a", 3, None), ("b", 1, "y")], "entity_id string, n int, t string").coalesce(1)
    assert sorted(map(tuple, upsert.latest_rows(rows).collect())) == [("a", 3, None), ("b", 1, "y")]
    events = [("US", "2024-01-01 00:01:00"), ("US", "2024-01-01 00:04:00"), ("India", "2024-01-01 00:06:00"), ("US", "2024-01-01 00:30:00")]
    for k, part in enumerate((events, [("US", "2024-01-01 00:31:00")], [("US", "2024-01-01 00:02:00"), ("US", "2024-01-01 01:30:00")])):
        spark.createDataFrame(part, "country string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("country string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = upsert.arrivals_by_country(stream).writeStream.format("memory").queryName("arrivals").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.country, str(r.window.start)[11:16]): r.n for r in spark.table("arrivals").collect()}
    assert got["India", "00:05"] == 1 and got["US", "00:00"] == 2 and ("US", "01:30") not in got
