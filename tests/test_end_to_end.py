import json

from kinlink.functions.text import apply_normalization
from kinlink.operators import blocking, metrics, models
from kinlink.plans import fixtures, pipeline, views
from kinlink.sources import tsv


def test_generator_is_deterministic_and_sound(tmp_path):
    for name in "ab":
        fixtures.write_dataset(str(tmp_path / name), 60, seed=3)
    files = sorted(p.relative_to(tmp_path / "a") for p in (tmp_path / "a").rglob("*.tsv"))
    assert len(files) == 8 and all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    t = fixtures.generate(200, 5)
    gallery = {r[0] for r in t["s2"] + t["s3"]}
    listed = [x for _, ids in t["truth"] for x in ids.split(",") if x]
    assert len(listed) == len(set(listed)) and set(listed) <= gallery
    assert len({r[0] for r in t["s1"]}) == 200 and all(r[1] and r[2] for r in t["s1"])
    assert fixtures.largest_remainder(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert fixtures.parse_mix("US=0.6, India=0.4") == {"US": 0.6, "India": 0.4}


def test_link_unseen_records(spark, tmp_path):
    fixtures.write_dataset(str(tmp_path), 90, seed=7)
    train = tsv.load_frames(spark, str(tmp_path), "train")
    test = tsv.load_frames(spark, str(tmp_path), "test")
    a, g = apply_normalization(train["s1"]).persist(), apply_normalization(train["gallery"]).persist()
    linker = pipeline.Linker.train(a, g, train["truth"], str(tmp_path / "work"), trials=1, space=models.QUICK_BASES)
    cands, scored, selected = linker.infer(apply_normalization(test["s1"]), apply_normalization(test["gallery"]), str(tmp_path / "work"))
    rows = tsv.read_tsv(spark, str(tmp_path / "dataset/test/test_ground_truth.tsv"), tsv.list_schema("matched_entity_ids"))
    truth = tsv.truth_long(rows)
    quality = blocking.blocking_quality(cands, truth, test["gallery"].count()).first()
    assert quality.pair_recall > 0.9
    assert scored.count() == cands.count() and scored.where("p < 0 or p > 1").count() == 0
    counts = metrics.anchor_counts(truth, selected, cands)
    assert metrics.evaluate(counts).first().macro_f05 > 0.6
    countries = tsv.country_map(test["s1"]).withColumnRenamed("entity_id", "s1_id")
    sizes = tsv.country_map(test["gallery"]).groupBy("country").count().withColumnRenamed("count", "n")
    report = pipeline.report(truth, selected, cands, scored.withColumnRenamed("p", "score"), 0.5, countries, sizes)
    assert 0 <= report["selector_loss"] <= 1 and {s["segment_kind"] for s in report["segments"]} == {"all", "country", "bucket"}
    tsv.write_report(report, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text())["segments"]
    linker.stack.save(str(tmp_path / "model"))
    again = models.Stack.load(str(tmp_path / "model"), calibrated=linker.stack.calibrator is not None)
    assert set(again.bases) == set(models.BASES)


def test_views_match_their_specification(spark):
    d = "/root/testdata/sf0.001"
    assert views.s1(spark, d).count() == 200 and views.truth(spark, d).count() == 200
    assert views.gallery(spark, d).where("source = 'S2'").count() == 180
