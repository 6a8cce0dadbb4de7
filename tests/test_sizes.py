"""What holds queries to their size: the same rows as the plain way, without making all pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinlink.operators import blocking, tfidf, training


def texts(spark, n, prefix, seed):
    rng = random.Random(seed)
    made = [" ".join([str(rng.randrange(10, 40)), rng.choice("large small medium".split()), "street", "brand", *rng.sample("aa bb cc dd ee ff".split(), rng.randrange(0, 3))]) for _ in range(n)]
    return spark.createDataFrame([(f"{prefix}{i}", t) for i, t in enumerate(made)], "entity_id string, t string")


def test_best_cosines_are_those_of_all_pairs(spark, monkeypatch):
    a, g = texts(spark, 60, "a", 1), texts(spark, 150, "g", 2)
    every = tfidf.tfidf_join(a, g, F.col("t"), 0.3).withColumn("cos", F.round("cos", 9))
    rows = lambda df: sorted((r.s1_id, r.cand_id, round(r.cos, 8)) for r in df.collect())
    want = rows(blocking.cap_candidates(every, 4, "cos"))
    there, back = blocking.adaptive_prune(every, 2, 6, 0.1), blocking.adaptive_prune(every, 1, 3, 0.05, by="cand_id", other="s1_id")
    want_there, want_both = rows(there), rows(there.union(back.select(*there.columns)).groupBy("s1_id", "cand_id").agg(F.max("cos").alias("cos")))

    def never(*_, **__):
        raise AssertionError("all cosines were made")

    monkeypatch.setattr(tfidf, "cosines", never)
    assert rows(tfidf.tfidf_join(a, g, F.col("t"), 0.3, top_k=4)) == want and want
    assert rows(tfidf.tfidf_adaptive(a, g, F.col("t"), 0.3, 2, 6, 0.1)) == want_there
    assert rows(tfidf.tfidf_bidirectional(a, g, F.col("t"), 0.3, (2, 6, 0.1), (1, 3, 0.05))) == want_both


def test_best_bm25_is_that_of_all_pairs(spark, monkeypatch):
    a, g = texts(spark, 40, "a", 3), texts(spark, 120, "g", 4)
    every = tfidf.bm25_join(a, g, F.col("t"), top_k=None)
    rows = lambda df: sorted((r.s1_id, r.cand_id, round(r.bm25, 8)) for r in df.collect())
    want, asked = rows(blocking.cap_candidates(every, 5, "bm25")), []
    plain = tfidf.best_pairs
    monkeypatch.setattr(tfidf, "best_pairs", lambda *x, **k: asked.append(1) or plain(*x, **k))
    assert rows(tfidf.bm25_join(a, g, F.col("t"), top_k=5)) == want and want and asked


def test_copies_of_a_name_are_not_all_pooled(spark):
    schema = "entity_id string, business_name_clean string, country_clean string"
    a = spark.createDataFrame([("a0", "blue ring large", "us"), ("a1", "blue ring large", "us")], schema)
    g = spark.createDataFrame([(f"g{i:03}", "blue ring large", "us") for i in range(200)] + [("h", "blue ring larger", "us")], schema)
    real = spark.createDataFrame([("a0", "g000"), ("a1", "g001")], "s1_id string, cand_id string")
    pool = training.similar_pool(a, g, real, 1)
    ranked = training.ranked_hard(training.same_country_pool(a, g, pool), real).where("rank = 1")
    assert sorted((r.s1_id, r.cand_id) for r in ranked.collect()) == [("a0", "g001"), ("a1", "g000")]
    assert pool.count() <= 4


def test_hard_negatives_send_no_table_of_records_to_all(spark, monkeypatch):
    """Files of many records may have few bytes; what is joined by a record's id or place is not broadcast for that."""
    plans, plain = [], training.keep
    plan = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(training, "keep", lambda df: plan(df) or plain(df))
    schema = "entity_id string, business_name_clean string, country_clean string"
    side = lambda x, n: plain(spark.createDataFrame([(f"{x}{i}", f"blue ring {'large' * (i % 3)}", ("us", "fr")[i % 2]) for i in range(n)], schema))
    real = plain(spark.createDataFrame([(f"a{i}", f"g{i}") for i in range(10)], "s1_id string, cand_id string"))
    made = training.hard_negatives(side("a", 10), side("g", 30), real)
    plan(made)
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sent if any(k in line.split("],")[0] for k in ("s1_id", "cand_id", "entity_id", "place"))]
    assert made.count() == 20 and made.join(real, ["s1_id", "cand_id"]).isEmpty()


def keyed(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, business_name_clean string, business_address_clean string")


@pytest.mark.parametrize("leg", [blocking.exact_name, blocking.minhash_leg])
def test_pairs_of_names_are_distinct_without_a_shuffle_of_all(spark, leg):
    a = keyed(spark, [("a", "blue ring", ""), ("a", "blue rings", ""), ("b", "blue ring", ""), ("b", "blue ring", "")])
    g = keyed(spark, [("x", "blue ring", ""), ("x", "blue rings", ""), ("y", "blue rings", ""), ("y", "blue rings", "")])
    found = leg(a, g)
    want = [("a", "x"), ("a", "y"), ("b", "x")] + ([("b", "y")] if leg is blocking.minhash_leg else [])
    assert sorted((r.s1_id, r.cand_id) for r in found.collect()) == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().nodeName()


@pytest.fixture(scope="module")
def shared_ids(tmp_path_factory):
    """Parts whose keys lie a million apart, so that records of the gallery share ids."""
    folder, con = tmp_path_factory.mktemp("shared-ids"), duckdb.connect()
    con.execute(f"copy (select p.* replace (case k when 0 then p_partkey else 1000000 + p_partkey * 7 % 200 end as p_partkey) from '/root/testdata/sf0.001/part.parquet' p, range(2) r(k)) to '{folder}/part.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["er_views", "er_threshold_sets"])
def test_records_that_share_an_id_count_each(spark, shared_ids, name):
    from test_catalog import rows_of

    con = duckdb.connect()
    con.execute(f"create view part as select * from '{shared_ids}/part.parquet'")
    assert rows_of(entry.queries()[name](spark, shared_ids).toPandas()) == rows_of(con.execute(entry.oracle_sql()[name]).fetchdf())


def test_mean_ratios_that_print_with_a_last_5_round_as_in_sql(spark, tmp_path):
    """The mean of 0.35625 and 0.653125 lies below 0.5046875, as it prints; two records that share an id give it."""
    from test_catalog import rows_of

    con = duckdb.connect()
    con.execute("create table part as select * from (values (1065032, 'hot bolt', 'Brand#18', 'LARGE'), (65032, 'small widget', 'Brand#18', 'PROMO')) t(p_partkey, p_name, p_brand, p_type)")
    con.execute(f"copy (select p_partkey::bigint as p_partkey, p_name, p_brand, p_type from part) to '{tmp_path}/part.parquet' (format parquet)")
    got = entry.queries()["er_feat_weighted_ratio"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(con.execute(entry.oracle_sql()["er_feat_weighted_ratio"]).fetchdf())
    assert 0.504687 in set(got.weighted_avg)


def test_fits_side_by_side_choose_as_one_after_the_other(spark, monkeypatch):
    from kinlink.operators import models

    rows = [(f"s{i}", f"c{i}", int(i % 3 == 0), (i % 7) / 7 + (i % 3 == 0) * 0.3) for i in range(60)]
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, x double")
    train = models.folds(models.balanced(models.assemble(pairs, ("x",))), 3).coalesce(1).persist()
    spaces = {"forest": (models.RandomForestClassifier, {"numTrees": (2, 3), "maxDepth": (1, 2)})}
    side_by_side = models.tune_all(train, ("forest",), 2, space=spaces)
    monkeypatch.setattr(models, "_together", lambda _, tasks: [task() for task in tasks])
    assert models.tune_all(train, ("forest",), 2, space=spaces) == side_by_side


def test_fits_of_as_many_tasks_as_cores_run_side_by_side(spark):
    from threading import Barrier

    from kinlink.operators import models

    cores, met = spark.sparkContext.defaultParallelism, Barrier(2)
    train = spark.range(100).repartition(cores)
    assert models._together(train, [lambda: met.wait(20) >= 0] * 2) == [True, True]
    assert [models._n_tasks(n, 8) for n in (5, 90_000, 1_000_000, 20_000_000)] == [1, 4, 8, 80]


def test_a_wrong_pair_counts_for_each_of_its_scores(spark):
    from kinlink.operators import metrics

    frame = lambda rows, more="": spark.createDataFrame(rows, "s1_id string, cand_id string" + more)
    truth, none, cand = frame([("a", "x")]), frame([("a", "y")]).limit(0), frame([("a", "x")])
    scores = frame([("a", "x", 0.9), ("a", "x", 0.2)], ", score double")
    once = metrics.classify_errors(truth, none, cand, scores, 0.5).first()
    each = metrics.classify_errors(truth, none, cand, scores, 0.5, repeats=True).first()
    assert (once.decision_policy_error, once.matching_error) == (1, 0)
    assert (each.decision_policy_error, each.matching_error) == (1, 1)
