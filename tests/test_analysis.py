import csv
import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import analysis as A, evaluate as E, exports as P, instances as I, rank as K


def test_modal_takes_the_smallest_of_equally_frequent(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a"), (None, "q")], "location long, city string")
    assert {r["location"]: r["city"] for r in A.modal(d, "location", "city").collect()} == {1: "a", 2: "z"}


def test_query_location_names_fall_back_to_history(spark):
    items = spark.createDataFrame([("i", 1, "Место оказания услуг Тверская область, г. Тверь, ул. Мира"), ("j", 2, None)], "item_id string, location long, params string")
    history = spark.createDataFrame([(7, ["i", "j"]), (1, ["j"])], "location long, items array<string>")
    names = A.query_location_names(A.location_names(items), history, items)
    assert {r["location"]: r["city"] for r in names.collect()} == {1: "Тверь", 7: "Тверь"}


def test_reassembly_needs_each_position_once(spark):
    order = spark.createDataFrame([(2, "b"), (1, "a")], "position long, id string")
    one, two = spark.createDataFrame([(1, 0.5)], "position long, s double"), spark.createDataFrame([(2, 0.7)], "position long, s double")
    assert {(r["id"], r["s"]) for r in P.reassemble(order, [two, one]).collect()} == {("a", 0.5), ("b", 0.7)}
    for shards in ([one], [one, two, two]):
        with pytest.raises(PySparkException):
            P.reassemble(order, shards).collect()


def test_scores_for_other_pairs_are_refused(spark):
    top = spark.createDataFrame([("q", "a"), ("q", "b")], "qid string, item_id string")
    good = top.withColumn("ce_score", F.lit(0.1))
    assert P.verified_scores(top, good).count() == 2
    for bad in (good.limit(1), good.unionByName(good), good.withColumn("ce_score", F.lit(None).cast("double")), good.withColumn("item_id", F.lit("x"))):
        with pytest.raises(ValueError):
            P.verified_scores(top, bad)


def test_variants_refuse_unknown_names():
    assert A.variant("v", ["rank_a", "rank_b", "price"], ["rank_a"]) == ["rank_b", "price"]
    with pytest.raises(ValueError):
        A.variant("v", ["price"], ["rank"])


def test_training_prefers_what_ranks_better(spark):
    rows = [(f"q{q}", f"i{i:03d}", int(i == q % 5), i + 1, float(i == q % 5) + 0.01 * i) for q in range(60) for i in range(12)]
    pairs = spark.createDataFrame(rows, "qid string, item_id string, label int, rrf_rank int, x double")
    truth = pairs.filter("label = 1").select("qid", "item_id")
    ranker, best = A.train(pairs, truth, ["x"], [{"trees": 2, "depth": 1}, {"trees": 4, "depth": 2}], k=1)
    assert best["recall"] == 1.0
    top = K.predict_top(ranker.score(pairs), 1)
    assert E.mean_recall(E.recall_per_query(truth, top, 1)).first()["recall"] > 0.9


def test_auc_of_ranges_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([0, 1]), round(rng.gauss(0, 1), 1)) for _ in range(800)]
    got = E.single_auc(spark.createDataFrame(rows, "y int, v double"), ["v"], F.col("y")).first()["auc"]
    pos, neg = [v for y, v in rows if y], [v for y, v in rows if not y]
    a = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - max(a, 1 - a)) < 1e-8


def test_tuned_weights_equal_a_search_on_the_driver(spark):
    """Coordinate ascent against the same search over plain Python recalls."""
    cand = [("q1", "a", 1, "x"), ("q1", "b", 2, "x"), ("q1", "b", 1, "y"), ("q2", "c", 1, "x"), ("q2", "d", 1, "y"), ("q2", "c", 3, "y")]
    truth = [("q1", "b"), ("q2", "d"), ("q3", "z")]
    grid = (0, 0.25, 0.5, 1, 2, 4)

    def recall(w):
        hits = 0
        for q in ("q1", "q2", "q3"):
            s = {}
            for qid, i, r, c in cand:
                if qid == q:
                    s[i] = s.get(i, 0) + w[c] / (60 + r)
            top = sorted((-round(v, 9), i) for i, v in s.items() if round(v, 9) > 0)[:1]
            hits += sum((q, i) in truth for _, i in top)
        return hits / 3

    w = {"x": 1.0, "y": 1.0}
    best = recall(w)
    for _ in range(3):
        for c in w:
            for v in grid:
                if recall(w | {c: v}) > best + 1e-9:
                    best, w = recall(w | {c: v}), w | {c: float(v)}
    got = E.tune_rrf(spark.createDataFrame(truth, "qid string, item_id string"), spark.createDataFrame(cand, "qid string, item_id string, rank int, channel string"), ["x", "y"], k=1)
    assert got == (w, best)


def test_answer_file_has_two_columns_in_order(spark, tmp_path):
    K.write_answers(spark.createDataFrame([("q2", "c d"), ("q1", "a b")], "query_id string, answer string"), f"file://{tmp_path}/a")
    with open(glob.glob(f"{tmp_path}/a/part-*.csv")[0]) as f:
        assert list(csv.reader(f)) == [["query_id", "answer"], ["q1", "a b"], ["q2", "c d"]]


def test_broken_splits_are_counted(spark):
    d = spark.createDataFrame([("a", "t", "P2", ["x"], False), ("a", "t", "P3", [], True)], "qid string, qtext string, part string, items array<string>, thinned boolean")
    assert {r["rule"]: r["violations"] for r in I.check_split(d).collect()} == {"qid repeated": 1, "held-out text repeated": 1, "text in P2 and P3": 1, "held-out instance without items": 1, "held-out instance thinned": 1}


def test_encoder_pairs_refuse_missing_texts(spark):
    items = spark.createDataFrame([("i", "t")], "item_id string, title string")
    good = spark.createDataFrame([("a nanny", "i")], "qtext string, item_id string")
    assert P.encoder_pairs(good, items, F.col("title"), "intfloat/multilingual-e5-base").collect() == [("query: a nanny", "passage: t")]
    with pytest.raises(PySparkException):
        P.encoder_pairs(spark.createDataFrame([("nan x", "i")], "qtext string, item_id string"), items, F.col("title"), "BAAI/bge-m3").collect()
    with pytest.raises(KeyError):
        X.prefixes("unknown/model")
