"""What must not grow faster than the input: work a row, exchanges, memory of Python workers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import analysis as A, channels as C, exports as P, instances as I
from quarry.plans import more, queries

TRAIN = "query string, location long, filters string, category int, delivery boolean, item_id string"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_each_distinct_query_is_normalised_once(spark):
    rows = [("A b", 1, None, 1, True, "x"), ("A b", 1, None, 1, True, "y"), ("a  B", 1, "", 1, True, "y"), ("a  B", 1, "", 1, True, "z"), ("A b", 2, None, 1, True, "x")]
    d = I.build_instances(spark.createDataFrame(rows, TRAIN))
    assert sorted((r["query"], r["location"], r["filters"], r["items"]) for r in d.collect()) == [("A b", 1, "", ["x", "y", "z"]), ("A b", 2, None, ["x"])]
    lines = plan(d).splitlines()
    assert max(i for i, x in enumerate(lines) if "md5(" in x) <= min(i for i, x in enumerate(lines) if "collect_set(" in x)  # not below it


def test_logs_sum_by_item_without_a_second_exchange(spark):
    q = spark.createDataFrame([("q", 1, "a b", ["i1"])], "qid string, location long, qtext string, items array<string>")
    h = spark.createDataFrame([("a b", ["i1", "i2"]), ("a b", ["i1"]), ("zz", ["i3"])], "qtext string, items array<string>")
    near = spark.createDataFrame([("q", "a b", 0.5)], "qid string, htext string, sim double")
    d = C.logs(q, near, h, F.broadcast(spark.createDataFrame([("i1", 1), ("i2", 2), ("i3", 1)], "item_id string, location long")))
    got = {r["item_id"]: r["score"] for r in d.collect()}
    assert got == {"i1": 1.098612, "i2": 0.346574}
    assert not any("hashpartitioning(qid" in x and "item_id" in x for x in plan(d, "executedPlan").splitlines())


@pytest.mark.parametrize("parts", [(), ("train",), ("stop",), ("choose",), ("train", "stop", "choose")])
def test_training_where_few_queries_have_a_relevant_pair(spark, parts):
    at = spark.range(60).select(F.concat(F.lit("q"), "id").alias("qid")).withColumn("u", I.share_of(21, "qid")).collect()
    part = {r["qid"]: "train" if r["u"] < 0.6 else "stop" if r["u"] < 0.8 else "choose" for r in at}
    rows = [(q, f"i{k}", int(k == 0 and p in parts), k + 1, float(k)) for q, p in part.items() for k in range(4)]
    pairs = spark.createDataFrame(rows, "qid string, item_id string, label int, rrf_rank long, f double")
    truth = pairs.filter("item_id = 'i0'").select("qid", "item_id")
    ranker, best = A.train(pairs, truth, ["f"], [{"trees": 2, "depth": 1}], k=1)
    assert best["recall"] == 1.0 and ranker.score(pairs).count() == len(rows)
    assert (ranker.model is None) == (not parts) and (best["trees"] > 0) == bool({"train", "stop"} & set(parts))


def test_rerank_pairs_makes_the_instances_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(I, "build_instances", lambda t, f=I.build_instances: calls.append(1) or f(t))
    more.o146(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


WORDS = "aa bb cc dd ee ff gg hh ii jj".split()


def _texts(spark, n, seed):
    rng = np.random.RandomState(seed)
    return [(f"d{k % (n - 3)}", " ".join(rng.choice(WORDS, rng.randint(0, 12)))) for k in range(n)] + [("none", None), ("other", "zz Ё1 _x y")]


def test_bm25_against_brute_force_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Queries in several blocks, documents in several slices, equal scores, texts of one id and null texts."""
    monkeypatch.setattr(C, "QUERY_BLOCK", 2, raising=False)
    monkeypatch.setattr(C, "SLICE", 7, raising=False)
    docs = [(i, t) for i, t in _texts(spark, 60, 1)]
    docs = [(i, t) for k, (i, t) in enumerate(docs) if i not in {x for x, _ in docs[:k]}] + [("d1", dict(reversed(docs))["d1"])]
    asked = [("q1", "aa bb bb"), ("q2", "cc"), ("q3", "zz е1 dd"), ("q4", ""), ("q5", "aa jj ii")]
    d, q, t = spark.createDataFrame(docs, "item_id string, text string").repartition(3), spark.createDataFrame(asked, "qid string, text string"), X.tokens(F.col("text"))
    lists = [(i, [w for w in (x or "").lower().replace("ё", "е").split() if len(w) > 1]) for i, x in docs]
    avg, length, tf = sum(len(x) for _, x in lists) / len(lists), dict(lists), {}
    for i, x in lists:
        for w in x:
            tf[i, w] = tf.get((i, w), 0) + 1
    df = {w: sum(k[1] == w for k in tf) for _, w in tf}
    want, every = {}, {}
    for qid, x in asked:
        s = {}
        for w in [w for w in x.split() if len(w) > 1]:
            for i in length:
                if (i, w) in tf:
                    idf = math.log(1 + (len(lists) - df[w] + 0.5) / (df[w] + 0.5))
                    s[i] = s.get(i, 0) + idf * tf[i, w] / (tf[i, w] + 1.5 * (0.25 + 0.75 * len(length[i]) / avg))
        every |= {(qid, i): round(v, 6) for i, v in s.items()}
        want |= {(qid, i): (r + 1, round(s[i], 6)) for r, i in enumerate(sorted(s, key=lambda i: (-round(s[i], 6), i))[:9])}
    top = C.bm25(q, d, t, t, 9, "bm25")
    assert {(r["qid"], r["item_id"]): (r["rank"], r["score"]) for r in top.collect()} == want
    assert not any("hashpartitioning(qid" in x and "item_id" in x for x in plan(top, "executedPlan").splitlines())
    assert {(r["qid"], r["item_id"]): r["score"] for r in C.bm25_scores(q, d, t, t).collect()} == pytest.approx(every)
    pairs = spark.createDataFrame([*list(every)[:5], ("q4", "d1")], "qid string, item_id string")
    assert {(r["qid"], r["item_id"]): r["score"] for r in C.bm25_pairs(q, d, pairs, t, t).collect()} == pytest.approx(dict(list(every.items())[:5]) | {("q4", "d1"): 0.0})


def test_pair_scores_share_one_index(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(C, "bm25_index", lambda *a, f=C.bm25_index, **b: calls.append(1) or f(*a, **b))
    queries.QUERIES["o91_bm25_pairs"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("text", [None, "", "Ё ё", "ab\x1fcd e\x85fg", "a_b 1२ x-yz", " À la ÇA. ", "..."])
def test_tokens_are_those_of_the_normalised_text(spark, text):
    d = spark.createDataFrame([(text,)], "v string")
    r = d.select(X.tokens(F.col("v")).alias("a"), F.regexp_extract_all(X.norm_text("v"), F.lit(f"({X.TOKEN})"), 1).alias("b")).first()
    assert r["a"] == r["b"]


def _unit(spark, n, seed):
    rng = np.random.RandomState(seed)
    return [(f"v{k}", [float(x) for x in rng.randint(-2, 3, 4)], int(k % 3)) for k in range(n)]


def test_a_task_keeps_k_rows_of_a_query(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 16, raising=False)
    rows, asked = _unit(spark, 300, 1), _unit(spark, 5, 2)
    v, q = spark.createDataFrame(rows, "item_id string, embedding array<float>, location long"), spark.createDataFrame(asked, "qid string, embedding array<float>, location long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        sent, top_k = [], C.top_k
        monkeypatch.setattr(C, "top_k", lambda s, *a, **b: sent.append(s.count()) or top_k(s, *a, **b))
        got = {(r["qid"], r["item_id"], r["rank"]) for r in C.dense(q, v.coalesce(1), 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == {(a, i, r + 1) for a, x, _ in asked for r, (_, i) in enumerate(sorted((-dot(x, y), i) for i, y, _ in rows)[:7])}
    assert sent == [5 * 7]


def test_local_vectors_meet_queries_by_place_without_pairs(spark):
    rows, asked = _unit(spark, 60, 3), _unit(spark, 6, 4)
    q = spark.createDataFrame(asked + [("nowhere", [1.0] * 4, 9), ("null", [1.0] * 4, None)], "qid string, embedding array<float>, location long")
    v = spark.createDataFrame([r[:2] for r in rows], "item_id string, embedding array<float>")
    places = spark.createDataFrame([(i, p, 50.0 + 0.3 * p, 30.0) for i, _, p in rows], "item_id string, location long, lat double, lon double")
    top = C.dense_local(q, places, v, k=5, km=40.0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(a, i, r + 1) for a, x, p in asked for r, (_, i) in enumerate(sorted((-dot(x, y), i) for i, y, o in rows if abs(o - p) < 2)[:5])}
    assert {(r["qid"], r["item_id"], r["rank"]) for r in top.collect()} == want
    assert "zip_with" not in plan(top)


def test_given_pairs_are_sorted_without_the_queries_vectors(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_BLOCK", 2, raising=False)
    v, q = _unit(spark, 20, 5), _unit(spark, 5, 6)
    pairs = spark.createDataFrame([(a, i) for a, _, _ in q for i, _, _ in v], "qid string, item_id string")
    d = C.pair_cosine(pairs, spark.createDataFrame([x[:2] for x in q], "qid string, embedding array<float>"), spark.createDataFrame([x[:2] for x in v], "item_id string, embedding array<float>"))
    assert {(r["qid"], r["item_id"]): r["score"] for r in d.collect()} == {(a, i): sum(s * t for s, t in zip(x, y)) for a, x, _ in q for i, y, _ in v}
    assert plan(d, "sparkPlan").count("BroadcastHashJoin") == 3


def test_filters_are_compared_once_a_combination(spark, monkeypatch):
    side = spark.createDataFrame([("q", "Key a"), ("r", None), ("s", "Key b Key a")], "qid string, filters string")
    items = spark.createDataFrame([("i", "Key a"), ("j", None), ("k", "Key b")], "item_id string, params string")
    pairs = spark.createDataFrame([(q, i) for q in ("q", "r", "s", "unknown") for i in ("i", "j", "k", "unknown")], "qid string, item_id string")
    want = {(q, i, v, int(v == 1), int(v == 0)) for q, hits in (("q", "i"), ("r", None), ("s", "ik"), ("unknown", None)) for i in ("i", "j", "k", "unknown") for v in [None if hits is None else int(i in hits)]}
    for most in (0, 1_000_000):
        monkeypatch.setattr(P, "COMBINATIONS", most, raising=False)
        d = P.filter_features(pairs, side, items, {"Key": "k"}, ["Key"])
        assert d.columns == ["item_id", "qid", "flt_k", "flt_match", "flt_miss"]
        assert {(r["qid"], r["item_id"], *r[2:]) for r in d.collect()} == want
    assert "SortMergeJoin" not in (text := plan(d, "sparkPlan")) and "[_f#" in text
