import math

import pytest

from quarry.functions import text as X
from quarry.operators import channels as C, evaluate as E, instances as I, rank as K
from pyspark.sql import functions as F


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw", [None, "", "Ё ё", "a\t\n b", "a b", "a\x1fb", "a\x85b", " x "])
def test_norm_text(spark, raw):
    assert one(spark, X.norm_text, raw) == " ".join((raw or "").lower().replace("ё", "е").split())


def test_char_ngrams_of_short_words(spark):
    assert one(spark, lambda c: X.char_ngrams(c), "a bc") == [" a ", " bc", "bc ", " bc "]


def test_filter_values(spark):
    keys = ["Тип услуги автосервиса", "Вид услуги", "Тип услуги"]
    text = "Вид услуги Ремонт Вид услуги Уборка Тип услуги автосервиса Шины Тип услуги Окна"
    assert one(spark, lambda c: X.filter_values(c, "Вид услуги", keys), text) == ["Ремонт", "Уборка"]
    assert one(spark, lambda c: X.filter_values(c, "Тип услуги", keys), text) == ["Окна"]
    assert one(spark, lambda c: X.filter_values(c, "Тип услуги", keys), None) == []


def test_city(spark):
    assert one(spark, X.city_of, "Московская область, г. Химки, ул. Мира") == "Химки"
    assert one(spark, X.city_of, "Московская область, ул. Мира") == "Московская область"
    assert one(spark, X.city_of, None) is None


def test_prefixes():
    assert X.prefixes("intfloat/multilingual-e5-base") == ("query: ", "passage: ")
    with pytest.raises(KeyError):
        X.prefixes("unknown")


def recall(spark, truth, pred, k=50):
    t = spark.createDataFrame(truth, "qid string, item_id string")
    p = spark.createDataFrame(pred, "qid string, item_id string, rank long")
    return {r["qid"]: r["recall"] for r in E.recall_per_query(t, p, k).collect()}


def test_recall(spark):
    assert recall(spark, [("q", "a"), ("q", "b")], [("q", "a", 1), ("q", "x", 2)]) == {"q": 0.5}
    assert recall(spark, [("q1", "a"), ("q2", "b")], [("q1", "a", 1)]) == {"q1": 1.0, "q2": 0.0}
    assert recall(spark, [("q", "a")], [("q", f"m{i}", i + 1) for i in range(50)] + [("q", "a", 51)]) == {"q": 0.0}


def test_weighted_recall(spark):
    per = spark.createDataFrame([("q1", 1.0), ("q2", 0.0)], "qid string, recall double")
    w = spark.createDataFrame([("q1", 3.0), ("q2", 1.0)], "qid string, weight double")
    assert E.mean_recall(per, w).first()[0] == 0.75
    with pytest.raises(Exception, match="weight"):
        E.mean_recall(per, w.limit(1)).collect()


def test_bootstrap(spark):
    make = lambda f: spark.createDataFrame([(str(i), float(f(i))) for i in range(200)], "qid string, recall double")
    assert E.paired_bootstrap(make(lambda i: 1), make(lambda i: 0)) == (1.0, 1.0, 1.0)
    d, lo, hi = E.paired_bootstrap(make(lambda i: i % 2), make(lambda i: 1 - i % 2))
    assert d == 0 and lo < 0 < hi


def test_rrf(spark):
    rows = [("q", "a", 1, "x"), ("q", "b", 2, "x"), ("q", "b", 1, "y"), ("q", "c", 1, "z")] + [("q", f"p{i:02d}", i + 1, "pop_loc") for i in range(50)]
    c = spark.createDataFrame([(q, i, 0.0, r, ch) for q, i, r, ch in rows], "qid string, item_id string, score double, rank long, channel string")
    got = [r["item_id"] for r in C.rrf(c, {"x": 1, "y": 1, "z": 0}).orderBy("rank").collect()]
    assert len(set(got)) == 50 and got[:4] == ["b", "a", "p00", "p01"] and "c" not in got


def test_split(spark):
    rows = [(f"q{t}-{i}", f"text {t}", [f"i{t}"]) for t in range(300) for i in range(1 + t % 4)]
    parts = lambda r: {x["qid"]: x["part"] for x in I.assign_parts(spark.createDataFrame(r, "qid string, qtext string, items array<string>"), 40, 30).collect()}
    got = parts(rows)
    assert got == parts(rows[::-1])
    assert [list(got.values()).count(p) for p in ("P2", "P3")] == [40, 30]
    texts = {p: {k.split("-")[0] for k, v in got.items() if v == p} for p in ("P2", "P3")}
    assert len(texts["P2"]) == 40 and not texts["P2"] & texts["P3"]


def test_thinning(spark):
    d = spark.createDataFrame([("1", ["a"], "P1"), ("2", ["b"], "P1"), ("3", ["z"], "P1"), ("4", ["a"], "P2"), ("5", ["b"], "P3")], "qid string, items array<string>, part string")
    flags = lambda share: [r["thinned"] for r in I.thinned(d, share).orderBy("qid").collect()]
    assert flags(1.0) == [True, True, False, False, False] and not any(flags(0.0))


@pytest.mark.parametrize("change,rule", [
    (lambda a: a, None), (lambda a: [(a[0][0].upper(), a[0][1]), a[1]], "query id unknown"), (lambda a: [(a[0][0], a[0][1].replace(" ", "  ", 1)), a[1]], "number of ids"),
    (lambda a: [(a[0][0], " ".join(["i1"] * 2 + a[0][1].split()[2:])), a[1]], "id repeated in an answer"), (lambda a: [(a[0][0], a[0][1].replace("i49", "zz")), a[1]], "id outside the corpus"),
    (lambda a: [(a[0][0], a[0][1].rsplit(" ", 1)[0]), a[1]], "number of ids"), (lambda a: a + [a[0]], "query id repeated"),
])
def test_validate(spark, change, rule):
    good = [(q, " ".join(f"i{k}" for k in range(50))) for q in ("qa", "qb")]
    bad = {r["rule"] for r in E.validate(spark.createDataFrame(change(good), "query_id string, answer string"), spark.createDataFrame([("qa",), ("qb",)], "query_id string"), spark.createDataFrame([(f"i{k}",) for k in range(200)], "item_id string")).collect() if r["violations"]}
    assert rule in bad if rule else not bad


def test_bm25_edge_cases(spark):
    q = spark.createDataFrame([("1", "x"), ("2", "cat cat unknown")], "qid string, text string")
    d = spark.createDataFrame([("a", "cat"), ("b", "dog cat"), ("c", "")], "item_id string, text string")
    t = X.tokens(F.col("text"))
    got = [(r["qid"], r["item_id"]) for r in C.bm25(q, d, t, t, 5, "bm25").orderBy("qid", "rank").collect()]
    assert got == [("2", "a"), ("2", "b")]


def test_price_null_stays_null(spark):
    d = spark.createDataFrame([("a", None), ("b", -1.0)], "item_id string, price double")
    for c in ("location", "microcat", "lat", "lon", "rating", "reviews"):
        d = d.withColumn(c, F.lit(1.0))
    d = d.withColumn("title", F.lit("t")).withColumn("params", F.lit("p"))
    assert {r["item_id"]: r["log_price"] for r in K.item_features(d).collect()} == {"a": None, "b": 0.0}


def test_negatives_keep_positives(spark):
    d = spark.createDataFrame([("q", str(i), int(i % 50 == 0), i) for i in range(1, 1001)], "qid string, item_id string, label int, rrf_rank long")
    got = K.sample_negatives(d).collect()
    assert sum(r["label"] for r in got) == 20 and all(any(r["rrf_rank"] == k for r in got) for k in range(1, 101)) and math.isclose(len(got), 218, abs_tol=60)
