"""Metrics, bootstrap, tuning of fusion weights, calibration, diagnostics and validation of answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def recall_per_query(truth: DataFrame, predictions: DataFrame, k: int | None = 50) -> DataFrame:
    """(qid, recall): share of a query's relevant items among its first k predictions; no prediction counts as 0.

    truth (qid, item_id), predictions (qid, item_id, rank). Cut before repeated predictions are dropped.
    """
    p = predictions if k is None else predictions.filter(F.col("rank") <= k)
    p = p.select("qid", "item_id").distinct().withColumn("hit", F.lit(1))
    t = truth.select("qid", "item_id").distinct()
    return t.join(p, ["qid", "item_id"], "left").groupBy("qid").agg(F.round(F.count("hit") / F.count("*"), 9).alias("recall"))


def mean_recall(per_query: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(recall): mean, or weighted mean by (qid, weight); a query without a weight is an error."""
    if weights is None:
        return per_query.agg(F.avg("recall").alias("recall"))
    j = per_query.join(weights.select("qid", "weight"), "qid", "left")
    w = F.when(F.col("weight").isNull(), F.raise_error(F.lit("query without a weight"))).otherwise(F.col("weight"))
    return j.select("recall", w.cast("double").alias("w")).agg((F.sum(F.col("recall") * F.col("w")) / F.sum("w")).alias("recall"))


def effective_size(weights: DataFrame) -> DataFrame:
    """(n_eff, max_weight): squared sum over sum of squares."""
    return weights.agg((F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("n_eff"), F.max("weight").alias("max_weight"))


def paired_bootstrap(a: DataFrame, b: DataFrame, n: int = 1000, seed: int = 42) -> tuple[float, float, float]:
    """(mean difference, 2.5 % and 97.5 % quantile) of a's recall less b's over common queries.

    Queries are grouped by their difference on the cluster, so what reaches the driver is one row per distinct value
    (recalls are ratios of small numbers), and a resample is a multinomial draw over those.
    """
    d = a.join(b.select("qid", F.col("recall").alias("other")), "qid").groupBy(F.round(F.col("recall") - F.col("other"), 9).alias("d")).count().orderBy("d").collect()
    value, count = np.array([r["d"] for r in d]), np.array([r["count"] for r in d])
    if not len(value):
        return (0.0, 0.0, 0.0)
    total = int(count.sum())
    draws = np.random.default_rng(seed).multinomial(total, count / total, size=n) @ value / total
    lo, hi = np.percentile(draws, [2.5, 97.5])
    return float((value * count).sum() / total), float(lo), float(hi)


def pool_recall(truth: DataFrame, candidates: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, recall): recall of the union of all channels cut at each depth, in one pass."""
    best = candidates.groupBy("qid", "item_id").agg(F.min("rank").alias("rank"))
    j = truth.select("qid", "item_id").distinct().join(best, ["qid", "item_id"], "left")
    per = j.groupBy("qid").agg(*[(F.count_if(F.col("rank") <= d) / F.count("*")).alias(f"d{d}") for d in depths])
    row = per.agg(*[F.avg(f"d{d}").alias(f"d{d}") for d in depths])
    return row.select(F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("depth"), F.round(f"d{d}", 9).alias("recall")) for d in depths])).alias("r")).select("r.*")


def tune_rrf(truth: DataFrame, candidates: DataFrame, channels: list[str], grid: tuple = (0, 0.25, 0.5, 1, 2, 4), passes: int = 3, max_rank: int = 200, k: int = 50, k_rrf: int = 60) -> tuple[dict[str, float], float]:
    """Coordinate ascent of fusion weights, from 1 each; a change must gain more than 1e-9.

    The contributions of all channels are pivoted once and cached; a step scores the whole grid of one channel in one
    job by exploding the trial weights. Queries without candidates stay in the denominator.
    """
    pivot = candidates.filter((F.col("rank") <= max_rank) & F.col("channel").isin(channels)).groupBy("qid", "item_id").pivot("channel", channels).agg(F.min("rank"))
    for c in channels:
        pivot = pivot.withColumn(c, F.coalesce(1.0 / (k_rrf + F.col(f"`{c}`")), F.lit(0.0)))
    relevant = truth.select("qid", "item_id").distinct()
    totals = relevant.groupBy("qid").agg(F.count("*").alias("total"))
    n = totals.count()
    marked = pivot.join(relevant.withColumn("label", F.lit(1)), ["qid", "item_id"], "left").join(totals, "qid").persist()

    def score(weights: dict[str, float], channel: str, values: list[float]) -> list[float]:
        fixed = F.lit(0.0)
        for c in channels:
            if c != channel:
                fixed = fixed + F.lit(float(weights[c])) * F.col(f"`{c}`")
        trials = marked.select("qid", "item_id", "label", "total", fixed.alias("fixed"), F.col(f"`{channel}`").alias("x"), F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("t", "w"))
        s = trials.withColumn("s", F.round(F.col("fixed") + F.col("w") * F.col("x"), 9)).filter("s > 0")
        top = s.withColumn("rn", F.row_number().over(Window.partitionBy("t", "qid").orderBy(F.desc("s"), "item_id"))).filter(F.col("rn") <= k)
        got = top.groupBy("t", "qid").agg((F.sum("label") / F.first("total")).alias("r")).groupBy("t").agg(F.sum("r").alias("r")).collect()
        by = {r["t"]: float(r["r"] or 0) / max(n, 1) for r in got}
        return [by.get(t, 0.0) for t in range(len(values))]

    weights = {c: 1.0 for c in channels}
    best = score(weights, channels[0], [1.0])[0]
    for _ in range(passes):
        before = best
        for c in channels:
            for v, r in zip(grid, score(weights, c, list(grid))):
                if r > best + 1e-9:
                    best, weights[c] = r, float(v)
        if best <= before + 1e-9:
            break
    marked.unpersist()
    return weights, best


#: Ranges of values a feature, whose sums are broadcast.
RANGES = 200


def single_auc(rows: DataFrame, features: list[str], label: Column) -> DataFrame:
    """(feature, auc): max(a, 1 - a) of each feature alone, ties sharing their mean rank; nulls left out.

    Counts per distinct value are accumulated in ranges of about equal numbers of values: first the sums of the ranges
    below, which are few, then within a range; so no feature's values meet in one task.
    """
    stack = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    long = rows.select(label.cast("int").alias("y"), F.expr(f"stack({len(features)}, {stack}) as (feature, v)")).filter("v is not null and y is not null")
    at = long.groupBy("feature", "v").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    edges = at.groupBy("feature").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)]).alias("edges"))
    at = at.join(F.broadcast(edges), "feature").withColumn("part", F.expr("size(filter(edges, e -> e < v))")).drop("edges")
    sums = at.groupBy("feature", "part").agg(F.sum("neg").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.join(F.broadcast(sums.select("feature", "part", before.alias("before"))), ["feature", "part"])
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("feature", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = at.withColumn("below", F.col("before") + within).groupBy("feature").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("a"))
    return auc.select("feature", F.round(F.greatest("a", 1 - F.col("a")), 9).alias("auc"))


def bucket(value: Column, edges: list[float]) -> Column:
    """Label of the half-open bin (edges[i], edges[i + 1]] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges[:-1], edges[1:]):
        out = F.when((value > lo) & (value <= hi), F.lit(f"({lo:g}, {hi:g}]")).otherwise(out)
    return out


def validate(answers: DataFrame, query_ids: DataFrame, corpus_ids: DataFrame, k: int = 50) -> DataFrame:
    """(rule, violations) for an answer table (query_id, answer: k ids split by one space).

    Answers are read twice: once a query for the rules on rows, once an id for the rule on the corpus.
    """
    a = answers.select("query_id", F.col("answer").isNull().alias("none"), F.split("answer", " ").alias("ids"))
    wrong = F.coalesce(F.col("none") | (F.size("ids") != k), F.lit(True))
    twice = F.coalesce(F.size(F.array_distinct("ids")) != F.size("ids"), F.lit(False))
    per = a.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(twice).alias("twice"))
    asked = query_ids.select("query_id").distinct().withColumn("asked", F.lit(1))
    rules = {
        "columns": F.max(F.lit(int(answers.columns != ["query_id", "answer"]))),
        "query id repeated": F.count_if(F.col("n") > 1),
        "query id unknown": F.count_if(F.col("n").isNotNull() & F.col("asked").isNull()),
        "query id missing": F.count_if(F.col("asked").isNotNull() & F.col("n").isNull()),
        "number of ids": F.sum("wrong"),
        "id repeated in an answer": F.sum("twice"),
    }
    row = per.join(asked, "query_id", "full_outer").agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"r{i}") for i, v in enumerate(rules.values())])
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)])).alias("r")).select("r.*")
    known = corpus_ids.select("item_id").distinct()
    outside = a.select(F.explode("ids").alias("item_id")).join(known, "item_id", "left_anti").agg(F.count("*").alias("violations"))
    return rows.unionByName(outside.select(F.lit("id outside the corpus").alias("rule"), "violations"))


def same_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_only, right_only, repeated, null_scores): all zero if b scores exactly the pairs of a, once each."""
    x, y = a.select("qid", "item_id").distinct().withColumn("l", F.lit(1)), b.groupBy("qid", "item_id").agg(F.count("*").alias("n"), F.count_if(F.col("ce_score").isNull()).alias("nulls"))
    j = x.join(y, ["qid", "item_id"], "full_outer")
    return j.agg(F.count_if(F.col("n").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_scores"))


def profile(df: DataFrame) -> DataFrame:
    """(column, null_share, blank_share) in one pass over the table."""
    row = df.agg(*[F.struct(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("n"), F.avg(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) == "", F.lit(False)).cast("double")).alias("b")).alias(f"p{i}") for i, c in enumerate(df.columns) if not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct"))])
    names = [c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct"))]
    pos = [i for i, c in enumerate(df.columns) if c in names]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.round(f"p{i}.n", 9).alias("null_share"), F.round(f"p{i}.b", 9).alias("blank_share")) for n, i in zip(names, pos)])).alias("r")).select("r.*")
