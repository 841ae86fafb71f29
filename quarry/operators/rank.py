"""Pair features, sampling of negatives, gradient-boosted rankers, the second stage and exports."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo, text as X
from . import channels as C
from .instances import draw, share_of

RECIPROCAL_MISSING = 1_000_000


def pool(candidates: DataFrame, channels: list[str], weights: dict[str, float], max_rank: int = 200, k_rrf: int = 60) -> DataFrame:
    """One row per pair that any channel ranks within max_rank: rank_<c> and score_<c> of all channels, n_channels, rrf, rrf_rank, pool_size.

    One conditional aggregation instead of a join per channel; ranks beyond max_rank stay visible.
    """
    per = [F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"rank_{c}") for c in channels]
    per += [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"score_{c}") for c in channels]
    d = candidates.filter(F.col("channel").isin(channels)).groupBy("qid", "item_id").agg(*per, F.min("rank").alias("best"), F.count_distinct(F.when(F.col("rank") <= max_rank, F.col("channel"))).alias("n_channels")).filter(F.col("best") <= max_rank)
    rrf = F.lit(0.0)
    for c in channels:
        rrf = rrf + F.lit(float(weights.get(c, 0))) / (k_rrf + F.coalesce(f"rank_{c}", F.lit(RECIPROCAL_MISSING)))
    w = Window.partitionBy("qid")
    d = d.withColumn("rrf", F.round(rrf, 9)).withColumn("rrf_rank", F.row_number().over(w.orderBy(F.desc("rrf"), "item_id")).cast("long"))
    return d.withColumn("pool_size", F.count("*").over(w)).drop("best")


def item_features(items: DataFrame) -> DataFrame:
    # greatest skips nulls, so a missing price must be kept missing.
    price = F.when(F.col("price").isNotNull(), F.log1p(F.greatest("price", F.lit(0.0))))
    return items.select("item_id", "location", "microcat", "lat", "lon", "rating", price.alias("log_price"), F.log1p("reviews").alias("log_reviews"), F.length("title").cast("long").alias("title_chars"), F.length("params").cast("long").alias("params_chars"))


def add_features(pairs: DataFrame, queries: DataFrame, items: DataFrame, pop: DataFrame, probs: DataFrame) -> DataFrame:
    """Query, item, distance, popularity and category features of each pair; texts never travel on pair rows."""
    q = queries.select("qid", F.col("location").alias("q_location"), X.word_count(F.col("query")).alias("q_words"), (F.coalesce(F.length("filters"), F.lit(0)) > 0).cast("int").alias("q_filters"))
    centre = geo.centroids(items).select(F.col("location").alias("q_location"), "c_lat", "c_lon")
    d = pairs.join(q.join(centre, "q_location", "left"), "qid").join(item_features(items), "item_id").join(pop.select("item_id", "pop_share"), "item_id", "left").join(probs.select("qid", "microcat", F.col("p").alias("p_mc"), "mc_rank"), ["qid", "microcat"], "left")
    d = d.withColumn("loc_match", F.coalesce((F.col("location") == F.col("q_location")).cast("int"), F.lit(0)))
    d = d.withColumn("dist_km", F.round(geo.haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")), 6))
    return d.withColumn("log_pop", F.round(F.log1p(1e5 * F.coalesce("pop_share", F.lit(0.0))), 6)).withColumn("p_mc", F.coalesce("p_mc", F.lit(0.0))).drop("c_lat", "c_lon", "pop_share", "lat", "lon")


def sample_negatives(pairs: DataFrame, keep_rank: int = 100, expected: int = 100, seed: int = 3) -> DataFrame:
    """Positives, the first keep_rank by fusion, and about `expected` of each query's other negatives."""
    tail = (F.col("label") == 0) & (F.col("rrf_rank") > keep_rank)
    d = pairs.withColumn("_tail", F.sum(tail.cast("int")).over(Window.partitionBy("qid")))
    return d.filter(~tail | (share_of(seed, "qid", "item_id") * F.col("_tail") < expected)).drop("_tail")


def fold(n: int, seed: int = 5):
    """Fold of a query, by hash."""
    return F.floor(share_of(seed, "qid") * n).cast("int")


class Ranker:
    """GBT classifier over numeric columns; missing values become a value of their own below all others."""

    def __init__(self, features: list[str], trees: int = 40, depth: int = 6, rate: float = 0.08, seed: int = 42):
        self.features, self.seed, self.model = features, seed, None
        self.gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)

    def _assembled(self, df: DataFrame) -> DataFrame:
        filled = df.select("*", *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(-1e6)).alias(f"_f{i}") for i, f in enumerate(self.features)])
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.features))], outputCol="features").transform(filled)

    def fit(self, df: DataFrame, validation: str | None = None) -> Ranker:
        """df has label, the features, maybe weight, maybe a boolean column that marks validation rows (early stopping).

        Without a row nothing can be learnt: all pairs then score 0.
        """
        d = df.withColumn("label", F.col("label").cast("double"))
        if "weight" not in d.columns:
            d = d.withColumn("weight", F.lit(1.0))
        if validation:
            self.gbt.setValidationIndicatorCol(validation)
        self.model = None if d.isEmpty() else self.gbt.fit(self._assembled(d))
        return self

    @property
    def trees(self) -> int:
        return self.model.getNumTrees if self.model else 0

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("score", F.lit(0.0))
        out = self.model.transform(self._assembled(df))
        return out.select(*df.columns, F.round(vector_to_array("probability")[1], C.DECIMALS).alias("score"))


def predict_top(scored: DataFrame, n: int = 50) -> DataFrame:
    """(qid, item_id, score, rank) of the n best."""
    return C.top_k(scored, n, "ranker").drop("channel")


def out_of_fold(df: DataFrame, features: list[str], n: int = 5, **kw) -> DataFrame:
    """df with the score of a ranker that never saw the row's query; one fit a fold."""
    d, out = df.withColumn("_fold", fold(n)), None
    for k in range(n):
        part = Ranker(features, **kw).fit(d.filter(F.col("_fold") != k)).score(d.filter(F.col("_fold") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def stage2_features(top: DataFrame, ce: DataFrame, threshold: float, n: int = 5) -> DataFrame:
    """top (qid, item_id, first_score, first_rank) with external scores: gap to the best, rank, mean of the best n, share above a threshold."""
    d = top.join(ce.select("qid", "item_id", "ce_score"), ["qid", "item_id"])
    q = Window.partitionBy("qid")
    d = d.withColumn("ce_rank", F.row_number().over(q.orderBy(F.desc("ce_score"), "first_rank")).cast("long")).withColumn("ce_gap", F.round(F.col("ce_score") - F.max("ce_score").over(q), 9))
    d = d.withColumn("ce_top_mean", F.round(F.avg(F.when(F.col("ce_rank") <= n, F.col("ce_score"))).over(q), 6))
    return d.withColumn("ce_share", F.round(F.avg((F.col("ce_score") > threshold).cast("double")).over(q), 6))


def ensemble(scored: list[DataFrame]) -> DataFrame:
    """(qid, item_id, score): minus the mean of each model's rank."""
    out = None
    for s in scored:
        r = s.select("qid", "item_id", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item_id")).alias("r"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("qid", "item_id").agg((-F.avg("r")).alias("score"))


def cap_pairs(pairs: DataFrame, per_item: int = 10, per_anchor: int = 50, seed: int = 11) -> DataFrame:
    """At most per_item rows of an item, then at most per_anchor of a text, both in drawn order."""
    order = [draw(seed, "qtext", "item_id"), F.col("qtext"), F.col("item_id")]
    d = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rn") <= per_item)
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("qtext").orderBy(*order))).filter(F.col("rn") <= per_anchor).drop("rn")


def hard_negatives(ranked: DataFrame, positives: DataFrame, low: int = 10, high: int = 100, n: int = 4, seed: int = 13) -> DataFrame:
    """(qid, item_id): up to n drawn items of ranks low to high that are no known positive of the query's text."""
    d = ranked.filter(F.col("rank").between(low, high)).join(positives.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(draw(seed, "qid", "item_id"), "item_id"))).filter(F.col("rn") <= n).select("qid", "item_id", "rank")


def text_positives(instances: DataFrame) -> DataFrame:
    """(qtext, positives): all items ever chosen under a text."""
    return instances.select("qtext", F.explode("items").alias("item_id")).distinct().groupBy("qtext").agg(F.array_sort(F.collect_list("item_id")).alias("positives"))


def answers(top: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): the ids of each query in rank order, split by one space."""
    j = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]), " ").alias("answer"))
    return queries.select("qid").join(j, "qid").select(F.col("qid").alias("query_id"), "answer")


def write_answers(answer: DataFrame, path: str) -> None:
    """CSV of exactly two columns in one file; an answer table has one row a query, which is what fits one file."""
    answer.select("query_id", "answer").orderBy("query_id").coalesce(1).write.mode("overwrite").csv(path, header=True)
