"""Query instances, leakage-safe parts, thinning, weights and the local corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..sources.intermediate import small, stored


def build_instances(train: DataFrame) -> DataFrame:
    """One row per normalised query key: qid, query, location, filters, category, delivery, qtext, items (sorted, distinct).

    Raw columns are the smallest non-null of the key's rows, a rule that no row order can change. Rows of equal raw
    columns are gathered first, so that each distinct query is normalised once, not each choice; their hash stands first as sorts compare it alone.
    """
    qid = X.short_md5(X.query_key(F.col("query"), F.col("location"), F.col("filters"), F.col("category"), F.col("delivery")))
    raw = ["query", "location", "filters", "category", "delivery"]
    once = train.groupBy(F.xxhash64(*raw).alias("_h"), *raw).agg(F.collect_set("item_id").alias("items")).withColumn("qid", qid)
    out = once.groupBy("qid").agg(*[F.min(c).alias(c) for c in raw], F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.withColumn("qtext", X.norm_text("query"))


def draw(seed: int, *parts: Column | str) -> Column:
    """A reproducible order: MD5 of the seed and the parts; the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def share_of(seed: int, *parts: Column | str) -> Column:
    """A reproducible number in [0, 1): the first eight hex digits of draw."""
    return F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def assign_parts(instances: DataFrame, n_p2: int, n_p3: int, seed: int = 42) -> DataFrame:
    """instances with `part`: one drawn instance of each of n_p2 + n_p3 drawn texts is P2 or P3, all else P1.

    Only distinct texts are ranked, over one ordered list; the top n are kept by a limit, not by a window over all.
    """
    texts = instances.select("qtext").distinct()
    top = texts.orderBy(draw(seed, "qtext"), "qtext").limit(n_p2 + n_p3)
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy(draw(seed, "qtext"), "qtext")))
    chosen = ranked.select("qtext", F.when(F.col("k") <= n_p2, "P2").otherwise("P3").alias("drawn"))
    one = instances.join(F.broadcast(chosen), "qtext").groupBy("qtext", "drawn").agg(F.min_by("qid", F.struct(draw(seed, "qid"), "qid")).alias("qid"))
    return instances.join(one.select("qid", "drawn"), "qid", "left").withColumn("part", F.coalesce("drawn", F.lit("P1"))).drop("drawn")


def thinned(parts: DataFrame, share: float = 0.3, seed: int = 7) -> DataFrame:
    """parts with `thinned`: P1 instances that hold any of the drawn share of the items of P2 and P3."""
    held = small(parts.filter("part <> 'P1'").select(F.explode("items").alias("item_id")).distinct().filter(share_of(seed, "item_id") < share))
    hit = parts.filter("part = 'P1'").select("qid", F.explode("items").alias("item_id")).join(held, "item_id", "left_semi").select("qid").distinct().withColumn("thinned", F.lit(True))
    hit = small(stored(hit, "hit"))
    return parts.join(hit, "qid", "left").withColumn("thinned", F.coalesce("thinned", F.lit(False)))


def history(parts: DataFrame) -> DataFrame:
    """What channels may learn from when P2 and P3 are held out."""
    return parts.filter("part = 'P1' and not thinned")


def location_weights(sample: DataFrame, target: DataFrame) -> DataFrame:
    """(location, weight): target share over sample share of each location of the sample; no target rows: 0."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.filter("location is not null").groupBy("location").agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("location", (F.col("n") / F.col("t")).alias(name))

    s, t = shares(sample, "s"), shares(target, "t")
    return s.join(t, "location", "left").select("location", (F.coalesce("t", F.lit(0.0)) / F.col("s")).alias("weight"))


def local_corpus(corpus: DataFrame, all_items: DataFrame, parts: DataFrame) -> DataFrame:
    """corpus and the relevant items of P2 and P3 that it lacks."""
    relevant = parts.filter("part <> 'P1'").select(F.explode("items").alias("item_id")).distinct()
    missing = relevant.join(corpus.select("item_id"), "item_id", "left_anti")
    return corpus.unionByName(all_items.join(missing, "item_id", "left_semi"))


def check_split(parts: DataFrame) -> DataFrame:
    """(rule, violations) of the split's invariants; all zero for a sound one."""
    held = parts.filter("part <> 'P1'")
    texts = held.groupBy("qtext").agg(F.count("*").alias("n"), F.count_distinct("part").alias("p"))
    rules = [
        parts.groupBy("qid").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("qid repeated").alias("rule"), "n"),
        texts.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("held-out text repeated").alias("rule"), "n"),
        texts.agg(F.count_if(F.col("p") > 1).alias("n")).select(F.lit("text in P2 and P3").alias("rule"), "n"),
        held.agg(F.count_if(F.size("items") == 0).alias("n")).select(F.lit("held-out instance without items").alias("rule"), "n"),
        held.agg(F.count_if(F.col("thinned")).alias("n")).select(F.lit("held-out instance thinned").alias("rule"), "n"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.select("rule", F.col("n").cast("long").alias("violations"))
