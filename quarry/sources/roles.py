"""Scans, and the tables in the roles that retrieval needs: history, items, queries, candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None, where: Column | str | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Parquet scan with pruned columns, pushed filter, decimals as doubles, NaN as null and ids that must not be null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*columns)
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        if kind.startswith("decimal"):
            col = col.cast("double")
        if kind in ("double", "float"):
            col = F.nanvl(col, F.lit(None).cast(kind))
        if c in ids:
            col = F.when(col.isNull(), F.raise_error(F.lit(f"null id in {name}.{c}"))).otherwise(col)
        out.append(col.alias(c))
    return df.select(*out)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, params, microcat, price, location, reviews (with nulls), rating, lat, lon; one row a part."""
    p = load(spark, sf_dir, "part", ids=["p_partkey"])
    key, loc = F.col("p_partkey"), F.pmod("p_partkey", F.lit(25))
    return p.select(
        key.cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type").alias("params"),
        F.col("p_type").alias("microcat"),
        F.col("p_retailprice").alias("price"),
        loc.cast("long").alias("location"),
        F.when(key % 11 != 0, F.col("p_size").cast("long")).alias("reviews"),
        (F.lit(3) + F.pmod(key, F.lit(20)) / 10.0).alias("rating"),
        (F.lit(50) + loc * 0.3 + F.pmod(key, F.lit(7)) * 0.05).alias("lat"),
        (F.lit(30) + loc * 0.4 + F.pmod(key, F.lit(5)) * 0.05).alias("lon"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on offer: those whose number is no multiple of three, so that history holds others too."""
    return items(spark, sf_dir).filter(F.col("item_id").cast("long") % 3 != 0)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, location, filters (with nulls), category, delivery, item_id: one row a choice."""
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]).withColumn("c_mktsegment", F.lower("c_mktsegment"))  # before the join, which repeats it
    p = load(spark, sf_dir, "part", ["p_partkey", "p_name"])
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.concat_ws(" ", "p_name", "c_mktsegment").alias("query"),
        F.col("c_nationkey").cast("long").alias("location"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("filters"),
        F.lit(1).alias("category"),
        (F.col("c_nationkey") % 2 == 0).alias("delivery"),
        F.col("l_partkey").cast("string").alias("item_id"),
    )


ITEMS_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_brand || ' ' || p_type AS params, p_type AS microcat, p_retailprice AS price,
  CAST(p_partkey % 25 AS BIGINT) AS location, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS reviews, 3 + (p_partkey % 20) / 10.0::DOUBLE AS rating,
  50 + (p_partkey % 25) * 0.3::DOUBLE + (p_partkey % 7) * 0.05::DOUBLE AS lat, 30 + (p_partkey % 25) * 0.4::DOUBLE + (p_partkey % 5) * 0.05::DOUBLE AS lon FROM part"""
TRAIN_SQL = """SELECT p_name || ' ' || lower(c_mktsegment) AS query, CAST(c_nationkey AS BIGINT) AS location, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS filters,
  1 AS category, c_nationkey % 2 = 0 AS delivery, CAST(l_partkey AS VARCHAR) AS item_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""
_KEY = f"concat_ws(chr(31), {X.norm_sql('query')}, CAST(location AS VARCHAR), {X.norm_sql('filters')}, CAST(category AS VARCHAR), CASE WHEN delivery THEN 'True' ELSE 'False' END)"
#: Role views as CTEs: items, corpus, train, instances (qid, query, location, filters, qtext, items).
CTES = f"""items AS ({ITEMS_SQL}),
corpus AS (SELECT * FROM items WHERE CAST(item_id AS BIGINT) % 3 <> 0),
train AS ({TRAIN_SQL}),
keyed AS (SELECT *, substr(md5({_KEY}), 1, 16) AS qid, {X.norm_sql('query')} AS qtext FROM train),
instances AS (SELECT qid, min(query) AS query, min(location) AS location, min(filters) AS filters, min(qtext) AS qtext, list_sort(list_distinct(list(item_id))) AS items FROM keyed GROUP BY qid)"""
