"""Registered queries of the core library, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geo, text as X
from ..operators import channels as C, evaluate as E, instances as I, rank as K
from ..sources import roles as R
from ..sources.intermediate import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return R.load(spark, sf, name)


# ---- scans and scalars -------------------------------------------------------------------------------------------


@query("o01_load", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def o01(spark, sf):
    d = R.load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 49 and l_shipdate >= timestamp'1995-01-01'", ids=["l_orderkey"])
    return d.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("o02_id_filter", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def o02(spark, sf):
    ids = R.load(spark, sf, "lineitem", ["l_partkey"], "l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return R.load(spark, sf, "part", ["p_partkey", "p_name"]).join(ids, "p_partkey", "left_semi")


@query("o05_missing_vectors", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0")
def o05(spark, sf):
    """Ids that an embedding cache lacks."""
    v = R.load(spark, sf, "embeddings", ["vec_id"])
    return v.join(v.filter("vec_id % 7 <> 0"), "vec_id", "left_anti")


_HASH = "CAST(sum(CAST('0x' || substr(md5(i), {at}, 15) AS HUGEINT)) AS VARCHAR)"


@query("o06_cache_key", f"SELECT md5(count(*) || '|' || {_HASH.format(at=1)} || '|' || {_HASH.format(at=16)}) AS cache_key, count(*) AS n FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS i FROM benchmark)")
def o06(spark, sf):
    """A key of a set of ids whatever their order: sums of 120 bits of their hashes, so no task holds them all."""
    ids = _read(spark, sf, "benchmark").select(F.md5(F.col("item_id").cast("string")).alias("h")).distinct()
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return ids.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), part(1), part(16))).alias("cache_key"), F.count("*").alias("n"))


@query("o07_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def o07(spark, sf):
    return _read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("o08_profile", f"""WITH i AS ({R.ITEMS_SQL}) {" UNION ALL ".join(f"SELECT '{c}' AS column, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 9) AS null_share, round(avg(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1.0 ELSE 0 END), 9) AS blank_share FROM i" for c in ("item_id", "title", "params", "microcat", "price", "location", "reviews", "rating", "lat", "lon"))}""")
def o08(spark, sf):
    return E.profile(R.items(spark, sf))


@query("o10_norm_text", f"SELECT doc_id, md5({X.norm_sql('text')}) AS h, CAST(length({X.norm_sql('text')}) AS BIGINT) AS n FROM documents")
def o10(spark, sf):
    n = X.norm_text("text")
    return _read(spark, sf, "documents").select("doc_id", F.md5(n).alias("h"), F.length(n).cast("long").alias("n"))


@query("o11_query_key", f"WITH {R.CTES} SELECT qid, count(*) AS n FROM keyed GROUP BY qid")
def o11(spark, sf):
    key = X.query_key(F.col("query"), F.col("location"), F.col("filters"), F.col("category"), F.col("delivery"))
    return R.train(spark, sf).groupBy(X.short_md5(key).alias("qid")).agg(F.count("*").alias("n"))


@query("o12_content_hash", f"SELECT doc_id, substr(md5(concat_ws(chr(31), {X.norm_sql('source')}, {X.norm_sql('text')}, {X.norm_sql('lang')}, CAST(doc_id AS VARCHAR), '')), 1, 16) AS content_hash FROM documents")
def o12(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", X.content_hash(F.col("source"), F.col("text"), F.col("lang"), F.col("doc_id"), F.lit(None)).alias("content_hash"))


@query("o13_query_text", f"WITH {R.CTES} SELECT DISTINCT trim({X.norm_sql('query')} || ' ' || {X.norm_sql('filters')}) AS query_text FROM train")
def o13(spark, sf):
    return R.train(spark, sf).select(X.query_text(F.col("query"), F.col("filters")).alias("query_text")).distinct()


@query("o14_item_text", "SELECT doc_id, md5(source || ' | ' || substr(text, 1, 200) || ' | ' || substr(text, 1, 300)) AS h FROM documents")
def o14(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(X.item_text(F.col("source"), F.col("text"), F.col("text"))).alias("h"))


@query("o15_with_city", "SELECT c_custkey, c_name || ' | город: ' || coalesce(n_name, 'неизвестно') AS t FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def o15(spark, sf):
    n = _read(spark, sf, "nation").filter("n_nationkey % 3 <> 0")
    return _read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", X.with_city(F.col("c_name"), F.col("n_name")).alias("t"))


@query("o16_haversine", f"WITH {R.CTES} SELECT item_id, round({geo.haversine_sql('lat', 'lon', '55.75', '37.62')}, 6) AS km FROM items")
def o16(spark, sf):
    return R.items(spark, sf).select("item_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(55.75), F.lit(37.62)), 6).alias("km"))


@query("o17_o132_item_features", f"WITH {R.CTES} SELECT item_id, location, microcat, rating, round(ln(1 + greatest(price, 0)), 6) AS log_price, round(ln(1 + reviews), 6) AS log_reviews, CAST(length(title) AS BIGINT) AS title_chars, CAST(length(params) AS BIGINT) AS params_chars FROM items")
def o17(spark, sf):
    f = K.item_features(R.items(spark, sf)).drop("lat", "lon")
    return f.withColumn("log_price", F.round("log_price", 6)).withColumn("log_reviews", F.round("log_reviews", 6))


@query("o18_word_count", f"SELECT doc_id, CAST(CASE WHEN {X.norm_sql('text')} = '' THEN 0 ELSE len(string_split({X.norm_sql('text')}, ' ')) END AS BIGINT) AS words FROM documents")
def o18(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("o23_id_check", "SELECT qid, regexp_full_match(qid, '[0-9a-f]{16}') AS ok FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) ELSE substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) END AS qid FROM documents)")
def o23(spark, sf):
    h = X.short_md5(F.col("doc_id").cast("string"))
    return _read(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.upper(h)).otherwise(h).alias("qid")).select("qid", X.starts_with_id(F.col("qid")).alias("ok"))


@query("o24_strip_prefix", "SELECT item_id, text AS t FROM benchmark")
def o24(spark, sf):
    return _read(spark, sf, "benchmark").select("item_id", X.strip_prefix(F.concat(F.lit("query: "), "text"), "query: ").alias("t"))


# ---- instances, split, weights ------------------------------------------------------------------------------------

_PARTS = f"""{R.CTES},
texts AS (SELECT DISTINCT qtext FROM instances),
drawn AS (SELECT qtext, row_number() OVER (ORDER BY md5('42|' || qtext), qtext) AS k FROM texts),
one AS (SELECT qid, CASE WHEN k <= 60 THEN 'P2' ELSE 'P3' END AS part FROM instances JOIN drawn USING (qtext) WHERE k <= 100 QUALIFY row_number() OVER (PARTITION BY qtext ORDER BY md5('42|' || qid), qid) = 1),
parts0 AS (SELECT i.*, coalesce(o.part, 'P1') AS part FROM instances i LEFT JOIN one o USING (qid)),
held AS (SELECT item_id FROM (SELECT DISTINCT unnest(items) AS item_id FROM parts0 WHERE part <> 'P1') WHERE CAST('0x' || substr(md5('7|' || item_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3),
parts AS (SELECT *, part = 'P1' AND list_has_any(items, (SELECT list(item_id) FROM held)) AS thinned FROM parts0),
history AS (SELECT * FROM parts WHERE part = 'P1' AND NOT thinned)"""


def _parts(spark, sf):
    """Instances with their parts, stored once for the steps of a query that read them."""
    instances = stored(I.build_instances(R.train(spark, sf)), "instances")
    return stored(I.thinned(I.assign_parts(instances, 60, 40)), "parts")


@query("o110_instances", f"WITH {R.CTES} SELECT qid, query, location, filters, qtext, array_to_string(items, ' ') AS items FROM instances")
def o110(spark, sf):
    return I.build_instances(R.train(spark, sf)).select("qid", "query", "location", "filters", "qtext", F.array_join("items", " ").alias("items"))


@query("o111_o112_parts", f"WITH {_PARTS} SELECT qid, part, thinned FROM parts")
def o111(spark, sf):
    return _parts(spark, sf).select("qid", "part", "thinned")


@query("o113_location_weights", f"""WITH {_PARTS}, s AS (SELECT location, count(*) / sum(count(*)) OVER () AS s FROM parts WHERE part = 'P2' GROUP BY location),
t AS (SELECT location, count(*) / sum(count(*)) OVER () AS t FROM parts WHERE part = 'P3' GROUP BY location) SELECT location, round(coalesce(t, 0) / s, 9) AS weight FROM s LEFT JOIN t USING (location)""")
def o113(spark, sf):
    p = _parts(spark, sf)
    return I.location_weights(p.filter("part = 'P2'"), p.filter("part = 'P3'")).withColumn("weight", F.round("weight", 9))


@query("o114_local_corpus", f"WITH {_PARTS} SELECT item_id FROM corpus UNION SELECT unnest(items) FROM parts WHERE part <> 'P1'")
def o114(spark, sf):
    return I.local_corpus(R.corpus(spark, sf), R.items(spark, sf), _parts(spark, sf)).select("item_id")


@query("o121_check_split", "SELECT * FROM (VALUES ('qid repeated', 0::BIGINT), ('held-out text repeated', 0), ('text in P2 and P3', 0), ('held-out instance without items', 0), ('held-out instance thinned', 0)) t(rule, violations)")
def o121(spark, sf):
    return I.check_split(_parts(spark, sf))


@query("o123_thinning_variants", f"""WITH {_PARTS}, h AS (SELECT DISTINCT location, unnest(items) AS item_id FROM parts WHERE part <> 'P1'),
p1 AS (SELECT qid, location, unnest(items) AS item_id FROM parts WHERE part = 'P1')
SELECT (SELECT count(*) FROM parts WHERE part = 'P1') AS v0, (SELECT count(*) FROM parts WHERE part = 'P1') - (SELECT count(DISTINCT qid) FROM p1 WHERE item_id IN (SELECT item_id FROM h)) AS v1,
(SELECT count(*) FROM parts WHERE part = 'P1') - (SELECT count(DISTINCT qid) FROM p1 JOIN h USING (location, item_id)) AS v2, (SELECT count(*) FROM history) AS v3""")
def o123(spark, sf):
    """History sizes: all, no held-out item, no held-out item of the same location, drawn share."""
    p = _parts(spark, sf)
    h = p.filter("part <> 'P1'").select("location", F.explode("items").alias("item_id")).distinct()
    p1 = p.filter("part = 'P1'").select("qid", "location", F.explode("items").alias("item_id"))
    hit = lambda on: p1.join(h.select(*on).distinct(), on, "left_semi").agg(F.count_distinct("qid").alias("n"))
    base = p.agg(F.count_if(F.col("part") == "P1").alias("v0"), F.count_if((F.col("part") == "P1") & ~F.col("thinned")).alias("v3"))
    return base.crossJoin(hit(["item_id"]).withColumnRenamed("n", "a")).crossJoin(hit(["location", "item_id"]).withColumnRenamed("n", "b")).select("v0", (F.col("v0") - F.col("a")).alias("v1"), (F.col("v0") - F.col("b")).alias("v2"), "v3")


# ---- text retrieval ------------------------------------------------------------------------------------------------

_BM25 = f"""q AS (SELECT CAST(item_id AS VARCHAR) AS qid, unnest({X.tokens_sql('text')}) AS term FROM benchmark),
d AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, {X.tokens_sql('text')} AS t FROM documents),
w AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT item_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY item_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), w GROUP BY qid, item_id)"""


def _bench(spark, sf):
    return _read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")


def _docs(spark, sf):
    return _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")


@query("o90_bm25_top50", f"WITH {_BM25} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'bm25' AS channel FROM s WHERE score > 0 QUALIFY rank <= 50")
def o90(spark, sf):
    t = X.tokens(F.col("text"))
    return C.bm25(_bench(spark, sf), _docs(spark, sf), t, t, 50, "bm25")


@query("o91_bm25_pairs", f"""WITH {_BM25}, be AS (SELECT qid, item_id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) <= 10), pr AS (SELECT * FROM be UNION SELECT qid, CAST(CAST(item_id AS BIGINT) + 1 AS VARCHAR) FROM be)
SELECT qid, item_id, coalesce(score, 0) AS score FROM pr LEFT JOIN s USING (qid, item_id)""")
def o91(spark, sf):
    """Scores of given pairs: each passage with its ten best documents and with those that follow them, known or not."""
    t = X.tokens(F.col("text"))
    b, d = _bench(spark, sf), _docs(spark, sf)
    index = C.bm25_index(b, d, t, t)
    best = stored(C.bm25(b, d, t, t, 10, "bm25", index=index).select("qid", "item_id"), "pairs")
    after = best.select("qid", (F.col("item_id").cast("long") + 1).cast("string").alias("item_id"))
    return C.bm25_pairs(b, d, best.unionByName(after).distinct(), t, t, index=index)


_GRAMS = "SELECT id, substr(w, i, n) AS term FROM (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT id, w, unnest([3, 4, 5]) AS n FROM (SELECT id, ' ' || unnest(string_split(id, ' ')) || ' ' AS w FROM {t}) ) WHERE n <= length(w))"
_NEAR = f"""ht AS (SELECT DISTINCT qtext AS id FROM history), qs AS (SELECT * FROM parts WHERE part = 'P2'), qt AS (SELECT DISTINCT qtext AS id FROM qs),
hg AS (SELECT id, term, count(*) AS tf FROM ({_GRAMS.format(t='ht')}) GROUP BY ALL), qg AS (SELECT id, term, count(*) AS tf FROM ({_GRAMS.format(t='qt')}) GROUP BY ALL),
vo AS (SELECT term, ln((1 + (SELECT count(*) FROM ht)) / (1 + count(*))) + 1 AS idf FROM hg GROUP BY term HAVING count(*) >= 2),
hw AS (SELECT id, term, (1 + ln(tf)) * idf / sqrt(sum(pow((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY id)) AS w FROM hg JOIN vo USING (term)),
qw AS (SELECT id, term, (1 + ln(tf)) * idf / sqrt(sum(pow((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY id)) AS w FROM qg JOIN vo USING (term)),
sm AS (SELECT qw.id AS qtext, hw.id AS htext, round(sum(qw.w * hw.w), 6) AS sim FROM qw JOIN hw USING (term) GROUP BY qw.id, hw.id HAVING sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY qtext ORDER BY sim DESC, htext) <= 30),
near AS (SELECT qid, htext, sim FROM qs JOIN sm USING (qtext)),
ti AS (SELECT qtext AS htext, item_id, count(*) AS cnt FROM (SELECT qtext, unnest(items) AS item_id FROM history) GROUP BY ALL),
mp AS (SELECT qid, microcat, round(s / sum(s) OVER (PARTITION BY qid), 6) AS p FROM (SELECT qid, microcat, sum(sim * cnt) AS s FROM near JOIN (SELECT htext, microcat, sum(cnt) AS cnt FROM ti JOIN items USING (item_id) GROUP BY ALL) USING (htext) GROUP BY ALL)),
mr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, microcat) AS mc_rank FROM mp),
pop AS (SELECT item_id, count(*) AS pop, count(*) / (SELECT count(*) FROM history) AS pop_share FROM (SELECT unnest(items) AS item_id FROM history) GROUP BY item_id)"""


def _world(spark, sf, parts=None):
    p = parts or _parts(spark, sf)
    return p.filter("part = 'P2'"), I.history(p), R.items(spark, sf), R.corpus(spark, sf)


@query("o95_neighbours", f"WITH {_PARTS}, {_NEAR} SELECT qid, htext, sim FROM near")
def o95(spark, sf):
    q, h, _, _ = _world(spark, sf)
    return C.neighbours(q, h)


@query("o96_microcat_probs", f"WITH {_PARTS}, {_NEAR} SELECT qid, microcat, p, mc_rank FROM mr")
def o96(spark, sf):
    q, h, items, _ = _world(spark, sf)
    return C.microcat_probs(C.neighbours(q, h), h, items)


_LOGS = "SELECT qid, item_id, round(sum(sim * ln(1 + cnt) * (1 + CASE WHEN c.location = q.location THEN 1 ELSE 0 END)), 6) AS score FROM near JOIN ti USING (htext) JOIN corpus c USING (item_id) JOIN qs q USING (qid) GROUP BY ALL"


@query("o97_logs", f"WITH {_PARTS}, {_NEAR} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'logs' AS channel FROM ({_LOGS}) QUALIFY rank <= 500")
def o97(spark, sf):
    q, h, _, corpus = _world(spark, sf)
    return C.logs(q, C.neighbours(q, h), h, corpus)


def _priors_sql(first: str) -> str:
    return f"""WITH {_PARTS}, {_NEAR} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'priors' AS channel FROM
(SELECT qid, item_id, round(p + {first} + 0.001 * ln(1 + coalesce(reviews, 0)), 6) AS score FROM mr JOIN qs q USING (qid) JOIN corpus c ON c.microcat = mr.microcat AND c.location = q.location LEFT JOIN pop USING (item_id) WHERE mc_rank <= 3) QUALIFY rank <= 500"""


@query("o98_priors", _priors_sql("0.01 * ln(1 + coalesce(pop, 0))"))
def o98(spark, sf):
    q, h, items, corpus = _world(spark, sf)
    return C.priors(q, C.microcat_probs(C.neighbours(q, h), h, items), corpus, C.popularity(h))


@query("o98_priors_by_rating", _priors_sql("0.01 * coalesce(rating, 0) / 5"))
def o98_rating(spark, sf):
    q, h, items, corpus = _world(spark, sf)
    return C.priors(q, C.microcat_probs(C.neighbours(q, h), h, items), corpus, C.popularity(h), by_rating=True)


@query("o53_popularity", f"WITH {_PARTS}, {_NEAR} SELECT item_id, pop, round(pop_share, 12) AS pop_share FROM pop")
def o53(spark, sf):
    _, h, _, _ = _world(spark, sf)
    return C.popularity(h).withColumn("pop_share", F.round("pop_share", 12))


_POPLOC = """rk AS (SELECT c.item_id, location, coalesce(pop, 0) AS pop, coalesce(reviews, 0) AS reviews FROM corpus c LEFT JOIN pop USING (item_id)),
lc AS (SELECT location, item_id, row_number() OVER (PARTITION BY location ORDER BY pop DESC, reviews DESC, item_id) AS r FROM rk QUALIFY r <= 50),
gl AS (SELECT item_id, 50 + row_number() OVER (ORDER BY pop DESC, reviews DESC, item_id) AS r FROM rk QUALIFY r <= 150),
bo AS (SELECT * FROM lc UNION ALL SELECT l.location, g.item_id, g.r FROM (SELECT DISTINCT location FROM qs) l, gl g WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.location = l.location AND lc.item_id = g.item_id)),
pl AS (SELECT qid, item_id, CAST(51 - rank AS DOUBLE) AS score, rank FROM qs JOIN (SELECT location, item_id, row_number() OVER (PARTITION BY location ORDER BY r) AS rank FROM bo QUALIFY rank <= 50) USING (location))"""


@query("o99_pop_loc", f"WITH {_PARTS}, {_NEAR}, {_POPLOC} SELECT qid, item_id, score, rank, 'pop_loc' AS channel FROM pl")
def o99(spark, sf):
    q, h, _, corpus = _world(spark, sf)
    return C.pop_loc(q, corpus, C.popularity(h))


_CAND = f"""cand AS (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'logs' AS channel FROM ({_LOGS}) QUALIFY rank <= 500
UNION ALL SELECT qid, item_id, score, rank, 'pop_loc' FROM pl)"""
WEIGHTS = {"logs": 2.0, "pop_loc": 0.5}


def _candidates(spark, sf, parts=None):
    q, h, items, corpus = _world(spark, sf, parts)
    q, h = stored(q, "queries"), stored(h, "history")
    near, pop = stored(C.neighbours(q, h), "neighbours"), C.popularity(h)
    c = stored(C.union_channels([C.logs(q, near, h, corpus), C.pop_loc(q, corpus, pop)]), "candidates")
    return q, c, (h, items, corpus, near, pop)


@query("o101_candidates", f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND} SELECT channel, count(*) AS n, round(sum(score), 4) AS total FROM cand GROUP BY channel")
def o101(spark, sf):
    _, c, _ = _candidates(spark, sf)
    return c.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_RRF = """fz AS (SELECT qid, item_id, round(sum(CASE channel WHEN 'logs' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score FROM cand GROUP BY ALL),
fused AS (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM fz QUALIFY rank <= 50)"""


@query("o100_rrf", f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF} SELECT * FROM fused")
def o100(spark, sf):
    _, c, _ = _candidates(spark, sf)
    return C.rrf(c, WEIGHTS)


_TRUTH = "truth AS (SELECT qid, unnest(items) AS item_id FROM qs)"


def _truth(q):
    return q.select("qid", F.explode("items").alias("item_id"))


@query("o115_recall", f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF}, {_TRUTH} SELECT qid, round(count(f.rank) / count(*), 9) AS recall FROM truth LEFT JOIN fused f USING (qid, item_id) GROUP BY qid")
def o115(spark, sf):
    q, c, _ = _candidates(spark, sf)
    return E.recall_per_query(_truth(q), C.rrf(c, WEIGHTS))


@query("o117_pool_recall", f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_TRUTH}, be AS (SELECT qid, item_id, min(rank) AS rank FROM cand GROUP BY ALL), pq AS (SELECT qid, depth, count(*) FILTER (WHERE rank <= depth) / count(*) AS r FROM truth LEFT JOIN be USING (qid, item_id), (SELECT unnest([50, 100, 300, 500]) AS depth) GROUP BY ALL) SELECT CAST(depth AS BIGINT) AS depth, round(avg(r), 9) AS recall FROM pq GROUP BY depth")
def o117(spark, sf):
    q, c, _ = _candidates(spark, sf)
    return E.pool_recall(_truth(q), c, [50, 100, 300, 500])


@query("o57_effective_size", "SELECT round(sum(w) * sum(w) / sum(w * w), 6) AS n_eff, max(w) AS max_weight FROM (SELECT p_retailprice AS w FROM part)")
def o57(spark, sf):
    return E.effective_size(_read(spark, sf, "part").select(F.col("p_retailprice").alias("weight"))).withColumn("n_eff", F.round("n_eff", 6))


@query("o116_bootstrap")
def o116(spark, sf):
    q, c, _ = _candidates(spark, sf)
    t = _truth(q)
    d, lo, hi = E.paired_bootstrap(E.recall_per_query(t, C.rrf(c, WEIGHTS)), E.recall_per_query(t, C.rrf(c, {"pop_loc": 1.0})))
    return spark.createDataFrame([(d, lo, hi)], "difference double, low double, high double")


@query("o118_tune_rrf")
def o118(spark, sf):
    q, c, _ = _candidates(spark, sf)
    w, best = E.tune_rrf(_truth(q), c, ["logs", "pop_loc"], passes=1)
    return spark.createDataFrame([(json.dumps(w, sort_keys=True), best)], "weights string, recall double")


# ---- dense retrieval -----------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    v = _read(spark, sf, "embeddings")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("qid"), "embedding", F.pmod("vec_id", F.lit(25)).cast("long").alias("location"))
    return q, v.filter("vec_id % 10 <> 0").select(F.col("vec_id").cast("string").alias("item_id"), "embedding", "vec_id")


_DENSE = """dq AS (SELECT CAST(vec_id AS VARCHAR) AS qid, embedding AS qe, vec_id % 25 AS location FROM embeddings WHERE vec_id % 10 = 0),
dv AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, embedding AS ve, vec_id % 25 AS location, 50 + (vec_id % 25) * 0.3::DOUBLE + (vec_id % 7) * 0.05::DOUBLE AS lat, 30 + (vec_id % 25) * 0.4::DOUBLE + (vec_id % 5) * 0.05::DOUBLE AS lon FROM embeddings WHERE vec_id % 10 <> 0),
dc AS (SELECT location, median(lat) AS c_lat, median(lon) AS c_lon FROM dv GROUP BY location)"""
_DOT = "round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(ve AS DOUBLE[])), 6)"


@query("o92_dense", f"WITH {_DENSE} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'dense' AS channel FROM (SELECT qid, item_id, {_DOT} AS score FROM dq, dv) QUALIFY rank <= 50")
def o92(spark, sf):
    q, v = _vectors(spark, sf)
    return C.dense(q, v, 50)


def _places(v):
    k = F.col("vec_id")
    loc = F.pmod(k, F.lit(25))
    return v.select("item_id", loc.cast("long").alias("location"), (F.lit(50) + loc * 0.3 + F.pmod(k, F.lit(7)) * 0.05).alias("lat"), (F.lit(30) + loc * 0.4 + F.pmod(k, F.lit(5)) * 0.05).alias("lon"))


@query("o37_radius_join", f"WITH {_DENSE}, x AS (SELECT dc.location, item_id, round({geo.haversine_sql('c_lat', 'c_lon', 'lat', 'lon')}, 6) AS dist_km FROM dc, dv) SELECT * FROM x WHERE dist_km <= 50")
def o37(spark, sf):
    _, v = _vectors(spark, sf)
    items = _places(v)
    return geo.radius_join(geo.centroids(items), items.select("item_id", "lat", "lon"), 50.0).select("location", "item_id", F.round("dist_km", 6).alias("dist_km"))


@query("o93_dense_local", f"WITH {_DENSE} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'dense_local' AS channel FROM (SELECT qid, item_id, {_DOT} AS score FROM dq JOIN dc USING (location), dv WHERE {geo.haversine_sql('c_lat', 'c_lon', 'dv.lat', 'dv.lon')} <= 50) QUALIFY rank <= 100")
def o93(spark, sf):
    q, v = _vectors(spark, sf)
    return C.dense_local(q, _places(v), v)


@query("o94_pair_cosine", f"WITH {_DENSE} SELECT qid, item_id, {_DOT} AS score FROM dq JOIN dv ON dq.location = dv.location")
def o94(spark, sf):
    q, v = _vectors(spark, sf)
    pairs = q.select("qid", "location").join(_places(v).select("item_id", "location"), "location").select("qid", "item_id")
    return C.pair_cosine(pairs, q, v)


# ---- aggregations, windows, joins ------------------------------------------------------------------------------------


@query("o54_distribution", "SELECT c_mktsegment, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY c_mktsegment")
def o54(spark, sf):
    n = _read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("c_mktsegment", (F.col("n") / F.col("t")).alias("share"))


@query("o54_crosstab", "SELECT o_orderstatus, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 9) AS urgent, round(count(*) FILTER (WHERE o_orderpriority = '5-LOW') / count(*), 9) AS low FROM orders GROUP BY o_orderstatus")
def o54b(spark, sf):
    share = lambda p: F.round(F.count_if(F.col("o_orderpriority") == p) / F.count("*"), 9)
    return _read(spark, sf, "orders").groupBy("o_orderstatus").agg(share("1-URGENT").alias("urgent"), share("5-LOW").alias("low"))


@query("o55_counts", f"WITH {R.CTES} SELECT CAST(least(len(items), 6) AS BIGINT) AS size, count(*) AS n FROM instances GROUP BY 1")
def o55(spark, sf):
    return I.build_instances(R.train(spark, sf)).groupBy(F.least(F.size("items"), F.lit(6)).cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("o55_distinct", "SELECT count(DISTINCT l_partkey) AS n_parts, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS n_repeated FROM lineitem")
def o55b(spark, sf):
    return _read(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("n_parts"), (F.count("*") - F.count_distinct("l_orderkey", "l_partkey")).alias("n_repeated"))


@query("o56_quantiles", "SELECT p_brand, round(median(p_retailprice), 6) AS med, round(quantile_cont(p_retailprice, 0.9), 6) AS q90 FROM part GROUP BY p_brand")
def o56(spark, sf):
    return _read(spark, sf, "part").groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 6).alias("med"), F.round(F.percentile("p_retailprice", 0.9), 6).alias("q90"))


@query("o58_mode", "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def o58(spark, sf):
    n = _read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), F.col("c_mktsegment"))).alias("c_mktsegment"))


@query("o59_text_positives", f"WITH {R.CTES} SELECT qtext, array_to_string(list_sort(list_distinct(flatten(list(items)))), ' ') AS positives FROM instances GROUP BY qtext")
def o59(spark, sf):
    return K.text_positives(I.build_instances(R.train(spark, sf))).withColumn("positives", F.array_join("positives", " "))


@query("o60_group_flags", "SELECT o_custkey, bool_or(o_totalprice > 300000) AS any_large, bool_and(o_totalprice > 50000) AS all_large, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM orders GROUP BY o_custkey")
def o60(spark, sf):
    return _read(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("any_large"), F.bool_and(F.col("o_totalprice") > 50000).alias("all_large"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


@query("o61_bins", "SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN '(0, 10]' WHEN p_size > 10 AND p_size <= 30 THEN '(10, 30]' WHEN p_size > 30 AND p_size <= 50 THEN '(30, 50]' END AS bin, count(*) AS n FROM part GROUP BY 1")
def o61(spark, sf):
    return _read(spark, sf, "part").groupBy(E.bucket(F.col("p_size"), [0, 10, 30, 50]).alias("bin")).agg(F.count("*").alias("n"))


@query("o80_global_top", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 100")
def o80(spark, sf):
    return _read(spark, sf, "part").orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey").limit(100).select("p_partkey", "p_retailprice")


@query("o78_cap_pairs", f"""WITH {R.CTES}, p AS (SELECT DISTINCT qtext, unnest(items) AS item_id FROM instances),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5('11|' || qtext || '|' || item_id), qtext, item_id) <= 3)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qtext ORDER BY md5('11|' || qtext || '|' || item_id), qtext, item_id) <= 5""")
def o78(spark, sf):
    p = I.build_instances(R.train(spark, sf)).select("qtext", F.explode("items").alias("item_id")).distinct()
    return K.cap_pairs(p, 3, 5)


@query("o36_null_safe_overlap", f"WITH {_PARTS} SELECT count(*) AS n FROM (SELECT DISTINCT location, filters FROM parts WHERE part = 'P2') a WHERE EXISTS (SELECT 1 FROM parts b WHERE b.part = 'P3' AND a.location IS NOT DISTINCT FROM b.location AND a.filters IS NOT DISTINCT FROM b.filters)")
def o36(spark, sf):
    p = _parts(spark, sf)
    a, b = (p.filter(F.col("part") == x).select("location", "filters").distinct().alias(x) for x in ("P2", "P3"))
    return a.join(b, F.col("P2.location").eqNullSafe(F.col("P3.location")) & F.col("P2.filters").eqNullSafe(F.col("P3.filters")), "left_semi").agg(F.count("*").alias("n"))


@query("o40_history_overlap", f"WITH {_PARTS} SELECT h.qid, count(*) AS n, count(*) FILTER (WHERE h.location = p.location) AS same_loc, count(*) FILTER (WHERE list_has_any(string_split(h.qtext, ' '), string_split(p.qtext, ' '))) AS shared_word FROM (SELECT qid, location, qtext, unnest(items) AS item_id FROM parts WHERE part = 'P3') h JOIN (SELECT location, qtext, unnest(items) AS item_id FROM history) p USING (item_id) GROUP BY h.qid")
def o40(spark, sf):
    p = _parts(spark, sf)
    flat = lambda d: d.select("qid", "location", "qtext", F.explode("items").alias("item_id"))
    a, b = flat(p.filter("part = 'P3'")).alias("a"), flat(I.history(p)).alias("b")
    j = a.join(b, F.col("a.item_id") == F.col("b.item_id"))
    shared = F.arrays_overlap(F.split("a.qtext", " "), F.split("b.qtext", " "))
    return j.groupBy(F.col("a.qid").alias("qid")).agg(F.count("*").alias("n"), F.count_if(F.col("a.location") == F.col("b.location")).alias("same_loc"), F.count_if(shared).alias("shared_word"))


@query("o120_single_auc", """WITH f AS (SELECT quality, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE) AS digits FROM labels JOIN documents USING (doc_id)),
l AS (SELECT 'n_chars' AS feature, quality AS y, n_chars AS v FROM f UNION ALL SELECT 'digits', quality, digits FROM f),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM l),
a AS (SELECT feature, (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS a FROM r GROUP BY feature)
SELECT feature, round(greatest(a, 1 - a), 9) AS auc FROM a""")
def o120(spark, sf):
    d = _read(spark, sf, "labels").join(_read(spark, sf, "documents"), "doc_id")
    return E.single_auc(d.withColumn("digits", F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))), ["n_chars", "digits"], F.col("quality"))


# ---- features, ranking, second stage ---------------------------------------------------------------------------------


@query("o130_pool", f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND},
b AS (SELECT qid, item_id, min(rank) FILTER (WHERE channel = 'logs') AS rank_logs, min(rank) FILTER (WHERE channel = 'pop_loc') AS rank_pop_loc, max(score) FILTER (WHERE channel = 'logs') AS score_logs, max(score) FILTER (WHERE channel = 'pop_loc') AS score_pop_loc,
count(DISTINCT channel) FILTER (WHERE rank <= 200) AS n_channels FROM cand GROUP BY ALL HAVING min(rank) <= 200),
c AS (SELECT *, round(2.0::DOUBLE / (60 + coalesce(rank_logs, 1000000)) + 0.5::DOUBLE / (60 + coalesce(rank_pop_loc, 1000000)), 9) AS rrf FROM b)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, item_id) AS rrf_rank, count(*) OVER (PARTITION BY qid) AS pool_size FROM c""")
def o130(spark, sf):
    _, c, _ = _candidates(spark, sf)
    return K.pool(c, ["logs", "pop_loc"], WEIGHTS)


def _pairs(spark, sf):
    q, c, (h, items, _, near, pop) = _candidates(spark, sf)
    pool = K.pool(c, ["logs", "pop_loc"], WEIGHTS)
    d = K.add_features(pool, q, items, pop, C.microcat_probs(near, h, items))
    return q, d.join(_truth(q).withColumn("label", F.lit(1)), ["qid", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


FEATURES = ["rank_logs", "rank_pop_loc", "score_logs", "n_channels", "rrf", "rrf_rank", "q_words", "loc_match", "dist_km", "log_price", "log_reviews", "log_pop", "p_mc", "mc_rank"]


@query("o133_o135_pair_features", f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, ct AS (SELECT location AS q_location, median(lat) AS c_lat, median(lon) AS c_lon FROM items GROUP BY location)
SELECT qid, item_id, CAST(len(string_split({X.norm_sql('q.query')}, ' ')) AS BIGINT) AS q_words, CAST(i.location = q.location AS INTEGER) AS loc_match, round({geo.haversine_sql('c_lat', 'c_lon', 'lat', 'lon')}, 6) AS dist_km,
round(ln(1 + 1e5 * coalesce(pop_share, 0)), 6) AS log_pop, coalesce(mr.p, 0) AS p_mc, mc_rank
FROM (SELECT qid, item_id FROM cand GROUP BY ALL HAVING min(rank) <= 200) JOIN qs q USING (qid) JOIN items i USING (item_id) LEFT JOIN ct ON q.location = ct.q_location LEFT JOIN pop USING (item_id) LEFT JOIN mr USING (qid, microcat)""")
def o133(spark, sf):
    _, d = _pairs(spark, sf)
    return d.select("qid", "item_id", "q_words", "loc_match", "dist_km", "log_pop", "p_mc", "mc_rank")


@query("o137_o138_ranker")
def o137(spark, sf):
    _, d = _pairs(spark, sf)
    d = stored(d, "pairs")
    return K.predict_top(K.Ranker(FEATURES, trees=8, depth=4).fit(K.sample_negatives(d)).score(d))


@query("o140_out_of_fold")
def o140(spark, sf):
    _, d = _pairs(spark, sf)
    return K.out_of_fold(stored(d, "pairs"), FEATURES, n=2, trees=4, depth=3).select("qid", "item_id", "label", "score")


_TOP = "tp AS (SELECT qid, item_id, score AS first_score, rank AS first_rank, round(CAST('0x' || substr(md5(qid || '|' || item_id), 1, 4) AS BIGINT) / 65536.0, 3) AS ce_score FROM fused)"


def _ce(top):
    """A stand-in for external scores, a function of the pair."""
    s = F.conv(F.substring(F.md5(F.concat_ws("|", "qid", "item_id")), 1, 4), 16, 10).cast("double") / 65536.0
    return top.select("qid", "item_id", F.round(s, 3).alias("ce_score"))


def _first(spark, sf):
    _, c, _ = _candidates(spark, sf)
    return C.rrf(c, WEIGHTS).select("qid", "item_id", F.col("score").alias("first_score"), F.col("rank").alias("first_rank"))


@query("o141_o143_stage2", f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF}, {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce_score DESC, first_rank) AS ce_rank, round(ce_score - max(ce_score) OVER (PARTITION BY qid), 9) AS ce_gap FROM tp)
SELECT *, round(avg(CASE WHEN ce_rank <= 5 THEN ce_score END) OVER (PARTITION BY qid), 6) AS ce_top_mean, round(avg(CASE WHEN ce_score > 0.8 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY qid), 6) AS ce_share FROM r""")
def o141(spark, sf):
    top = _first(spark, sf)
    return K.stage2_features(top, _ce(top), 0.8)


@query("o145_same_pairs", "SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, 0::BIGINT AS repeated, 0::BIGINT AS null_scores")
def o145(spark, sf):
    top = _first(spark, sf)
    return E.same_pairs(top, _ce(top))


@query("o144_ensemble", f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF}, {_TOP} SELECT qid, item_id, -(row_number() OVER (PARTITION BY qid ORDER BY first_score DESC, item_id) + row_number() OVER (PARTITION BY qid ORDER BY ce_score DESC, item_id)) / 2.0 AS score FROM tp""")
def o144(spark, sf):
    top = _first(spark, sf)
    return K.ensemble([top.withColumn("score", F.col("first_score")), _ce(top).withColumn("score", F.col("ce_score"))])


@query("o82_hard_negatives", f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF}, {_TRUTH} SELECT qid, item_id, rank FROM fused WHERE rank BETWEEN 10 AND 100 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.qid = fused.qid AND t.item_id = fused.item_id)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5('13|' || qid || '|' || item_id), item_id) <= 4""")
def o82(spark, sf):
    q, c, _ = _candidates(spark, sf)
    return K.hard_negatives(C.rrf(c, WEIGHTS), _truth(q))


@query("o85_answers", f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF} SELECT qid AS query_id, string_agg(item_id, ' ' ORDER BY rank) AS answer FROM fused GROUP BY qid")
def o85(spark, sf):
    q, c, _ = _candidates(spark, sf)
    return K.answers(C.rrf(c, WEIGHTS), q)


@query("o126_validate", "SELECT * FROM (VALUES ('columns', 0::BIGINT), ('query id repeated', 0), ('query id unknown', 0), ('query id missing', 0), ('number of ids', 0), ('id repeated in an answer', 0), ('id outside the corpus', 0)) t(rule, violations)")
def o126(spark, sf):
    q, c, (_, _, corpus, _, _) = _candidates(spark, sf)
    return E.validate(K.answers(C.rrf(c, WEIGHTS), q), q.select(F.col("qid").alias("query_id")), corpus)
