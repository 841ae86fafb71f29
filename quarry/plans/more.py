"""Queries of diagnostics, exports, external scores and the full candidate pool, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis as A, channels as C, evaluate as E, exports as P, instances as I, rank as K
from ..sources import roles as R
from ..sources.intermediate import small, stored, work_path
from .queries import _BM25, _CAND, _DOT, _LOGS, _NEAR, _PARTS, _POPLOC, _RRF, _TOP, _TRUTH, FEATURES, WEIGHTS, _bench, _candidates, _ce, _docs, _first, _pairs, _parts, _read, _truth, _world, query

_ALL = f"WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_CAND}, {_RRF}, {_TRUTH}"

# ---- text retrieval by field, and the full pool --------------------------------------------------------------------

_FIELDS = {"title": "substr(text, 1, 60)", "params": "source || ' ' || lang", "desc": "substr(text, 1, 1000)"}


def _field_sql(name: str, field: str) -> str:
    inner = _BM25.replace(f"{X.tokens_sql('text')} AS t FROM documents", f"{X.tokens_sql(field)} AS t FROM documents")
    return f"SELECT * FROM (WITH {inner} SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, 'bm25_{name}' AS channel FROM s WHERE score > 0 QUALIFY rank <= 50)"


@query("o90_bm25_fields", " UNION ALL ".join(_field_sql(n, f) for n, f in _FIELDS.items()))
def o90_fields(spark, sf):
    """BM25 of the benchmark passages in three fields of documents, each with its own index; the last is cut."""
    docs = _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text", "source", "lang")
    fields = {"title": F.substring("text", 1, 60), "params": F.concat_ws(" ", "source", "lang"), "desc": F.substring("text", 1, 1000)}
    return C.union_channels(A.bm25_fields(_bench(spark, sf), docs, fields, F.col("text"), 50))


_PBM = """{n}q AS (SELECT qid, unnest({qt}) AS term FROM qs), {n}d AS (SELECT item_id, {dt} AS t FROM corpus), {n}w AS (SELECT count(*) AS n, avg(len(t)) AS a FROM {n}d),
{n}p AS (SELECT item_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM {n}d) GROUP BY item_id, term), {n}f AS (SELECT term, count(*) AS df FROM {n}p GROUP BY term),
{n}s AS (SELECT qid, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM {n}q JOIN {n}p USING (term) JOIN {n}f USING (term), {n}w GROUP BY qid, item_id)"""
_RANKED = "SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, '{c}' AS channel FROM ({s}) QUALIFY rank <= {k}"
_QTEXT = f"trim({X.norm_sql('query')} || ' ' || {X.norm_sql('filters')})"
_POOL_SQL = f"""WITH {_PARTS}, {_NEAR}, {_POPLOC}, {_PBM.format(n='ti', qt=X.tokens_sql(_QTEXT), dt=X.tokens_sql('title'))}, {_PBM.format(n='pa', qt=X.tokens_sql(_QTEXT), dt=X.tokens_sql('params'))},
dv AS (SELECT item_id, embedding AS ve, embedding2 AS ve2 FROM corpus JOIN (SELECT vec_id, embedding FROM embeddings) a ON a.vec_id = CAST(item_id AS BIGINT) % 500 JOIN (SELECT vec_id AS v2, embedding AS embedding2 FROM embeddings) b ON v2 = CAST(item_id AS BIGINT) * 7 % 500),
dq AS (SELECT qid, embedding AS qe FROM qs JOIN embeddings ON vec_id = CAST('0x' || substr(qid, 1, 6) AS BIGINT) % 500),
c AS ({' UNION ALL '.join('(' + _RANKED.format(c=c, s=s, k=k) + ')' for c, s, k in [
    ('bm25_title', 'SELECT * FROM tis WHERE score > 0', 100), ('bm25_params', 'SELECT * FROM pas WHERE score > 0', 100), ('logs', _LOGS, 500),
    ('priors', 'SELECT qid, item_id, round(p + 0.01 * ln(1 + coalesce(pop, 0)) + 0.001 * ln(1 + coalesce(reviews, 0)), 6) AS score FROM mr JOIN qs q USING (qid) JOIN corpus c ON c.microcat = mr.microcat AND c.location = q.location LEFT JOIN pop USING (item_id) WHERE mc_rank <= 3', 500),
    ('dense', f'SELECT qid, item_id, {_DOT} AS score FROM dq, dv', 50), ('dense_alt', f"SELECT qid, item_id, {_DOT.replace('ve', 've2')} AS score FROM dq, dv", 50)])}
UNION ALL SELECT qid, item_id, score, rank, 'pop_loc' FROM pl)
SELECT channel, count(*) AS n, count(DISTINCT qid) AS queries, round(sum(score), 3) AS total, CAST(sum(rank) AS BIGINT) AS ranks FROM c GROUP BY channel"""


@query("o101_full_pool", _POOL_SQL)
def o101_full(spark, sf):
    """Candidates of all channels: two text fields, two vector models (the second renamed), logs, priors and popularity."""
    q, h, items, corpus = _world(spark, sf)
    q, h, corpus = stored(q, "queries"), stored(h, "history"), stored(corpus, "corpus")
    near, pop = stored(C.neighbours(q, h), "neighbours"), C.popularity(h)
    text = A.bm25_fields(q, corpus, {"title": F.col("title"), "params": F.col("params")}, X.query_text(F.col("query"), F.col("filters")), 100)
    v = _read(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = q.withColumn("vec_id", F.pmod(F.conv(F.substring("qid", 1, 6), 16, 10).cast("long"), F.lit(500))).join(v, "vec_id").select("qid", "embedding")
    item = F.col("item_id").cast("long")
    models = [corpus.withColumn("vec_id", F.pmod(item * m, F.lit(500))).join(v, "vec_id").select("item_id", "embedding") for m in (1, 7)]
    dense = [C.dense(asked, models[0], 50), C.union_channels([C.dense(asked, models[1], 50)], {"dense": "dense_alt"})]
    history = [C.logs(q, near, h, corpus), C.priors(q, C.microcat_probs(near, h, items), corpus, pop), C.pop_loc(q, corpus, pop)]
    c = C.union_channels([*text, *dense, *history])
    return c.groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("queries"), F.round(F.sum("score"), 3).alias("total"), F.sum("rank").cast("long").alias("ranks"))


# ---- places, cells, calibration, misses ------------------------------------------------------------------------------


@query("o102_location_names", f"""WITH {_PARTS}, own AS (SELECT location, title AS city, count(*) AS n FROM items WHERE location < 18 GROUP BY location, title QUALIFY row_number() OVER (PARTITION BY location ORDER BY count(*) DESC, title) = 1),
ex AS (SELECT h.location, i.location AS il FROM (SELECT location, unnest(items) AS item_id FROM history) h JOIN items i USING (item_id)),
hs AS (SELECT ex.location, city, count(*) AS n FROM ex JOIN own ON own.location = il GROUP BY ex.location, city QUALIFY row_number() OVER (PARTITION BY ex.location ORDER BY count(*) DESC, city) = 1)
SELECT location, city FROM own UNION ALL SELECT location, city FROM hs WHERE location NOT IN (SELECT location FROM own)""")
def o102(spark, sf):
    """Names of locations from their items' addresses, of those without items from what history chose there."""
    _, h, items, _ = _world(spark, sf)
    addressed = items.withColumn("params", F.when(F.col("location") < 18, F.concat(F.lit("Место оказания услуг "), "title", F.lit(", улица Мира"))))
    return A.query_location_names(A.location_names(addressed), h, items)


_CELL = "ce AS (SELECT qid, q.location, CASE WHEN mr.microcat IS NULL THEN -1 ELSE coalesce(n, 0) END AS cell FROM {q} q LEFT JOIN mr ON q.qid = mr.qid AND mc_rank = 1 LEFT JOIN (SELECT microcat, location, count(*) AS n FROM corpus GROUP BY ALL) c ON c.microcat = mr.microcat AND c.location = q.location)".replace("SELECT qid,", "SELECT q.qid,", 1)
_BIN = "CASE " + " ".join(f"WHEN {{c}} > {lo:g} AND {{c}} <= {hi:g} THEN '({lo:g}, {hi:g}]'" for lo, hi in zip(A.CELL_EDGES[:-1], A.CELL_EDGES[1:])) + " END"
_SIZE = "CASE " + " ".join(f"WHEN {{c}} > {lo:g} AND {{c}} <= {hi:g} THEN '({lo:g}, {hi:g}]'" for lo, hi in zip(A.SIZE_EDGES[:-1], A.SIZE_EDGES[1:])) + " END"


@query("o119_cells", f"WITH {_PARTS}, {_NEAR}, {_CELL.format(q='qs')} SELECT qid, CAST(cell AS BIGINT) AS cell, {_BIN.format(c='cell')} AS bin FROM ce")
def o119(spark, sf):
    q, h, items, corpus = _world(spark, sf)
    c = A.cell_sizes(q, C.microcat_probs(C.neighbours(q, h), h, items), corpus)
    return c.select("qid", "cell", E.bucket(F.col("cell"), A.CELL_EDGES).alias("bin"))


@query("o119_bucket_weights", f"""WITH {_PARTS}, z AS (SELECT location AS l, count(*) AS n FROM corpus GROUP BY ALL), b AS (SELECT part, location % 5 AS area, {_SIZE.format(c='coalesce(n, 0)')} AS bin FROM parts LEFT JOIN z ON l = location WHERE part <> 'P1'),
s AS (SELECT area, bin, count(*) / (SELECT count(*) FROM b WHERE part = 'P3') AS s FROM b WHERE part = 'P3' GROUP BY ALL), t AS (SELECT area, bin, count(*) / (SELECT count(*) FROM b WHERE part = 'P2') AS t FROM b WHERE part = 'P2' GROUP BY ALL)
SELECT area, bin, round(coalesce(t, 0) / s, 9) AS weight FROM s LEFT JOIN t USING (area, bin)""")
def o119_weights(spark, sf):
    """Weights of P3 by area and size bin so that it looks like P2."""
    p = _parts(spark, sf).filter("part <> 'P1'")
    n = R.corpus(spark, sf).groupBy("location").agg(F.count("*").alias("n"))
    d = p.join(n, "location", "left").select("part", (F.col("location") % 5).alias("area"), E.bucket(F.coalesce("n", F.lit(0)), A.SIZE_EDGES).alias("bin"))
    w = A.bucket_weights(d.filter("part = 'P3'"), d.filter("part = 'P2'"), ["area", "bin"])
    return w.withColumn("weight", F.round("weight", 9))


_RECALL = "rc AS (SELECT qid, round(count(f.rank) / count(*), 9) AS recall FROM truth LEFT JOIN fused f USING (qid, item_id) GROUP BY qid)"


@query("o124_calibration", f"""{_ALL}, {_RECALL}, d AS (SELECT {_SIZE.format(c='coalesce(n, 0)')} AS bucket, list_has_any(items, (SELECT list(DISTINCT i) FROM (SELECT unnest(items) AS i FROM history))) AS seen, recall FROM qs JOIN rc USING (qid) LEFT JOIN (SELECT location, count(*) AS n FROM corpus GROUP BY ALL) z USING (location))
SELECT bucket, seen, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 9) AS share, round(avg(recall), 9) AS recall FROM d GROUP BY ALL""")
def o124(spark, sf):
    q, c, (h, _, corpus, _, _) = _candidates(spark, sf)
    return A.calibration(q, E.recall_per_query(_truth(q), C.rrf(c, WEIGHTS)), corpus, h)


_MISS = f"""ms AS (SELECT t.qid, t.item_id, f.rank AS place, NOT coalesce(f.rank <= 50, false) AS miss, f.rank IS NULL AS not_in_pool, coalesce(i.location <> q.location, false) AS other_location,
NOT coalesce(mr.mc_rank <= 3, false) AS category_missed, q.qtext IN (SELECT qtext FROM history) AS known_text, {X.norm_sql('q.filters')} <> '' AS has_filters, len(string_split(q.qtext, ' ')) = 1 AS one_word, coalesce(c.n, 0) AS cell
FROM truth t JOIN qs q USING (qid) LEFT JOIN fused f ON f.qid = t.qid AND f.item_id = t.item_id LEFT JOIN items i ON i.item_id = t.item_id LEFT JOIN mr ON mr.qid = t.qid AND mr.microcat = i.microcat
LEFT JOIN (SELECT microcat, location, count(*) AS n FROM corpus GROUP BY ALL) c ON c.microcat = i.microcat AND c.location = q.location)"""


def _misses(spark, sf):
    q, c, (h, items, corpus, near, _) = _candidates(spark, sf)
    return A.misses(q, C.rrf(c, WEIGHTS), items, corpus, C.microcat_probs(near, h, items), h)


@query("o39_o125_misses", f"{_ALL}, {_MISS} SELECT * FROM ms")
def o125(spark, sf):
    return _misses(spark, sf)


@query("o125_miss_shares", f"{_ALL}, {_MISS} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, round(avg(CAST({f} AS INTEGER)) FILTER (WHERE miss), 9) AS misses, round(avg(CAST({f} AS INTEGER)) FILTER (WHERE NOT miss), 9) AS hits FROM ms" for f in A.FLAGS))
def o125_shares(spark, sf):
    return A.miss_shares(_misses(spark, sf))


@query("o125_unknown_words", f"""WITH {_PARTS}, {_NEAR}, qw2 AS (SELECT DISTINCT qid, unnest(regexp_extract_all(qtext, '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS word FROM qs), hw2 AS (SELECT DISTINCT unnest(regexp_extract_all(qtext, '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS word FROM history)
SELECT qid, count(word) AS words, count(word) FILTER (WHERE word NOT IN (SELECT word FROM hw2)) AS unknown FROM qs LEFT JOIN qw2 USING (qid) GROUP BY qid""")
def o125_words(spark, sf):
    q, h, _, _ = _world(spark, sf)
    return A.unknown_word_share(q, h)


@query("o122_random_recall", f"WITH {_PARTS}, {_NEAR}, {_TRUTH}, x AS (SELECT qid, item_id, CAST('0x' || substr(md5('42|' || d || '|' || qid || '|' || item_id), 1, 8) AS BIGINT) / 4294967296.0 < 1 - pow(1 - 1 / (SELECT count(*) FROM items)::DOUBLE, 50) AS hit FROM truth, (SELECT unnest(range(1, 21)) AS d)) SELECT qid, round(avg(CAST(hit AS INTEGER)), 9) AS recall FROM x GROUP BY qid")
def o122(spark, sf):
    q, _, items, _ = _world(spark, sf)
    return A.random_recall(_truth(q), items)


@query("o122_oracle_recall", f"WITH {_PARTS}, {_NEAR}, {_TRUTH} SELECT qid, round(least(1, 50 / count(*)), 9) AS recall FROM truth GROUP BY qid")
def o122_oracle(spark, sf):
    q, _, _, _ = _world(spark, sf)
    return A.oracle_recall(_truth(q))


@query("o149_drop_channels", f"""{_ALL}, v AS (SELECT unnest(['', 'logs', 'pop_loc']) AS dropped), vs AS (SELECT dropped, qid, item_id, round(sum(CASE channel WHEN 'logs' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS s FROM cand JOIN v ON channel <> dropped GROUP BY ALL),
vt AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY dropped, qid ORDER BY s DESC, item_id) <= 50), vr AS (SELECT dropped, qid, count(vt.s) / count(*) AS r FROM truth CROSS JOIN v LEFT JOIN vt USING (dropped, qid, item_id) GROUP BY ALL)
SELECT dropped, round(avg(r), 9) AS recall FROM vr GROUP BY dropped""")
def o149(spark, sf):
    q, c, _ = _candidates(spark, sf)
    return A.drop_channels(_truth(q), c, WEIGHTS)


@query("o150_depth_grid", f"{_ALL}, g AS (SELECT unnest([10, 25, 50]) AS k), x AS (SELECT k, qid, count(f.rank) / count(*) AS r FROM truth CROSS JOIN g LEFT JOIN fused f ON f.qid = truth.qid AND f.item_id = truth.item_id AND f.rank <= k GROUP BY k, truth.qid) SELECT CAST(k AS BIGINT) AS k, round(avg(r), 9) AS recall FROM x GROUP BY k".replace("SELECT k, qid,", "SELECT k, truth.qid,"))
def o150(spark, sf):
    """Recall of one ranking at several depths, in one pass."""
    q, c, _ = _candidates(spark, sf)
    return E.pool_recall(_truth(q), C.rrf(c, WEIGHTS), [10, 25, 50]).withColumnRenamed("depth", "k")


# ---- ranking -------------------------------------------------------------------------------------------------------


@query("o131_negatives", f"""{_ALL}, b AS (SELECT qid, item_id, min(rank) FILTER (WHERE channel = 'logs') AS rl, min(rank) FILTER (WHERE channel = 'pop_loc') AS rp FROM cand GROUP BY ALL HAVING min(rank) <= 200),
c AS (SELECT qid, item_id, round(2.0::DOUBLE / (60 + coalesce(rl, 1000000)) + 0.5::DOUBLE / (60 + coalesce(rp, 1000000)), 9) AS rrf FROM b),
e AS (SELECT c.qid, c.item_id, CAST(t.item_id IS NOT NULL AS INTEGER) AS label, row_number() OVER (PARTITION BY c.qid ORDER BY rrf DESC, c.item_id) AS rrf_rank FROM c LEFT JOIN truth t ON t.qid = c.qid AND t.item_id = c.item_id),
n AS (SELECT *, label = 0 AND rrf_rank > 100 AS tail, sum(CAST(label = 0 AND rrf_rank > 100 AS INTEGER)) OVER (PARTITION BY qid) AS nt FROM e)
SELECT qid, item_id, label, rrf_rank FROM n WHERE NOT tail OR CAST('0x' || substr(md5('3|' || qid || '|' || item_id), 1, 8) AS BIGINT) / 4294967296.0 * nt < 100""")
def o131(spark, sf):
    _, d = _pairs(spark, sf)
    return K.sample_negatives(d).select("qid", "item_id", "label", "rrf_rank")


@query("o139_train")
def o139(spark, sf):
    """The training procedure on P2's pairs: parts by query, choice between two depths by recall, refit."""
    q, d = _pairs(spark, sf)
    _, best = A.train(stored(d, "pairs"), _truth(q), A.variant("all", FEATURES), [{"trees": 20, "depth": 3}, {"trees": 20, "depth": 5}])
    return spark.createDataFrame([(json.dumps(best["option"], sort_keys=True), best["recall"], best["trees"])], "option string, recall double, trees int")


@query("o120_adversarial_auc")
def o120_classifier(spark, sf):
    """How well documents of quality 1 can be told from others: five-fold classifier and each feature."""
    d = _read(spark, sf, "labels").join(_read(spark, sf, "documents"), "doc_id")
    d = d.withColumn("digits", F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).withColumn("words", F.size(F.split("text", " ")))
    return A.adversarial_auc(d.select("doc_id", F.col("quality").alias("label"), "n_chars", "digits", "words"), ["n_chars", "digits", "words"], id_col="doc_id", trees=20, depth=4)


# ---- exports and what comes back -------------------------------------------------------------------------------------


@query("o146_rerank_pairs", f"""{_ALL}, lw AS (SELECT location, t / s AS w FROM (SELECT location, count(*) / (SELECT count(*) FROM parts WHERE part = 'P2') AS s FROM parts WHERE part = 'P2' GROUP BY ALL) LEFT JOIN (SELECT location, count(*) / (SELECT count(*) FROM parts WHERE part = 'P3') AS t FROM parts WHERE part = 'P3' GROUP BY ALL) USING (location)),
nr AS (SELECT qid, count(*) AS n_rel FROM truth GROUP BY qid)
SELECT f.qid AS query_id, f.item_id, {_QTEXT} AS query_text, i.title || ' | ' || i.params AS item_text, f.rank AS first_rank, CAST(t.item_id IS NOT NULL AS INTEGER) AS label, n_rel, round(coalesce(w, 0), 9) AS w
FROM fused f JOIN qs q USING (qid) JOIN items i ON i.item_id = f.item_id LEFT JOIN truth t ON t.qid = f.qid AND t.item_id = f.item_id JOIN nr ON nr.qid = f.qid LEFT JOIN lw ON lw.location = q.location""")
def o146(spark, sf):
    p = _parts(spark, sf)
    q, c, (_, items, _, _, _) = _candidates(spark, sf, p)
    first = C.rrf(c, WEIGHTS).withColumnRenamed("rank", "first_rank")
    w = I.location_weights(p.filter("part = 'P2'"), p.filter("part = 'P3'"))
    out = P.rerank_pairs(first, q, items, X.query_text(F.col("query"), F.col("filters")), F.concat_ws(" | ", "title", "params"), _truth(q), w)
    return out.withColumn("w", F.round("w", 9))


@query("o147_finetune_pairs", f"""{_ALL}, kn AS (SELECT DISTINCT qtext, unnest(items) AS item_id FROM history), ps AS (SELECT qid, qtext, item_id FROM (SELECT qid, qtext, unnest(items) AS item_id FROM qs) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5('17|' || qid || '|' || item_id), item_id) = 1),
dn AS (SELECT qid, item_id FROM fused JOIN qs USING (qid) WHERE rank BETWEEN 10 AND 100 AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.qtext = qs.qtext AND kn.item_id = fused.item_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5('17|' || qid || '|' || item_id), item_id) <= 4),
ls AS (SELECT microcat, item_id FROM (SELECT DISTINCT item_id FROM kn) JOIN items USING (item_id) QUALIFY row_number() OVER (PARTITION BY microcat ORDER BY md5('17|' || item_id), item_id) <= 50),
cn AS (SELECT ps.qid, ls.item_id FROM ps JOIN items i ON i.item_id = ps.item_id JOIN ls ON ls.microcat = i.microcat WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.qtext = ps.qtext AND kn.item_id = ls.item_id) QUALIFY row_number() OVER (PARTITION BY ps.qid ORDER BY md5('17|' || ps.qid || '|' || ls.item_id), ls.item_id) <= 3)
SELECT qid, item_id, 1 AS label, 'positive' AS kind FROM ps UNION ALL SELECT qid, item_id, 0, 'dense' FROM dn UNION ALL SELECT qid, item_id, 0, 'category' FROM cn""")
def o147(spark, sf):
    q, c, (h, items, _, _, _) = _candidates(spark, sf)
    return P.finetune_pairs(q, h, C.rrf(c, WEIGHTS), items)


@query("o148_encoder_pairs", f"""WITH {R.CTES}, p AS (SELECT DISTINCT qtext, unnest(items) AS item_id FROM instances),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5('11|' || qtext || '|' || item_id), qtext, item_id) <= 10),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qtext ORDER BY md5('11|' || qtext || '|' || item_id), qtext, item_id) <= 50)
SELECT 'query: ' || qtext AS anchor, 'passage: ' || title || ' | ' || params AS positive FROM b JOIN items USING (item_id)""")
def o148(spark, sf):
    p = I.build_instances(R.train(spark, sf)).select("qtext", F.explode("items").alias("item_id")).distinct()
    return P.encoder_pairs(K.cap_pairs(p), R.items(spark, sf), F.concat_ws(" | ", "title", "params"), "intfloat/multilingual-e5-base")


@query("o09_external_scores", f"{_ALL}, {_TOP} SELECT qid, item_id, ce_score FROM tp")
def o09(spark, sf):
    """Scores that came back in two folders, one a range of places, read, joined and verified against the pairs."""
    top = stored(_first(spark, sf), "first")
    folders = [work_path(spark, "scores"), work_path(spark, "scores")]
    for folder, where in zip(folders, ("first_rank <= 25", "first_rank > 25")):
        _ce(top.filter(where)).withColumnRenamed("qid", "query_id").write.option("compression", "zstd").parquet(f"{folder}/scores_P2.parquet")
    return P.verified_scores(top, P.external_scores(spark, folders, "P2"))


@query("o42_reassembled", "SELECT event_id AS position, user_id, value * 2 AS score FROM events")
def o42(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_id").alias("position"), "user_id", "value")
    shards = [e.filter(F.col("position") % 3 == k).select("position", (F.col("value") * 2).alias("score")) for k in (2, 0, 1)]
    return P.reassemble(e.select("position", "user_id"), shards)


@query("o145_broken_pairs", f"""{_ALL}, {_TOP}, b AS (SELECT qid, item_id, CASE WHEN first_rank = 3 THEN NULL ELSE ce_score END AS ce_score FROM tp WHERE first_rank <> 1 UNION ALL SELECT qid, item_id, ce_score FROM tp WHERE first_rank = 2 UNION ALL SELECT qid, 'x' || item_id, 0.5 FROM tp WHERE first_rank <= 2)
SELECT (SELECT count(*) FROM tp WHERE first_rank = 1) AS left_only, (SELECT count(*) FROM tp WHERE first_rank <= 2) AS right_only, (SELECT count(*) FROM (SELECT qid, item_id FROM b GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM b WHERE ce_score IS NULL) AS null_scores""")
def o145_broken(spark, sf):
    """The pair check on scores with missing, repeated, foreign and null pairs."""
    top = stored(_first(spark, sf), "first")
    ce = _ce(top).join(top.select("qid", "item_id", "first_rank"), ["qid", "item_id"])
    b = ce.filter("first_rank <> 1").withColumn("ce_score", F.when(F.col("first_rank") != 3, F.col("ce_score")))
    b = b.unionByName(ce.filter("first_rank = 2")).unionByName(ce.filter("first_rank <= 2").withColumn("item_id", F.concat(F.lit("x"), "item_id")).withColumn("ce_score", F.lit(0.5)))
    return E.same_pairs(top, b.select("qid", "item_id", "ce_score"))


_BROKEN = """an AS (SELECT CAST(c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS query_id, list_transform(range(0, CASE WHEN c_custkey % 13 = 0 THEN 4 ELSE 5 END), lambda j: CASE WHEN c_custkey % 17 = 0 AND j = 3 THEN c_custkey * 7 % 2500 ELSE (c_custkey * 7 + j) % 2500 END) AS ids FROM customer WHERE c_custkey % 10 <> 3),
qi AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS query_id FROM customer WHERE c_custkey % 11 <> 0)"""


@query("o126_validate_broken", f"""WITH {_BROKEN}, p AS (SELECT query_id, count(*) AS n FROM an GROUP BY ALL)
SELECT 'columns' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'query id repeated', (SELECT count(*) FROM p WHERE n > 1) UNION ALL SELECT 'query id unknown', (SELECT count(*) FROM p WHERE query_id NOT IN (SELECT query_id FROM qi))
UNION ALL SELECT 'query id missing', (SELECT count(*) FROM qi WHERE query_id NOT IN (SELECT query_id FROM p)) UNION ALL SELECT 'number of ids', (SELECT count(*) FROM an WHERE len(ids) <> 5)
UNION ALL SELECT 'id repeated in an answer', (SELECT count(*) FROM an WHERE len(list_distinct(ids)) <> len(ids)) UNION ALL SELECT 'id outside the corpus', (SELECT count(*) FROM (SELECT unnest(ids) AS i FROM an) WHERE i NOT IN (SELECT p_partkey FROM part))""")
def o126_broken(spark, sf):
    """The validation of answers on a table that breaks its rules."""
    c = _read(spark, sf, "customer")
    ids = F.expr("transform(sequence(0, if(c_custkey % 13 = 0, 3, 4)), j -> cast(if(c_custkey % 17 = 0 and j = 3, c_custkey * 7 % 2500, (c_custkey * 7 + j) % 2500) as string))")
    a = c.filter("c_custkey % 10 <> 3").select(F.expr("cast(c_custkey + if(c_custkey % 50 = 0, 1, 0) as string)").alias("query_id"), F.array_join(ids, " ").alias("answer"))
    known = c.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").cast("string").alias("query_id"))
    return E.validate(a, known, _read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id")), k=5)


@query("o121_check_split_broken", f"""WITH {_PARTS}, x AS (SELECT *, false AS t2 FROM parts UNION ALL SELECT * REPLACE ('P3' AS part), true FROM parts WHERE part = 'P2'), h AS (SELECT * FROM x WHERE part <> 'P1'), t AS (SELECT qtext, count(*) AS n, count(DISTINCT part) AS p FROM h GROUP BY qtext)
SELECT 'qid repeated' AS rule, (SELECT count(*) FROM (SELECT qid FROM x GROUP BY qid HAVING count(*) > 1)) AS violations UNION ALL SELECT 'held-out text repeated', (SELECT count(*) FROM t WHERE n > 1) UNION ALL SELECT 'text in P2 and P3', (SELECT count(*) FROM t WHERE p > 1)
UNION ALL SELECT 'held-out instance without items', (SELECT count(*) FROM h WHERE t2) UNION ALL SELECT 'held-out instance thinned', (SELECT count(*) FROM h WHERE t2)""")
def o121_broken(spark, sf):
    """The split's check on parts whose P2 stands in P3 too, thinned and without items."""
    p = stored(_parts(spark, sf), "parts")
    extra = p.filter("part = 'P2'").withColumn("part", F.lit("P3")).withColumn("thinned", F.lit(True)).withColumn("items", F.array().cast("array<string>"))
    return I.check_split(p.unionByName(extra))


# ---- filters and addresses -----------------------------------------------------------------------------------------

_KEYS = {"Вид услуги": "vid", "Тип услуги": "tip"}


@query("o21_o22_o142_filter_features", """SELECT CAST(a.p_partkey AS VARCHAR) AS qid, CAST(b.p_partkey AS VARCHAR) AS item_id, flt_vid, flt_tip, coalesce(CAST(flt_vid = 1 AS INTEGER), 0) + coalesce(CAST(flt_tip = 1 AS INTEGER), 0) AS flt_match, coalesce(CAST(flt_vid = 0 AS INTEGER), 0) + coalesce(CAST(flt_tip = 0 AS INTEGER), 0) AS flt_miss
FROM (SELECT a.p_partkey, b.p_partkey AS bk, CASE WHEN a.p_partkey % 5 = 0 THEN NULL ELSE CAST(contains('Вид услуги ' || b.p_brand || ' Тип услуги ' || b.p_type, 'Вид услуги ' || a.p_brand) AS INTEGER) END AS flt_vid, CASE WHEN a.p_partkey % 5 <= 1 THEN NULL ELSE CAST(contains('Вид услуги ' || b.p_brand || ' Тип услуги ' || b.p_type, 'Тип услуги ' || a.p_type) AS INTEGER) END AS flt_tip FROM part a JOIN part b ON a.p_size = b.p_size) a JOIN part b ON a.bk = b.p_partkey""")
def o142(spark, sf):
    """Filter matches of parts asked as queries against parts of their size; one key's name begins with another's."""
    p = _read(spark, sf, "part")
    own = F.concat(F.lit("Вид услуги "), "p_brand")
    asked = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, own).otherwise(F.concat(own, F.lit(" Тип услуги автосервиса мойка Тип услуги "), "p_type"))
    q = p.select(F.col("p_partkey").cast("string").alias("qid"), "p_size", asked.alias("filters"))
    i = p.select(F.col("p_partkey").cast("string").alias("item_id"), "p_size", F.concat(own, F.lit(" Тип услуги "), "p_type").alias("params"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = q.repartition(tasks).join(small(i), "p_size").select("qid", "item_id")  # a small table's scan is one task, its pairs are many
    return P.filter_features(pairs, q, i, _KEYS, ["Тип услуги автосервиса", "Вид услуги", "Тип услуги"])


@query("o20_cities", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' область' WHEN 2 THEN n_name END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey")
def o20(spark, sf):
    """Cities of addresses made of a region, a street and a place with its kind; a region stands in where there is no city."""
    d = _read(spark, sf, "customer").join(_read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = F.col("c_custkey") % 4
    parts = F.when(m == 0, F.concat(F.lit("Северный край, город "), "n_name", F.lit(", улица Мира, 5"))).when(m == 1, F.concat(F.col("n_name"), F.lit(" область, ул. Новая"))).when(m == 2, F.concat(F.lit("пос. Юг район, г. "), "n_name"))
    return d.select("c_custkey", X.city_of(X.address_of(F.concat(F.lit("Место оказания услуг "), parts))).alias("city"))
