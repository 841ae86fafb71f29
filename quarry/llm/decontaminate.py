"""Benchmark decontamination by a positional inverted index, native throughout.

The index: postings (term, document, position) of the training text, each with the tokens around its position, for
the terms that are the rarest of some benchmark window. A window's lists are intersected from that rarest term:
its postings, moved back by the term's offset, are the candidate starts, and the posting's neighbouring tokens stand
for the other offset-adjusted lists, so that no further list has to be shuffled. Corpus counts cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, in upper- or lower-case text.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 8
#: Rows up to which tables made from the benchmark are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Null: no words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def windows(bench: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(win array, items array): distinct windows of the benchmark, with the items that hold them."""
    w = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """(doc_id, doc_key, term, pos, left, around): the index of the given terms; `around` holds the tokens from pos - left."""
    return (
        docs.select("doc_id", "doc_key", "w", F.posexplode("w").alias("pos", "term"))
        .join(terms, "term")
        .select("doc_id", "doc_key", "term", "pos", F.least("pos", F.lit(around)).alias("left"), F.expr(f"slice(w, greatest(pos - {around}, 0) + 1, {around} + 1 + least(pos, {around}))").alias("around"))
    )


def occurrences(docs: DataFrame, bench: DataFrame, width: int, id_col: str, text_col: str, item_col: str, bench_text: str, slop: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc_key, w) of each row of docs, and its postings of the windows' rarest terms, `exact` where the window stands."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text", F.length("text")).alias("doc_key"), words(F.col("text")).alias("w"))
    win = common.stored(windows(bench, width, item_col, bench_text), "decon-windows")
    small = lambda df: common.small(df, BROADCAST_ROWS)
    vocab = win.select(F.explode("win").alias("term")).distinct()
    counts = keyed.select(F.explode("w").alias("term")).join(small(vocab), "term").groupBy("term").agg(F.count("*").alias("n"))
    terms = win.select("win", "items", F.posexplode("win").alias("offset", "term")).join(common.stored(counts, "decon-counts"), "term", "left")
    # A term that no document holds is the rarest of all: its window can't occur.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("r")
    anchors = common.stored(terms.groupBy("win").agg(rarest, F.first("items").alias("items")).filter("r.n > 0").select("win", "items", "r.offset", "r.term"), "decon-anchors")

    found = postings(keyed, small(anchors.select("term").distinct()), width - 1 + slop).join(small(anchors), "term")
    exact = F.expr("if(left >= offset, slice(around, greatest(left - offset, 0) + 1, size(win)) = win, false)")
    return keyed, found.withColumn("exact", exact)


def scan(docs: DataFrame, bench: DataFrame, width: int = WINDOW, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", slop: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_near_items counts items with a window of which all words but two occur within `slop` words of where the rarest
    one puts them, in any order (proximity match; exact matches count too). Null or wordless text: zeros and the hash
    of the empty string. Rows are told apart by id and text, so repeated rows repeat, and rows with null id are kept.
    Items with null id count as no item; null benchmark texts and an empty benchmark match nothing. Other columns are
    ignored.
    """
    keyed, found = occurrences(docs, bench, width, id_col, text_col, item_col, bench_text, slop)
    near = F.expr(f"size(array_intersect(win, slice(around, greatest(left - offset - {slop}, 0) + 1, size(win) + 2 * {slop}))) >= size(array_distinct(win)) - 2")
    found = found.withColumn("near", F.expr("size(win) > 4") & near | F.col("exact"))
    hits = (
        found.filter("exact or near")
        .groupBy("doc_id", "doc_key")
        .agg(
            F.collect_set(F.when(F.col("exact"), F.struct((F.col("pos") - F.col("offset")).alias("s"), (F.col("pos") - F.col("offset") + F.size("win")).alias("e")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("items")))))).alias("items"),
            F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("near"), F.col("items")))))).alias("near"),
        )
        .withColumn("n_hit", F.expr("aggregate(array_sort(spans), struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(x.e - greatest(x.s, a.e), 0) as n, greatest(a.e, x.e) as e), a -> a.n)"))
        .select(F.col("doc_id").alias("h_id"), F.col("doc_key").alias("h_key"), "n_hit", "items", "near")
    )
    all_docs = keyed.select("doc_id", "doc_key", F.size("w").cast("long").alias("n_words"))
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return all_docs.join(hits, F.expr("doc_id <=> h_id and doc_key = h_key"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """documents scanned for benchmark; nulls, repeats and empty tables as in `scan`."""
    out = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contained(docs: DataFrame, bench: DataFrame, min_hit: int = 16) -> DataFrame:
    """(doc_id, doc_key, item): items of which a document's text holds enough words, counted for each item by itself.

    The item's words that lie in its windows found in the document are counted. Enough are min_hit, or in shorter items
    as many as are left in windows when one word of the item is changed (all but WINDOW), but at least one window.
    """
    w = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("item is not null and size(w) > 0")
    w = w.select("item", F.xxhash64("w").alias("text"), "w", F.size("w").alias("n")).distinct()
    places = w.select("item", "text", "n", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))).alias("s"))
    places = places.select("item", "text", "n", "s", F.expr(f"slice(w, s + 1, {WINDOW})").alias("win"))
    _, found = occurrences(docs, bench, WINDOW, "doc_id", "text", "item_id", "text", 0)
    hits = found.filter("exact").select("doc_id", "doc_key", "win").distinct().join(common.small(common.stored(places, "decon-places"), BROADCAST_ROWS), "win")
    held = hits.groupBy("doc_id", "doc_key", "item", "text", "n").agg(F.collect_set(F.struct("s", (F.col("s") + F.size("win")).alias("e"))).alias("spans"))
    n_hit = F.expr("aggregate(array_sort(spans), struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(x.e - greatest(x.s, a.e), 0) as n, greatest(a.e, x.e) as e), a -> a.n)")
    return held.filter(n_hit >= F.expr(f"least({min_hit}, greatest(n - {WINDOW}, least(n, {WINDOW})))")).select("doc_id", "doc_key", "item").distinct()


def drop_contaminated(docs: DataFrame, bench: DataFrame, min_items: int = 1, min_hit: int = 16) -> DataFrame:
    """docs without the rows whose text contains at least min_items items (`contained`), the stage's rule.

    Rows go by id and text: other texts of the same id stay, rows with a null id go like any other. Null, empty and
    wordless texts stay; without usable items all rows stay. Input columns stay as they are.
    """
    found = contained(docs, bench, min_hit).groupBy("doc_id", "doc_key").count().filter(f"count >= {min_items}")
    found = found.select(F.col("doc_id").alias("f_id"), F.col("doc_key").alias("f_key")).alias("found")
    mark = common.fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text", F.length("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("found.f_id")) & (F.col(f"d.{mark}") == F.col("found.f_key"))
    return marked.join(found, same, "left_anti").drop(mark)


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 8], ' ') AS win, len(w[i + 1 : i + 8]) AS n
        FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, i, dw.n FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
