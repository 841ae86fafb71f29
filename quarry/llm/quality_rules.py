"""Quality rules by distribution divergence, native throughout.

A document's histograms of character classes and of common words are compared with language references by
Jensen-Shannon divergence (base 2; the distance is its square root). Short texts are guarded: below MIN_CHARS no
class verdict is made, below MIN_WORDS no word verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

# Shares of character classes in running prose
# (lower-case letters, upper-case letters, digits, white space, sentence marks, other signs).
CLASS_REFERENCE = {
    "en": (0.780, 0.025, 0.003, 0.170, 0.021, 0.001),
    "de": (0.790, 0.050, 0.003, 0.136, 0.020, 0.001),
    "fr": (0.770, 0.025, 0.003, 0.178, 0.023, 0.001),
    "es": (0.780, 0.022, 0.003, 0.172, 0.022, 0.001),
}
# Common words of each language with their share of running words.
WORD_REFERENCE = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.020, "is": 0.011, "that": 0.011, "it": 0.010, "for": 0.009, "was": 0.009, "on": 0.007, "with": 0.007, "be": 0.006, "by": 0.006, "this": 0.005},
    "de": {"der": 0.035, "die": 0.034, "und": 0.030, "in": 0.018, "den": 0.012, "von": 0.010, "zu": 0.010, "das": 0.010, "mit": 0.009, "sich": 0.008, "des": 0.008, "auf": 0.008, "für": 0.008, "ist": 0.008, "im": 0.008, "dem": 0.008},
    "fr": {"de": 0.045, "la": 0.030, "le": 0.024, "et": 0.020, "les": 0.020, "des": 0.017, "en": 0.014, "un": 0.012, "du": 0.012, "une": 0.011, "que": 0.010, "est": 0.010, "pour": 0.009, "qui": 0.008, "dans": 0.008, "par": 0.007},
    "es": {"de": 0.060, "la": 0.036, "que": 0.030, "el": 0.027, "en": 0.026, "y": 0.026, "los": 0.016, "a": 0.018, "del": 0.012, "se": 0.012, "las": 0.011, "por": 0.010, "un": 0.010, "para": 0.008, "con": 0.009, "una": 0.008},
}
#: Largest divergences that pass, and the guards.
MAX_CLASS_JSD, MAX_WORD_JSD, MIN_CHARS, MIN_WORDS = 0.035, 0.13, 150, 80
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(common.SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.SPACES))


def _one_of(forms: list[str]):
    return lambda x: x.isin(forms)


def _jsd(p: str, q: str) -> Column:
    """Base-2 Jensen-Shannon divergence of two arrays of shares; null if either is."""
    part = "if(x.{0} > 0, x.{0} * log2(2 * x.{0} / (x.p + x.q)), 0d)"
    return F.expr(f"aggregate(zip_with({p}, {q}, (p, q) -> struct(p, q)), 0d, (a, x) -> a + {part.format('p')} + {part.format('q')}) / 2")


def _by_lang(values: dict[str, Column], other: Column) -> Column:
    out = other
    for lang, v in values.items():
        out = F.when(F.col("lang") == lang, v).otherwise(out)
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and common (arrays of counts)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.withColumn("w", _words(F.col("text"))).withColumn("n_words", F.size("w").cast("long")).withColumn("flat", F.array_join("w", ""))
    # Windows by the hash of their words' hashes; the long way only where one repeats.
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(1), F.size("wh") - (REPEAT_WINDOW - 1))
    d = d.withColumn("win", F.when(F.size("wh") >= REPEAT_WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("wh", i, REPEAT_WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("repeats", F.size(F.array_distinct("win")) < F.size("win"))
    ordered = F.expr("array_sort(transform(win, (h, i) -> struct(h, i)))")
    d = d.withColumn("o", F.when(F.col("repeats"), ordered))
    at = F.expr(
        "array_sort(transform(filter(transform(o, (x, k) -> struct(x.i as i, "
        "(k > 0 and o[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(o) and o[least(k + 1, size(o) - 1)].h = x.h) as dup)), x -> x.dup), x -> x.i))"
    )
    d = d.withColumn("at", at)
    covered = F.expr(f"aggregate(at, struct(0L as n, 0 as e), (a, i) -> struct(a.n + i + {REPEAT_WINDOW} - greatest(i, a.e) as n, i + {REPEAT_WINDOW} as e), a -> a.n)")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    flat = F.col("flat")
    left = lambda pattern: F.length(F.regexp_replace(flat, pattern, ""))
    d = d.select(
        "doc_id", "lang", "n_words", "w",
        F.length("text").cast("long").alias("n_chars"),
        F.length("flat").cast("long").alias("word_chars"),
        (F.length("flat") - left(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("flat") - left(r"\p{Lu}+")).cast("long").alias("upper"),
        (F.length("flat") - left(r"\p{Nd}+")).cast("long").alias("digit"),
        (F.length("flat") - left(r"[.,;:!?'\"()\-]+")).cast("long").alias("marks"),
        (F.length("flat") - left(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("ascii_signs"),
    )
    hits = F.lit(None).cast("array<string>")
    for lang, ref in WORD_REFERENCE.items():
        hits = F.when(F.col("lang") == lang, F.filter("w", _one_of([*ref, *[x.capitalize() for x in ref]]))).otherwise(hits)
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_chars", "upper", "digit", "marks", "ascii_signs",
        F.when(F.col("n_words") >= MIN_WORDS, F.lower(F.concat(F.lit("|"), F.array_join(hits, "||"), F.lit("|")))).alias("hits"),
    )


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of docs: the base counts, base_failed, class_jsd, word_jsd (null where guarded) and kept.

    Null text counts as empty (and fails the base rule). A null or unknown language is compared with the mean of the
    class references and gets no word verdict. Repeated rows repeat; other columns are ignored.
    """
    d = features(docs, id_col, text_col, lang_col)
    signs = F.greatest(F.col("ascii_signs") - F.col("marks"), F.lit(0))
    counts = [F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("ascii_signs"), F.col("upper"), F.col("digit"), F.col("n_chars") - F.col("word_chars"), F.col("marks"), signs]
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    mean = [sum(v) / len(CLASS_REFERENCE) for v in zip(*CLASS_REFERENCE.values(), strict=True)]
    d = d.withColumn("p_class", F.when(F.col("n_chars") >= MIN_CHARS, F.transform(F.array(*counts), lambda c: c / F.col("n_chars"))))
    d = d.withColumn("q_class", _by_lang({k: numbers(v) for k, v in CLASS_REFERENCE.items()}, numbers(mean)))
    # Histogram of the language's common words and the rest; each hit stands between bars, so a count is a length lost.
    d = d.withColumn("common", _by_lang({k: F.array(*[F.lit(f"|{w}|") for w in v]) for k, v in WORD_REFERENCE.items()}, F.lit(None).cast("array<string>")))
    d = d.withColumn("p_word", F.expr("transform(common, k -> (length(hits) - length(replace(hits, k, ''))) / length(k) / n_words)"))
    d = d.withColumn("p_word", F.expr("concat(p_word, array(greatest(1 - aggregate(p_word, 0d, (a, x) -> a + x), 0d)))"))
    d = d.withColumn("q_word", _by_lang({k: numbers([*v.values(), 1 - sum(v.values())]) for k, v in WORD_REFERENCE.items()}, F.lit(None).cast("array<double>")))
    class_jsd, word_jsd = _jsd("p_class", "q_class"), _jsd("p_word", "q_word")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("class_jsd", class_jsd).withColumn("word_jsd", word_jsd).withColumn("base_failed", base_failed)
    ok = ~F.col("base_failed") & F.coalesce(F.col("class_jsd") <= MAX_CLASS_JSD, F.lit(True)) & F.coalesce(F.col("word_jsd") <= MAX_WORD_JSD, F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept"), "class_jsd", "word_jsd")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of documents; nulls and repeats as in `rules`."""
    return rules(common.table(spark, sf_dir, "documents")).drop("class_jsd", "word_jsd")


def _sql_case(values: dict[str, str], other: str) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def oracle_sql() -> str:
    mean = [sum(v) / len(CLASS_REFERENCE) for v in zip(*CLASS_REFERENCE.values(), strict=True)]
    q_class = _sql_case({k: str([float(x) for x in v]) for k, v in CLASS_REFERENCE.items()}, str(mean))
    common_words = _sql_case({k: str([*v]) for k, v in WORD_REFERENCE.items()}, "NULL")
    q_word = _sql_case({k: str([*v.values(), 1 - sum(v.values())]) for k, v in WORD_REFERENCE.items()}, "NULL")
    jsd = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)) / 2"
    left = lambda pattern: f"(length(flat) - length(regexp_replace(flat, '{pattern}', '', 'g')))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT rid, i, array_to_string(w[i + 1 : i + 8], ' ') AS win FROM (SELECT rid, w, unnest(range(0, len(w) - 7)) AS i FROM s WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
f AS (SELECT s.*, array_to_string(w, '') AS flat, len(w) AS n, coalesce(n_rep, 0) AS n_rep, {common_words} AS ks, {q_class} AS qc, {q_word} AS qw FROM s LEFT JOIN rep USING (rid)),
c AS (SELECT *, {left(r'\p{Lu}+')} AS up, {left(r'\p{Nd}+')} AS dg, {left(r"[.,;:!?''\x22()\-]+")} AS mk, {left(r'[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')} AS sg,
      list_transform(ks, lambda k: len(list_filter(w, lambda x: x = k OR x = upper(k[1]) || k[2:])) / n) AS pk FROM f),
j AS (SELECT *, n < 20 OR 100 * n_rep > 30 * n AS failed,
      CASE WHEN length(text) >= {MIN_CHARS} THEN {jsd("list_transform([length(flat) - up - dg - sg, up, dg, length(text) - length(flat), mk, greatest(sg - mk, 0)], lambda z: z / length(text))", "qc")} END AS cj,
      CASE WHEN n >= {MIN_WORDS} AND ks IS NOT NULL THEN {jsd("list_concat(pk, [greatest(1 - list_sum(pk), 0)])", "qw")} END AS wj FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(flat) AS BIGINT) AS word_chars, CAST({left(r"[#*$%&|<>]+")} AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND coalesce(cj <= {MAX_CLASS_JSD}, true) AND coalesce(wj <= {MAX_WORD_JSD}, true) AS kept
FROM j
"""


SQL = oracle_sql()
