"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. A logistic model over surface features is fitted on a bounded sample of labelled rows (SAMPLE_ROWS).
2. Every document's class probability is turned into evidence (log odds beyond the sample's base rate).
3. Posteriors: per host and per path the expected numbers of good and bad documents are summed by grouped
   aggregation over all documents. The global rate is the prior of each host, the host's posterior that of its paths.
   How hard sparse sites shrink follows from the spread of the rates (method of moments).
4. A document's verdict adds its evidence to the log odds of its path's posterior, its own share left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Labelled rows used for fitting: those with the smallest hashed ids, at most so many.
SAMPLE_ROWS = 4096
#: Bounds on prior strengths, in documents, and the number of sites up to which their table is broadcast.
LEAST_STRENGTH, MOST_STRENGTH, BROADCAST_SITES = 5.0, 1000.0, 100_000
#: A document goes if the odds of being good are below this; low, as dropping good text costs more than keeping bad.
KEEP_PROBABILITY = 0.35
SIGNS = b"#*$%&|<>{}[]\\^~=@_+"
FEATURES = ["log_words", "upper", "digit", "signs", "bangs", "distinct", "word_bytes", "line_repeat", "top_word", "short"]


def surface(text: str | None) -> list[float]:
    """Features of the whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digit = size - len(raw.translate(None, b"0123456789"))
    signs = size - len(raw.translate(None, SIGNS))
    bangs = size - len(raw.translate(None, b"!?"))
    return [
        math.log1p(n),
        min(upper / size, 0.3) * 5,
        min(digit / size, 0.3) * 5,
        math.sqrt(min(signs / size, 0.25)) * 4,
        math.sqrt(min(bangs / size, 0.25)) * 4,
        len(seen) / n ** 0.85,
        min(len(raw) / n, 40) / 10,
        1 - len(set(lines)) / max(len(lines), 1),
        max(seen.values()) / n if n >= 20 else 0.1,
        float(n < 20),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant comes last and is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    w, pen = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and their products with log_words."""
    return np.c_[x, x**2, x[:, 1:] * x[:, :1]]


def model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """(weights, base log odds), fitted on at most sample_rows labelled documents. Rows with a null label or id are left out."""
    chosen = (
        labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("y")).filter("l_id is not null and y is not null")
        .dropDuplicates(["l_id"]).orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [surface(t) for t in b["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("y", "text").mapInPandas(run, "y double, x array<double>").limit(2 * sample_rows).toPandas()
    if len(rows) < 10 or rows["y"].nunique() < 2:
        return np.r_[np.zeros(3 * len(FEATURES) - 1), 2.0], 2.0  # nothing to learn from: no evidence, all stay
    y = (rows["y"].to_numpy() > 0).astype(float)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return fit(expand(np.array(rows["x"].tolist())), y), math.log(base / (1 - base))


def evidence(text: Column, weights: np.ndarray, base: float) -> Column:
    """Log odds of good beyond the base rate, within 12 either way."""
    w = weights.tolist()

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        x = expand(np.array([surface(t) for t in texts]))
        k = np.array(w)
        return pd.Series(np.clip(x @ k[:-1] + k[-1] - base if len(k) == x.shape[1] + 1 else np.zeros(len(x)), -12, 12))

    return run(text)


def posteriors(scores: DataFrame) -> DataFrame:
    """(host, path, path_n, path_good, host_rate, path_rate) from (host, path, p): two levels of shrinkage."""
    path = common.stored(scores.groupBy("host", "path").agg(F.count("*").cast("double").alias("path_n"), F.sum("p").alias("path_good")), "quality-paths")
    host = path.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    world = host.agg(F.coalesce(F.sum("host_n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("host_good"), F.lit(0.0)).alias("good")).first()
    rate = float(np.clip(world["good"] / world["n"] if world["n"] else 0.5, 1e-3, 1 - 1e-3))
    spread = host.agg(F.sum("host_n").alias("n"), F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, 2)).alias("ss")).first()
    k_host = float(np.clip(rate * (1 - rate) / max((spread["ss"] or 0) / max(spread["n"] or 1, 1), 1e-9) - 1, LEAST_STRENGTH, MOST_STRENGTH))
    host = host.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host)).select(F.col("host").alias("h"), "host_rate")
    both = path.join(host, F.expr("host <=> h")).drop("h")
    spread = both.agg(F.sum("path_n").alias("n"), F.sum(F.col("path_n") * F.pow(F.col("path_good") / F.col("path_n") - F.col("host_rate"), 2)).alias("ss")).first()
    k_path = float(np.clip(rate * (1 - rate) / max((spread["ss"] or 0) / max(spread["n"] or 1, 1), 1e-9) - 1, LEAST_STRENGTH, MOST_STRENGTH))
    return both.withColumn("k_path", F.lit(k_path)).withColumn("path_rate", (F.col("path_good") + k_path * F.col("host_rate")) / (F.col("path_n") + k_path))


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with `q_evidence`, `q_host`, `q_path`, `q_probability` and `q_keep`, one row per row of docs.

    host_col names the site, path_col its section. Null hosts or paths form a site of their own; null text counts as
    empty. Without usable labels every document has zero evidence and stays. Repeated rows repeat. Input columns of
    these names are replaced.
    """
    weights, base = model(docs, labels, sample_rows)
    docs = docs.drop("q_evidence", "q_host", "q_path", "q_probability", "q_keep")
    host, path = F.col(host_col).cast("string"), F.col(path_col).cast("string")
    p_doc = lambda e: 1 / (1 + F.exp(-(e + F.lit(base))))
    scores = docs.select(host.alias("host"), path.alias("path"), p_doc(evidence(F.col("text"), weights, base)).alias("p"))
    # One column of the site's numbers and one of the document's, under names that docs does not have.
    site, own = common.fresh(docs, "site"), common.fresh(docs, "own")
    sites = common.small(common.stored(posteriors(scores).select(F.struct("*").alias(site)), "quality-sites"), BROADCAST_SITES)
    at = lambda k: F.col(f"{site}.{k}")
    out = docs.withColumn(own, evidence(F.col("text"), weights, base)).join(sites, host.eqNullSafe(at("host")) & path.eqNullSafe(at("path")), "left")
    prior = (F.greatest(at("path_good") - p_doc(F.col(own)), F.lit(0.0)) + at("k_path") * at("host_rate")) / (F.greatest(at("path_n") - 1, F.lit(0.0)) + at("k_path"))
    prior = F.least(F.greatest(prior, F.lit(1e-3)), F.lit(1 - 1e-3))
    probability = 1 / (1 + F.exp(-(F.col(own) + F.log(prior / (1 - prior)))))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(own).alias("q_evidence"), at("host_rate").alias("q_host"), at("path_rate").alias("q_path"),
        probability.alias("q_probability"), (probability >= KEEP_PROBABILITY).alias("q_keep"),
    )


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Evidence, posteriors and verdicts of documents; nulls and repeats as in `classify`."""
    out = classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", *[F.round(c, 6).alias(c) for c in ("q_evidence", "q_host", "q_path", "q_probability")], F.col("q_keep").alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those the classifier rejects, with the same columns; nulls, ties and empty tables as in `classify`."""
    keep = common.fresh(docs, "keep")
    plain = [c for c in docs.columns if c.startswith("q_")]  # classify replaces its own names
    held = docs.select("*", F.struct(*plain).alias(keep)) if plain else docs
    out = classify(held, labels).filter("q_keep")
    return out.select(*[(F.col(f"{keep}.`{c}`").alias(c) if c in plain else F.col(f"`{c}`")) for c in docs.columns])
