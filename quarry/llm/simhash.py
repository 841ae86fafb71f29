"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 8 * B bits has B positional bytes. Fingerprints that differ in at most d bits share at least B - d
positional bytes: the guaranteed minimum. The index posts each distinct fingerprint under tuples of (position, byte);
fingerprints that meet are tallied (shared positional bytes against the minimum) and then verified (differing bits).

Lists of one positional byte would hold 1/256 of the corpus each, so their pairs would grow with its square. Lists
are keyed by three positional bytes instead. For 64 bits and d <= 3, at least 5 of 8 bytes agree, hence at least 3 in
one half of the fingerprint: the eight triples within the halves lose no pair. Wide fingerprints (pipeline stage) use
many triples, `spread_triples`; the chance of missing a pair there is stated in that function.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Triples whose lists join large groups first, how often; members of a block, within and between which links are spanning forests.
FIRST, STEPS, BLOCK = 16, 2, 512
SHINGLES_AT_ONCE = 50_000


def half_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions within either half of 8: any 5 positions hold one of them."""
    return [*itertools.combinations(range(4), 3), *itertools.combinations(range(4, 8), 3)]


def spread_triples(n_bytes: int, n: int, seed: int = 7) -> list[tuple[int, int, int]]:
    """n triples that use each position equally often.

    With a share p of differing bits, a pair meets in one list with chance (1 - p) ** 24. At 192 triples the chance
    that it meets nowhere is 2 % for p = 0.1515 (Jaccard 0.8), under 0.1 % for p = 0.13 (0.85), 1e-6 for p = 0.104 (0.9).
    """
    rng, out = np.random.RandomState(seed), []
    while len(out) < n:
        p = rng.permutation(n_bytes)
        out += [tuple(sorted(int(x) for x in p[i : i + 3])) for i in range(0, n_bytes - 2, 3)]
        out = list(dict.fromkeys(out))
    return out[:n]


def _mix(h: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * j) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, ngram: int, n_bits: int = 64, seed: int = 42) -> bytes:
    """Big-endian bits of the SimHash; the first 64 come from each shingle's XXH64, further ones from mixes of it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(n_bits // 8)
    n, ones = max(1, len(words) - ngram + 1), np.zeros(n_bits, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at : at + SHINGLES_AT_ONCE + ngram - 1]
        k = min(SHINGLES_AT_ONCE, n - at)
        h = np.array([xxhash.xxh64_intdigest(b" ".join(part[i : i + ngram]), seed) for i in range(k)], np.uint64)
        for j in range(n_bits // 64):
            bits = np.unpackbits((_mix(h, j) if j else h).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[64 * j : 64 * j + 64] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, ngram: int, n_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary) for each row. Null or wordless text: all bits zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["i"], "fp": [fingerprint(t, ngram, n_bits) for t in b["t"]]})

    d = docs.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(text_col).alias("t"))  # pandas would make numbers beside nulls floating-point
    return d.mapInPandas(run, "doc_id string, fp binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _bits(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)


def _forest(nodes: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between these nodes: the same components as all their links."""
    order = np.argsort(nodes, kind="stable")
    nodes, fp = nodes[order], fp[order]
    left, out = np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]).sum(1) <= max_bits
            hit = left[near]
            out += [(int(nodes[u]), int(nodes[v])) for v in hit]
            queue += list(hit)
            left = left[~near]
    return out


def _postings(reps: DataFrame, triples: list[tuple[int, int, int]]) -> DataFrame:
    """(key, node, label): each fingerprint of reps (node, fp, label) in the list of each triple's bytes."""
    cols = np.array(triples)

    def post(batches):
        for b in batches:
            if len(b):
                m = np.frombuffer(b"".join(b["fp"]), np.uint8).reshape(len(b), -1).astype(np.int64)
                key = (m[:, cols[:, 0]] << 16) | (m[:, cols[:, 1]] << 8) | m[:, cols[:, 2]] | (np.arange(len(cols))[None, :] << 24)
                yield pd.DataFrame({"key": key.ravel(), **{c: np.repeat(b[c].to_numpy(), len(cols)) for c in ("node", "label")}})

    return reps.select("node", "fp", "label").mapInPandas(post, "key long, node long, label long")


def _verified(pairs: DataFrame, reps: DataFrame, max_bits: int) -> DataFrame:
    """Those pairs (a, b, ...) with the guaranteed number of shared bytes (the tally) and at most max_bits differing bits."""

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        diff = _bits(x) ^ _bits(y)
        n_bytes = diff.shape[1] * 8
        shared = (diff.view(np.uint8) == 0).sum(1)
        return pd.Series((shared >= n_bytes - max_bits) & (np.bitwise_count(diff).sum(1) <= max_bits))

    left, right = (reps.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").filter(close("fp_a", "fp_b")).select(*pairs.columns)


def _contracted(labelled: DataFrame, triples: list[tuple[int, int, int]], max_bits: int) -> DataFrame:
    """labelled (node, fp, label) with labels merged over links in the lists of these triples.

    Each member meets its list's first member and its predecessor, by label, unless their labels are equal. Of those
    that a member meets, the one with the largest tally (lists that both are in) and the smallest are verified: two
    pairs a member at most, however many lists. Labels are merged, not nodes.
    """
    w = Window.partitionBy("key").orderBy("label", "node")
    met = _postings(labelled, triples)
    for name, take in (("prev", F.lag), ("low", lambda c: F.first(c))):
        met = met.withColumn(name, take("node").over(w)).withColumn(f"{name}_label", take("label").over(w))
    other = lambda n: F.when(F.col(f"{n}_label") != F.col("label"), F.struct(F.col(n).alias("a"), F.col(f"{n}_label").alias("la")))
    met = met.select(F.explode(F.array_distinct(F.array_compact(F.array(other("low"), other("prev"))))).alias("o"), F.col("node").alias("b"), F.col("label").alias("lb"))
    tally = met.groupBy("b", "lb", "o").agg(F.count("*").alias("n"))
    best = tally.groupBy("b", "lb").agg(F.max(F.struct("n", "o")).alias("most"), F.min("o").alias("least"))
    pairs = best.select(F.explode(F.array_distinct(F.array("most.o", "least"))).alias("o"), "b", "lb").select("o.a", "b", F.col("o.la").alias("la"), "lb")
    ends = _verified(pairs, labelled, max_bits).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = common.connected_components(ends).select(F.col("node").alias("label"), F.col("root"))
    out = labelled.join(merged, "label", "left").select("node", "fp", F.coalesce("root", "label").alias("label"))
    return common.stored(out, "simhash-labels")


def links(reps: DataFrame, triples: list[tuple[int, int, int]], max_bits: int) -> DataFrame:
    """(a, b): links among distinct fingerprints, given one (node long, fp binary) row each; components are those of all links."""
    labelled, between = _labels(reps, triples, max_bits)
    return labelled.filter("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(between)


def groups(reps: DataFrame, triples: list[tuple[int, int, int]], max_bits: int) -> DataFrame:
    """(node, root) of every (node, fp) of reps. Only links between labels go through the search for components."""
    labelled, between = _labels(reps, triples, max_bits)
    roots = common.connected_components(between).select(F.col("node").alias("label"), "root")
    return labelled.select("node", "label").join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def _labels(reps: DataFrame, triples: list[tuple[int, int, int]], max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(node, fp, label) and (a, b): links between labels.

    First, the lists of a few triples join large groups of near copies (`_contracted`), whose components are the labels
    of what follows. That goes through all lists and compares all members that differ in label, so no link between
    two labels is lost; lists of one label need nothing. Lists of two are verified as pairs. Longer ones are sorted by
    label and cut into blocks; two blocks meet unless both hold one and the same label.
    """
    w = Window.partitionBy("key")
    labelled = reps.select("node", "fp", F.col("node").alias("label"))
    for _ in range(STEPS):
        labelled = _contracted(labelled, triples[:FIRST], max_bits)

    ordered = w.orderBy("label", "node")
    members = _postings(labelled, triples).select(
        "key", "node", "label",
        F.row_number().over(ordered).alias("at"),
        F.count("*").over(w).alias("n"),
        F.min("label").over(w).alias("low"),
        F.max("label").over(w).alias("high"),
        F.lag("node").over(ordered).alias("prev"),
        F.lag("label").over(ordered).alias("prev_label"),
    ).filter("low < high and (n > 2 or prev is not null)")
    members = common.stored(members, "simhash-met")
    short = members.filter("n = 2").select(F.col("node").alias("a"), F.col("prev").alias("b"), F.col("label").alias("la"), F.col("prev_label").alias("lb")).distinct()
    short = _verified(short, reps, max_bits).select(F.col("la").alias("a"), F.col("lb").alias("b"))

    def forest(batches):
        for b in batches:  # Arrow: lists of one label and fingerprint each, of equal width
            lists, out = b.column(0), []
            packed, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            if not len(packed):
                continue
            raw = np.frombuffer(b"".join(x.as_buffer() for x in packed), np.uint8).reshape(len(packed), -1)
            nodes, fp = np.ascontiguousarray(raw[:, :8]).view(">i8").ravel().astype(np.int64), np.ascontiguousarray(raw[:, 8:]).view(np.uint64)
            for i, j in zip(bounds[:-1], bounds[1:]):
                out += _forest(nodes[i:j], fp[i:j], max_bits)
            ends = np.unique(np.array([x for x in out if x[0] != x[1]], np.int64).reshape(-1, 2), axis=0)
            yield pa.RecordBatch.from_pydict({"a": ends[:, 0], "b": ends[:, 1]})

    blocks = members.filter("n > 2")
    runs = blocks.groupBy("key", "label").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter(F.col("hi") - F.col("lo") >= BLOCK - 1)
    runs = runs.select("key", "label", F.ceil((F.col("lo") - 1) / BLOCK).alias("lo"), (F.floor(F.col("hi") / BLOCK) - 1).alias("hi"))  # blocks of that label only
    blocks = blocks.join(runs, ["key", "label"], "left").withColumn("block", F.expr(f"(at - 1) div {BLOCK}")).withColumn("last", F.expr(f"(n - 1) div {BLOCK}"))
    others = F.expr("case when block between lo and hi then filter(sequence(0, last), x -> x < lo or x > hi) else sequence(0, last) end")
    long = (
        blocks.select("key", "node", "label", "block", F.explode(others).alias("other"))
        .join(reps.select("node", "fp"), "node")
        .groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.collect_list(F.concat(F.unhex(F.lpad(F.hex("label"), 16, "0")), "fp")).alias("rows"))
        .select("rows")
        .mapInArrow(forest, "a long, b long")
    )
    return labelled, short.unionByName(long).distinct()


def components(docs: DataFrame, ngram: int = 3, n_bits: int = 64, max_bits: int = 3, triples: list[tuple[int, int, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", wordless_links: bool = True) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Equal fingerprints count as linked. Null and wordless texts have the zero fingerprint; they link like any other, or
    without wordless_links among themselves only.
    Repeated rows repeat in the result. Rows with a null id get their fingerprint and their component and link others,
    but never name one; a component of such rows alone is null. Empty input: empty result. Other columns are ignored.
    """
    fps = common.stored(fingerprints(docs, ngram, n_bits, id_col, text_col), "simhash-fp")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    reps = common.stored(reps, "simhash-reps")
    linkable = reps.select("node", "fp").filter(F.lit(wordless_links) | (F.col("fp") != F.lit(bytes(n_bits // 8))))
    rooted = reps.join(groups(linkable, triples or half_triples(), max_bits), "node", "left")
    rooted = common.stored(rooted.select("fp", "low", F.coalesce("root", "node").alias("root")), "simhash-roots")
    label = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(label, "fp")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of documents; nulls and repeats as in `components`."""
    out = components(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Pipeline stage: 512 bits of five-word shingles; a similarity of 0.8 is a share of 0.8 equal bits.
STAGE = {"ngram": 5, "n_bits": 512, "max_bits": 102}


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group holds a smaller doc_id.

    A group: documents connected by links of at least 0.8 equal bits of 512-bit fingerprints of five-word shingles.
    Texts without words are copies of each other and near no other. Rows that repeat one doc_id count as one document
    and stay together; rows with a null id stay.
    """
    triples = spread_triples(STAGE["n_bits"] // 8, 192)
    comp = components(docs, STAGE["ngram"], STAGE["n_bits"], STAGE["max_bits"], triples, id_col, text_col, wordless_links=False)
    gone = comp.filter("doc_id > component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
