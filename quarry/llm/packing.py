"""Packing along a space-filling curve.

A document's token ids are hashed into a vector, projected to DIMS numbers and placed on a Hilbert curve. The curve is
cut into parts of about PART_TOKENS tokens; documents of a part, neighbours on the curve, are laid end to end into
sequences of LIMIT tokens. What is left at a part's end is cut into sequences whose lengths are powers of two, which
need no padding. The cuts follow from the exact number of tokens in each of 2 ** CELL_BITS cells of the curve, so a run
on the same table gives the same sequences; a cell with more tokens than a part (copies, say) is dealt over several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common
from .tokens import CACHE_PIECES, Encoder, crc32_u32, vocabulary

LIMIT, BUCKETS, DIMS, BITS, SPAN = 4096, 256, 4, 12, 4.0
#: Tokens of a part at least; more where there would be over MOST_PARTS parts. Cells of the curve, whose sums the driver gets.
PART_TOKENS, MOST_PARTS, CELL_BITS = 1_000_000, 20_000, 16


def project(ids: list[np.ndarray], seed: int = 3) -> np.ndarray:
    """One row of DIMS numbers a document: its hashed and normalised token counts times a fixed Gaussian matrix."""
    counts = np.array([np.bincount((x.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(12)).astype(np.int64) % BUCKETS, minlength=BUCKETS) for x in ids], float).reshape(-1, BUCKETS)
    counts = np.log1p(counts)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(norm, norm, 1) @ np.random.RandomState(seed).randn(BUCKETS, DIMS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points (n, dims) on the Hilbert curve of the given bits a dimension, after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def parts(cells: list[tuple[int, int]], least: int = PART_TOKENS) -> list[tuple[int, int, int]]:
    """(cell, first part, parts of the cell) from (cell, tokens): small neighbouring cells share a part."""
    least = max(least, -(-sum(n for _, n in cells) // MOST_PARTS))
    out, part, filled = [], 0, 0
    for cell, n in sorted(cells):
        if n > least:
            part += filled > 0
            k = -(-n // least)
            out.append((cell, part, k))
            part, filled = part + k, 0
            continue
        out.append((cell, part, 1))
        filled += n
        if filled >= least:
            part, filled = part + 1, 0
    return out


def pack(docs: DataFrame, vocab: str, end_id: int = 2, limit: int = LIMIT, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHE_PIECES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, ids): one row a piece.

    Each id of each row lies in exactly one piece. Null text counts as empty (one piece of the end id). Null ids stay
    null, repeated rows are packed as often as they occur, other columns are ignored. Ties on the curve go by id and
    text hash. An empty table gives no row. pieces: how many pieces of text a worker remembers the ids of.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(vocab, keep_space, pieces)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            if len(b):
                packed = [ids + end for ids in enc.encode(b["text"])]
                points = (project([np.frombuffer(x, enc.dtype) for x in packed]) + SPAN) / (2 * SPAN) * (1 << BITS)
                key = hilbert(np.clip(points, 0, (1 << BITS) - 1).astype(np.int64))
                yield pd.DataFrame({"doc_id": b["doc_id"], "key": key, "ids": packed, "width": enc.dtype.itemsize})

    # Ids pass through Python as strings: pandas would make numbers beside nulls floating-point.
    d = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.mapInPandas(encode, "doc_id string, key long, ids binary, width int").withColumn("doc_id", F.col("doc_id").cast("long"))
    d = d.select("*", F.xxhash64("ids").alias("tie"), F.shiftright("key", DIMS * BITS - CELL_BITS).alias("cell"), F.expr("length(ids) div width").alias("n"))
    d = common.stored(d.withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    cells = [tuple(r) for r in d.groupBy("cell").agg(F.sum("n")).collect()]  # at most 2 ** CELL_BITS rows
    where = F.broadcast(d.sparkSession.createDataFrame(parts(cells, part_tokens), "cell long, first long, k long"))
    d = d.join(where, "cell").withColumn("part", F.col("first") + F.when(F.col("k") > 1, F.expr("pmod(xxhash64(doc_id, tie, row), k)")).otherwise(0))
    d = d.select("part", "key", "doc_id", "tie", "ids", "width").repartitionByRange("part").sortWithinPartitions("part", "key", "doc_id", "tie").withColumn("doc_id", F.col("doc_id").cast("string"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"]
        current, number = None, 0
        open_, filled, width = [], 0, 2  # pieces of the sequence being filled: (doc_id, start, ids, doc_tokens)

        def close(pieces: list[tuple], size: int) -> list[tuple]:
            nonlocal number
            out, at = [], 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // width
                out.append((doc_id, start, n, crc32_u32(ids, np.dtype(f"<u{width}")), total, number, at, size, ids))
                at += n
            number += 1
            return out

        def finish() -> list[tuple]:
            """What is left at a part's end, in sequences of powers of two."""
            nonlocal open_, filled
            rows, held = [], open_[::-1]
            for size in powers(filled):
                some, left = [], size
                while left:
                    doc_id, start, ids, total = held.pop()
                    n = min(left, len(ids) // width)
                    some.append((doc_id, start, ids[: n * width], total))
                    if n * width < len(ids):
                        held.append((doc_id, start + n, ids[n * width :], total))
                    left -= n
                rows += close(some, size)
            open_, filled = [], 0
            return rows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names)

        for b in batches:
            rows = []
            for part, doc_id, ids, w in zip(b["part"], b["doc_id"], b["ids"], b["width"]):
                if part != current:
                    rows += finish()
                    current, number = part, int(part) << 40
                width = int(w)
                total, at = len(ids) // width, 0
                while at < total:
                    n = min(total - at, limit - filled)
                    open_.append((doc_id, at, ids[at * width : (at + n) * width], total))
                    at, filled = at + n, filled + n
                    if filled == limit:
                        rows += close(open_, limit)
                        open_, filled = [], 0
            if rows:
                yield frame(rows)
        if rows := finish():
            yield frame(rows)

    out = d.mapInPandas(lay, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """documents packed; nulls and repeats as in `pack`."""
    return pack(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")
