"""Token ids as seekable files of independent zstandard frames.

Layout: data frames; one skippable frame (magic 0x184D2A50) with the document index; the seek table of the public
seekable format (skippable frame 0x184D2A5E: per frame its compressed size, its content size and the low 32 bits of
the content's XXH64; then the number of frames, a descriptor byte and 0x8F92EAB1). Any zstandard tool can decompress
such a file. A document that fits in a frame is never cut, longer ones get frames of their own, so a reader touches
only the frames of the documents it was asked for. The index's own entry has content size 0.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .tokens import Encoder, crc32_u32, vocabulary

INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, FILE_BYTES, LEVEL = 1 << 16, 256 << 20, 1


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder's URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else "/" + uri)


class Writer:
    """Writes documents in the order given; content beyond one frame is not held."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype, self.z = out, np.dtype(dtype), zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.buf, self.ids, self.counts, self.total = bytearray(), [], [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.z.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.buf:
            self._frame(bytes(self.buf))
            self.buf.clear()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(self.buf) + len(ids) > FRAME_BYTES:
            self._flush()
        if len(ids) > FRAME_BYTES:
            for at in range(0, len(ids), FRAME_BYTES):
                self._frame(ids[at : at + FRAME_BYTES])
        else:
            self.buf += ids
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.total += len(ids)

    def close(self) -> None:
        self._flush()
        n = len(self.ids)
        known = np.array([x is not None for x in self.ids], bool)
        raw = struct.pack("<BQ", self.dtype.itemsize, n) + known.tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        index = self.z.compress(raw)
        frame = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        self.out.write(frame)
        self.entries.append((len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file; `f` is a seekable binary file of `size` bytes."""

    def __init__(self, f, size: int):
        self.f, self.z = f, zstandard.ZstdDecompressor()
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC or flags & 0x80 == 0:
            raise ValueError("no seek table with checksums at the end of the file")
        f.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.r_[0, np.cumsum(self.frames[:, 0])]
        self.content = np.r_[0, np.cumsum(self.frames[:, 1])]
        f.seek(int(self.at[n - 1]))
        magic, length = struct.unpack("<II", f.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        raw = self.z.decompress(f.read(length))
        width, m = struct.unpack_from("<BQ", raw)
        known = np.frombuffer(raw, bool, m, 9)
        ids = np.frombuffer(raw, "<i8", m, 9 + m)
        self.ids = [int(x) if k else None for x, k in zip(ids, known)]
        self.counts = np.frombuffer(raw, "<i8", m, 9 + 9 * m)
        self.dtype = np.dtype(f"<u{width}")
        self.starts = np.r_[0, np.cumsum(self.counts)]
        self.held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.f.seek(int(self.at[k]))
            raw = self.z.decompress(self.f.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, raw)
            self.frames_read += 1
        return self.held[1]

    def document(self, i: int) -> bytes:
        """Packed ids of the i-th document; decompresses its frames only."""
        begin, end = (int(x) * self.dtype.itemsize for x in self.starts[i : i + 2])
        out, k = [], int(np.searchsorted(self.content, begin, "right")) - 1
        while begin < end:
            base = int(self.content[k])
            raw = self._frame(k)
            out.append(raw[begin - base : end - base])
            begin, k = base + len(raw), k + 1
        return b"".join(out)


def write(docs: DataFrame, folder: str, vocab: str, end_id: int = 0, keep_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs in ascending id order and returns the manifest (part, seq, path, n_docs, n_tokens, base), one row a file.

    Files follow one another by (part, seq); base counts the ids of all files before. A task that runs again writes
    new files under new names; only those of the attempt that succeeded are in the manifest. Null text: empty; null
    ids come first; rows with equal ids keep to each other, ordered by their text's hash. An empty table has no file.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    d = d.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make numbers beside nulls floating-point

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, seq = Encoder.of(vocab, keep_space), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out = writer = name = None

        def done():
            writer.close()
            out.close()
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [name], "n_docs": [len(writer.ids)], "n_tokens": [writer.total // enc.dtype.itemsize]})

        for b in batches:
            for doc_id, ids in zip(b["doc_id"], enc.encode(b["text"])):
                if writer is None:
                    name = f"{base}/tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.zst"
                    out = store.open_output_stream(name, compression=None)
                    writer = Writer(out, enc.dtype)
                writer.add(int(doc_id) if isinstance(doc_id, str) else None, ids + end)
                if writer.total >= FILE_BYTES:
                    yield done()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    files = common.stored(d.mapInPandas(run, "part int, seq int, path string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents, or of those asked for, from the files alone.

    An id that occurs more than once gives as many rows, an unknown one none; None asks for null ids; an empty manifest
    gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = filesystem(folder)
        wanted = None if doc_ids is None else set(doc_ids)
        for b in batches:
            for path, base in zip(b["path"], b["base"]):
                with store.open_input_file(path) as f:
                    r = Reader(f, f.size())
                    take = [i for i, x in enumerate(r.ids) if wanted is None or x in wanted]
                    for at in range(0, len(take), 500):
                        rows = take[at : at + 500]
                        ids = [r.document(i) for i in rows]
                        yield pd.DataFrame({"doc_id": pd.array([r.ids[i] for i in rows], "Int64"), "start": [int(base + r.starts[i]) for i in rows], "n_tokens": [int(r.counts[i]) for i in rows], "ids_crc32": [crc32_u32(x, r.dtype) for x in ids], "ids": [np.frombuffer(x, r.dtype).astype("<u4").tobytes() for x in ids]})

    n = max(1, min(manifest.count(), 100_000))  # a task a file, so that reading is as parallel as writing was
    return manifest.select("path", "base").repartitionByRange(n, "path").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, vocab: str) -> DataFrame:
    folder = common.work_path(spark, "token-files")
    manifest = common.stored(write(docs, folder, vocab), "token-bases")
    return read(manifest, folder)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """documents written as token files and read back; nulls and repeats as in `write`."""
    return round_trip(spark, common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")
