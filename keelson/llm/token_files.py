"""Token ids as binary files: bit-plane shuffled blocks under zstandard, with a chunk index.

A file holds the ids of documents in ascending doc_id order:

    magic "KSTOK001"
    blocks   each of at most `block` ids: its planes, one zstandard frame each
    tables   zstandard frames: doc ids (int64, with a validity byte each), ids per document (int64)
    index    JSON: block size, kind of planes, for each block its place, ids and the planes' lengths; the tables' places
    tail     length of the index (unsigned 64 bit), magic

A block's ids are a matrix of unsigned 32-bit numbers. Byte planes are its transpose by bytes (all lowest bytes, all
second bytes, ...), bit planes its transpose by bits. The upper planes are nearly all zero and vanish under the
compressor, the lower ones hold like next to like. The index lets a reader fetch the blocks of any id range alone.

Writing: documents are range-partitioned and sorted by doc_id, each task encodes its own and writes files of bounded
size in the shared folder. A file appears under its name when it is whole, and counts only if the task's row about it
reaches the manifest, so tasks that run again or twice do no harm. Reading: one task per file; the ids before a file
come from the manifest, which has one row per file.

Defined cases: null or empty text is the end id alone; repeated doc_ids are all kept, ordered by their text; null ids
come first; an empty table writes no file and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import as_text, fresh_path, materialise, opened, pieces_of, table, text_rows
from keelson.llm.token_ids import encoder

MAGIC = b"KSTOK001"
BLOCK = 1 << 16
#: Ids after which a task begins another file.
FILE_IDS = 1 << 24
MANIFEST = "path string, part int, file int, n_docs long, n_ids long"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of unsigned 32-bit ids, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class TokenWriter:
    """Writes one file to an open stream."""

    def __init__(self, stream, block: int = BLOCK, kind: str = "byte", level: int = 1):
        self.stream, self.block, self.kind = stream, block, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.blocks, self.docs, self.counts = len(MAGIC), [], [], []
        self.open, self.held, self.n_ids = [], 0, 0
        stream.write(MAGIC)

    def _put(self, data: bytes) -> int:
        frame = self.zstd.compress(data)
        self.stream.write(frame)
        self.at += len(frame)
        return len(frame)

    def add(self, doc: int | None, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit numbers."""
        self.docs.append(doc)
        self.counts.append(len(ids) // 4)
        self.open.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.open), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(i + self.block, whole)]
            at = self.at
            self.blocks.append([at, len(part), [self._put(p) for p in to_planes(part, self.kind)]])
        self.n_ids += whole
        self.open, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        valid = np.array([d is not None for d in self.docs], np.uint8)
        tables = []
        for data in (np.array([d or 0 for d in self.docs], "<i8"), valid, np.array(self.counts, "<i8")):
            at = self.at
            tables.append([at, self._put(data.tobytes())])
        index = json.dumps({"block": self.block, "planes": self.kind, "blocks": self.blocks, "tables": tables, "n_docs": len(self.docs), "n_ids": self.n_ids}).encode()
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)


class TokenReader:
    """Reads one file by ranges."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file, or one cut short")
        (n,) = struct.unpack("<Q", tail[:8])
        self.index = json.loads(file.read_at(n, size - 16 - n))
        docs, valid, counts = (zstandard.decompress(file.read_at(length, at)) for at, length in self.index["tables"])
        self.docs = [d if v else None for d, v in zip(np.frombuffer(docs, "<i8").tolist(), valid, strict=True)]
        self.counts = np.frombuffer(counts, "<i8").tolist()

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = self.index["blocks"][i]
        data = memoryview(self.file.read_at(sum(lengths), at))
        planes = []
        for length in lengths:
            planes.append(zstandard.decompress(data[:length]))
            data = data[length:]
        return from_planes(planes, n, self.index["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range, from its blocks alone."""
        size = self.index["block"]
        parts = [self.block(i) for i in range(start // size, -(-stop // size))]
        first = start // size * size
        return np.concatenate(parts)[start - first : stop - first] if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids), holding a block and a document at a time."""
        at, held, next_block = 0, np.empty(0, "<u4"), 0
        for doc, n in zip(self.docs, self.counts, strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(next_block))
                have += len(parts[-1])
                next_block += 1
            joined = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, at, joined[:n]
            held, at = joined[n:], at + n


def writer(folder: str, tokenizer: str, end_id: int, kind: str, block: int, file_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        part, made, rows = task.partitionId(), 0, []

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in pieces_of(batches, "text", 4 << 20, tokenizer):
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(as_text(batch.column("text"))), strict=True):
                    yield doc, ids + end

        todo = documents()
        first = next(todo, None)
        while first is not None:
            path = f"{folder}/part-{part:06d}-{made:04d}-{task.taskAttemptId()}.kstok"
            with opened(path, "w") as stream:
                out, n = TokenWriter(stream, block, kind), 0
                while first is not None and n < file_ids:
                    out.add(*first)
                    n += len(first[1]) // 4
                    first = next(todo, None)
                out.close()
            rows.append((path, part, made, len(out.docs), n))
            made += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "part", "file", "n_docs", "n_ids"])

    return run


def range_of(rows: DataFrame, n: int) -> Column:
    """The number of the range that a doc_id falls in, of n about as large as each other.

    The bounds are quantiles of the ids alone: Spark's own range partitioning would read all texts for its sample.
    """
    bounds = rows.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], 20 * n).alias("b")).first()["b"]
    if not bounds or n == 1:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("doc_id"))), F.lit(0))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; returns the manifest (path, part, file, n_docs, n_ids), in whose (part, file) order the ids lie."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text_rows(docs, id_col, text_col)
    ordered = rows.repartitionById(n, range_of(rows, n)).sortWithinPartitions("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    return materialise(ordered.mapInArrow(writer(folder, tokenizer, end_id, kind, block, file_ids), MANIFEST), "token-manifest")


def read_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with opened(path, "r") as f:
                rows = []
                for doc, at, ids in TokenReader(f).documents():
                    rows.append((doc, base + at, len(ids), zlib.crc32(ids)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(n, "path").mapInArrow(read_file, FOUND)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
