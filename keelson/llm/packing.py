"""Harmonic packing of token ids into sequences of fixed capacity.

Harmonic packing (Lee and Lee, 1985) sorts items into reciprocal-capacity classes, class k holding lengths in
(C/(k+1), C/k], and fills each bin of class k with exactly k items. A bin is closed by counting alone, so classes and
workers need nothing from each other: every scan task packs its own documents, and nothing is shuffled.

Documents may be cut, which removes most of what harmonic packing wastes: a length that would leave more than
`slack` of a bin empty is cut at the next smaller reciprocal size, floor(C/(k+1)), which fills its class without loss,
and the rest, at most C/(k(k+1)) long, is dealt with the same way. So a document is cut a few times at most, and
lengths over C give whole sequences first. Bins left open at a task's end are emptied into one another: their pieces,
largest first, are laid end to end and cut at C; the last stretch is cut into sequences of powers of two, which need
no padding.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed as often as they
appear, null ids too; an empty table gives no pieces; extra columns are ignored by `pack`.
A lost executor's tasks run again on the same file splits and give the same pieces and sequence ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from keelson.llm.common import as_text, pieces_of, table, text_rows
from keelson.llm.token_ids import encoder

CAPACITY = 4096
#: Pieces that a worker keeps: fewer than for token files, as this runs in one process tree with other stages.
TABLE = 600_000
#: Share of a bin that equal lengths of a class may leave empty before a length is cut.
SLACK = 1 / 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document, in order; the classes' k is how many fill a bin."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        size = rest if capacity - k * rest <= slack * capacity else capacity // (k + 1)
        out.append((size, k if size == rest else k + 1))
        rest -= size
    return out


class HarmonicPacker:
    """Packs pieces in the order given. add() returns the pieces that it placed: (doc, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, slack: float = SLACK, first: int = 0):
        self.capacity, self.slack, self.next = capacity, slack, first
        self.open: dict[int, list[tuple[object, int, int]]] = {}

    def _close(self, pieces: list[tuple[object, int, int]]) -> Iterator[tuple[object, int, int, int, int]]:
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.next, offset
            offset += length
        self.next += 1

    def add(self, doc: object, length: int) -> Iterator[tuple[object, int, int, int, int]]:
        start = 0
        for size, k in cuts(length, self.capacity, self.slack):
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, start, size))
            start += size
            if len(pieces) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple[object, int, int, int, int]]:
        """Empties the open bins."""
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        self.open = {}
        total = sum(p[2] for p in left)
        rooms = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        rooms += [1 << b for b in reversed(range(self.capacity.bit_length())) if rest >> b & 1]
        bin_: list[tuple[object, int, int]] = []
        room = iter(rooms)
        free = next(room, 0)
        for doc, start, length in left:
            while length:
                n = min(length, free)
                bin_.append((doc, start, n))
                start, length, free = start + n, length - n, free - n
                if not free:
                    yield from self._close(bin_)
                    bin_, free = [], next(room, 0)


def packer(path: str, end_id: int, capacity: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, TABLE).encode
        pack = HarmonicPacker(capacity, slack, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        # of a document with an open bin: its id, its length, and the crc of each piece by its start; of cut pieces, the ids
        rows: list[tuple] = []

        def placed(found) -> None:
            for (doc, ids), start, length, sequence, offset in found:
                rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in pieces_of(batches, "text", 4 << 20, path):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(as_text(batch.column("text"))), strict=True):
                ids += end
                placed(pack.add((doc, ids), len(ids) // 4))
            if len(rows) > 20_000:
                yield out()
        placed(pack.finish())
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document, its ids' CRC-32, its sequence and its place there."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return text_rows(docs, id_col, text_col).mapInArrow(packer(path, end_id, capacity, slack), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
