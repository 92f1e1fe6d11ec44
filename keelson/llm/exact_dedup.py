"""Exact dedup with Patricia-trie owners.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Work is laid out so
that no group of copies, however large, meets in one task:

1. Map side: each scan task keeps its texts in a compressed radix trie of its own and sends one full byte string for
   each text that is new to the task, with the local count and the local best row. A text that a third of all rows
   share therefore costs one row a task, not one a copy.
2. Owners: those rows are partitioned by (length, SHA-256 of the content), and each partition inserts the full byte
   strings into a compressed radix trie. Terminal nodes keep the count and the smallest (-code points, doc_id). A
   trie over its memory limit writes its largest first-level subtree to a file of the task and goes on; spilled
   subtrees are replayed one at a time at the end.
3. Every document looks up its owner by (length, hash). The owners' side is unique in that key; a hot key is on the
   documents' side, which Spark splits (AQE skew join).

Defined cases: a null text counts as empty, and all empty (or all-white) texts are one group; ties in code points go
to the smallest doc_id; repeated rows (same doc_id) count in group_size, each is returned, and those of the id that
stays are all `kept`; a null doc_id is never preferred to another; an empty table gives an empty result; extra
columns are ignored by `owners`.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import as_bytes, pieces_of, table, text_rows

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of labels that a trie holds before it spills a subtree, and rows.
TRIE_BYTES = 48 << 20
TRIE_NODES = 200_000
#: A missing id is larger than any other.
NO_ID = 1 << 63


class Node:
    """A node of a compressed radix trie: the bytes on the edge into it, its children by first byte, its payload."""

    __slots__ = ("kids", "label", "payload")

    def __init__(self, label: bytes, payload=None, kids: dict | None = None):
        self.label, self.payload, self.kids = label, payload, kids


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes label a shares with b[at:]."""
    most = min(len(a), len(b) - at)
    if a[:most] == b[at : at + most]:
        return most
    low, high = 0, most
    while low + 1 < high:  # a[:low] agrees, a[:high] doesn't
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Maps byte strings to payloads; equal strings are merged by `merge`. Subtrees spill under their first byte."""

    def __init__(self, merge, max_bytes: int = TRIE_BYTES, max_nodes: int = TRIE_NODES):
        self.merge, self.max_bytes, self.max_nodes = merge, max_bytes, max_nodes
        self.root = Node(b"")
        self.bytes = self.nodes = 0
        self.sizes: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def insert(self, key: bytes, payload) -> None:
        first = key[0] if key else -1
        if first in self.spilled:
            pickle.dump((key, payload), self.spilled[first])
            return
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.payload = payload if node.payload is None else self.merge(node.payload, payload)
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                if node.kids is None:
                    node.kids = {}
                node.kids[key[at]] = Node(key[at:], payload)
                self._grew(first, len(key) - at)
                return
            n = shared_prefix(kid.label, key, at)
            if n < len(kid.label):  # the edge is cut in two
                upper = Node(kid.label[:n], None, {kid.label[n]: kid})
                kid.label = kid.label[n:]
                node.kids[key[at]] = kid = upper
                self._grew(first, 0)
            node, at = kid, at + n

    def _grew(self, first: int, n: int) -> None:
        self.bytes, self.nodes = self.bytes + n, self.nodes + 1
        self.sizes[first] = self.sizes.get(first, 0) + n + 200
        if self.bytes > self.max_bytes or self.nodes > self.max_nodes:
            self._spill()

    def _spill(self) -> None:
        first = max((b for b in self.sizes if b >= 0), key=self.sizes.get, default=None)
        if first is None:
            return
        out = tempfile.TemporaryFile()  # the task's own; gone with it
        self.spilled[first] = out
        for entry in walk(self.root.kids.pop(first), b""):
            pickle.dump(entry, out)
        self.sizes.pop(first)
        self.bytes, self.nodes = sum(self.sizes.values()), len(self.sizes) and sum(self.sizes.values()) // 200

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All (key, payload), those in memory first, then each spilled subtree on its own."""
        yield from walk(self.root, b"")
        self.root = Node(b"")
        self.sizes, self.bytes, self.nodes = {}, 0, 0
        while self.spilled:
            _, file = self.spilled.popitem()
            size = file.tell()
            file.seek(0)
            lead = None  # what all its entries begin with; the next level branches right after that
            while file.tell() < size:
                key, _ = pickle.load(file)
                lead = key if lead is None else lead[: shared_prefix(lead, key, 0)]
            file.seek(0)
            below = PatriciaTrie(self.merge, self.max_bytes, self.max_nodes)
            while file.tell() < size:
                key, payload = pickle.load(file)
                below.insert(key[len(lead) :], payload)
            file.close()
            for rest, payload in below.items():
                yield lead + rest, payload


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    """The entries below a node, without recursion (edges may be as deep as a text is long)."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node.label
        if node.payload is not None:
            yield prefix, node.payload
        if node.kids:
            stack.extend((kid, prefix) for kid in node.kids.values())


def normalised(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


def code_points(text: bytes) -> int:
    """UTF-8 lead bytes: all but 0x80..0xBF."""
    return len(text) - len(text.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))


KEYS = "doc_id long, n_points long, n_bytes long, sha binary"
LOCAL = "sha binary, n_bytes long, body binary, n long, n_points long, doc_id long"
OWNED = "sha binary, n_bytes long, keep_id long, group_size long"


def better(a: tuple, b: tuple) -> tuple:
    """Payloads are (rows, -code points, doc_id)."""
    return (a[0] + b[0], *min(a[1:], b[1:]))


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text"):
        texts = as_bytes(batch.column("text"))
        bodies = [normalised(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(map(code_points, texts), pa.int64()),
                pa.array(map(len, bodies), pa.int64()),
                pa.array((hashlib.sha256(b).digest() for b in bodies), pa.binary()),
            ],
            names=["doc_id", "n_points", "n_bytes", "sha"],
        )


def local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text that is new since the task's trie was last emptied."""
    trie = PatriciaTrie(better, 1 << 60, 1 << 60)

    def out() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for body, (n, points, doc) in trie.items():
            rows.append((hashlib.sha256(body).digest(), len(body), body, n, -points, None if doc == NO_ID else doc))
            size += len(body)
            if size > 4 << 20:
                yield rows_to_batch(rows, LOCAL)
                rows, size = [], 0
        if rows:
            yield rows_to_batch(rows, LOCAL)

    for batch in pieces_of(batches, "text"):
        for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
            trie.insert(normalised(text), (1, -code_points(text), NO_ID if doc is None else doc))
        if trie.bytes > TRIE_BYTES or trie.nodes > TRIE_NODES:  # bounded memory: hand over and begin again
            yield from out()
            trie = PatriciaTrie(better, 1 << 60, 1 << 60)
    yield from out()


TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def rows_to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of (length, hash): every full string goes through the trie; its terminals say who stays."""
    trie = PatriciaTrie(better)
    for batch in batches:
        for body, n, points, doc in zip(batch.column("body").to_pylist(), batch.column("n").to_pylist(), batch.column("n_points").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            trie.insert(body, (n, -points, NO_ID if doc is None else doc))
    rows = []
    for body, (n, _, doc) in trie.items():
        rows.append((hashlib.sha256(body).digest(), len(body), None if doc == NO_ID else doc, n))
        if len(rows) == 10_000:
            yield rows_to_batch(rows, OWNED)
            rows = []
    if rows:
        yield rows_to_batch(rows, OWNED)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    rows = text_rows(docs, id_col, text_col)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.mapInArrow(local_groups, LOCAL).repartition(partitions, "n_bytes", "sha")
    owned = local.mapInArrow(own, OWNED)
    keys = rows.mapInArrow(key_rows, KEYS)
    return keys.join(owned, ["n_bytes", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def raw_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text"):
        texts = as_bytes(batch.column("text"))
        rows = [(hashlib.sha256(normalised(t)).hexdigest(), -code_points(t), hashlib.sha256(t).digest()) for t in texts]
        text_sha256, less, raw = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_sha256), pa.array(less, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "text_sha256", "less", "raw"])


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw) of the row that stays of each group: its id, and the SHA-256 of its text as it is.

    Where an id repeats within a group, the longest text stands for it, of those the one with the least hash.
    """
    kept = owners(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("keep_id"), "text_sha256").distinct()
    rows = text_rows(docs, id_col, text_col).mapInArrow(raw_rows, "doc_id long, text_sha256 string, less long, raw binary")
    best = rows.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("less", "raw")).alias("best"))
    held = best.join(kept.withColumnRenamed("text_sha256", "sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("sha")), "left_semi")
    return held.select("doc_id", F.col("best.raw").alias("raw"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
