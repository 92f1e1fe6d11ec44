"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits link when they differ in two bits at most. Cut into two segments (not three, as one would for
equal segments), one segment differs by one bit at most. So each segment is indexed under its 32 variants with one bit
left out, and two fingerprints that link share such a variant. An equality join of the variants finds every link; each
is verified on all 64 bits.

Only distinct fingerprints are indexed, so copies of a document cost nothing here, however many. A bucket of m
fingerprints yields m - 1 links at most, a spanning forest of its true links: small buckets compare all pairs, larger
ones look up each member with one or two of the free bits flipped, which is linear in m. A bucket of over HOT
members is handed back and cut finer: by the same argument one 16-bit half of its other segment differs by one bit at
most, so its members are indexed again under one-bit-deleted halves. Such a sub-bucket has 18 free bits and thus
2^18 members at most. Components come from the links by label stars in DataFrames; nothing is collected.

Defined cases: null, empty and all-blank texts have fingerprint zero and link like any other; repeated rows are each
returned; a null doc_id is never a component's id unless the component has no other; an empty table gives an empty
result; extra columns are ignored by `near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import as_bytes, materialise, pieces_of, release, table, text_rows
from keelson.llm.graph import components

SEED = 42
SHINGLE = 3
#: Members from which a bucket is cut finer; below, and in what is cut finer, members are compared.
HOT = 1 << 16
PAIRWISE = 256
STEP = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of lower-cased k-word shingles under XXH64."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(a), STEP):
        hashes = np.array([hashed(joined[x:y], SEED) for x, y in zip(a[i : i + STEP], b[i : i + STEP], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # column sums of 0/1 bytes: by 255 rows as bytes, then wide
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(a), bitorder="little").tobytes(), "little")


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text"):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


BIT = np.arange(32, dtype=np.uint64)
ONE = np.uint64(1)


def variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 rows for a fingerprint: key = segment (1 bit), deleted bit (5), the segment with that bit zero (32)."""
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(prints), 4096):
            part = prints[i : i + 4096]
            keys = np.empty((len(part), 64), np.uint64)
            for segment in (0, 1):
                value = (part >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
                keys[:, 32 * segment : 32 * segment + 32] = (value[:, None] & ~(ONE << BIT)[None, :]) | (BIT << np.uint64(32))[None, :] | np.uint64(segment << 37)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, 64).view(np.int64))], names=["key", "fp"])


def finer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 rows for a member of a hot bucket: its key, a half of the other segment (1 bit), deleted bit (4), the rest (16)."""
    bit = np.arange(16, dtype=np.uint64)
    for batch in batches:
        prints = batch.column("b").to_numpy(zero_copy_only=False).view(np.uint64)
        keys = batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(prints), 4096):
            part, key = prints[i : i + 4096], keys[i : i + 4096]
            other = (part >> (np.uint64(32) * (ONE - (key >> np.uint64(37))))) & np.uint64(0xFFFFFFFF)
            out = np.empty((len(part), 32), np.uint64)
            for half in (0, 1):
                value = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
                out[:, 16 * half : 16 * half + 16] = (value[:, None] & ~(ONE << bit)[None, :]) | (bit << np.uint64(16))[None, :] | np.uint64(half << 20) | (key << np.uint64(21))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(part, 32).view(np.int64))], names=["key", "fp"])


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints (unsigned, sorted): those that aren't the first of their group of links, and the first."""
    m = len(prints)
    label = np.arange(m)

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        while True:
            a, b = label[i], label[j]
            if np.array_equal(a, b):
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]

    if m <= PAIRWISE:
        i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
        if len(i):
            unite(i, j)
    else:
        free = int(np.bitwise_or.reduce(prints ^ prints[0]))
        bits = [1 << b for b in range(64) if free >> b & 1]
        masks = bits + [x | y for n, x in enumerate(bits) for y in bits[n + 1 :]]
        for mask in masks:
            other = prints ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(prints, other), m - 1)
            hit = np.nonzero((prints[at] == other) & (at > np.arange(m)))[0]
            if len(hit):
                unite(hit, at[hit])
    rest = np.nonzero(label != np.arange(m))[0]
    return prints[rest], prints[label[rest]]


def bucket_links(hot: int | None):
    """Rows sorted by key to links (kind 0: a, b fingerprints), or hot buckets' members (kind 1: a key, b fingerprint)."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def solve(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        cut = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= 2]
        if len(near):
            yield batch_of(0, prints[near], prints[near + 1])
        for i, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = forest(np.unique(prints[i : i + n]))
            if len(a):
                yield batch_of(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k = held_p = np.empty(0, np.uint64)
        passing = None  # the key of a hot bucket under way
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if passing is not None:
                n = int(np.searchsorted(keys, passing, "right")) if keys[0] == passing else 0
                if n:
                    yield batch_of(1, keys[:n], prints[:n])
                keys, prints = keys[n:], prints[n:]
                if not len(keys):
                    continue
                passing = None
            keys, prints = np.concatenate((held_k, keys)), np.concatenate((held_p, prints))
            last = int(np.argmax(keys == keys[-1]))
            held_k, held_p, keys, prints = keys[last:], prints[last:], keys[:last], prints[:last]
            if hot and len(keys):
                cut = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
                many = np.repeat(np.diff(cut) > hot, np.diff(cut))
                if many.any():
                    yield batch_of(1, keys[many], prints[many])
                    keys, prints = keys[~many], prints[~many]
            if len(keys):
                yield from solve(keys, prints)
            if hot and len(held_k) > hot:
                yield batch_of(1, held_k, held_p)
                passing = held_k[0]
                held_k = held_p = np.empty(0, np.uint64)
        if len(held_k):
            yield from solve(held_k, held_p)

    return run


LINKS = "kind int, a long, b long"


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the fingerprints of `fp` (distinct) just as all pairs of two differing bits or fewer do."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("fp").mapInArrow(variant_rows, "key long, fp long")
    found = materialise(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(bucket_links(HOT), LINKS), "links")
    finer = found.where("kind = 1").mapInArrow(finer_rows, "key long, fp long")
    more = finer.repartition(n, "key").sortWithinPartitions("key").mapInArrow(bucket_links(None), LINKS)
    out = found.where("kind = 0").select("a", "b").union(more.select("a", "b"))
    out.read_from = found  # to be released once what is made from it has been written
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return text_rows(docs, id_col, text_col).mapInArrow(fingerprint_rows, "doc_id long, fp long")


def labelled(prints: DataFrame) -> DataFrame:
    """(fp, component_id, label) of the fingerprints of prints (doc_id, fp); ids may repeat or be null, labels tell components apart."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = links(nodes)
    labels = components(near).withColumnRenamed("vertex", "fp")
    release(near.read_from)
    known = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    ids = known.groupBy("label").agg(F.min("first").alias("component_id"))
    return known.join(ids, "label").select("fp", "component_id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long), component_id."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    return prints.join(labelled(prints).drop("label"), "fp").select("doc_id", "fp", "component_id")


def raw_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text"):
        texts = as_bytes(batch.column("text"))
        prints = np.array([fingerprint(t) for t in texts], "<u8").view("<i8")
        raw = pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints), raw], names=["doc_id", "fp", "raw"])


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw) of one row of each component: the component's id, and the SHA-256 of its text."""
    rows = materialise(text_rows(docs, id_col, text_col).mapInArrow(raw_rows, "doc_id long, fp long, raw binary"), "fingerprints")
    first = rows.join(labelled(rows), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return first.groupBy("label", "doc_id").agg(F.min(F.struct("fp", "raw")).alias("best")).select("doc_id", F.col("best.raw").alias("raw"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
