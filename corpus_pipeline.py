"""A corpus pipeline: toxic documents go, then copies, then near copies; repeated passages are cut; the rest is packed.

Defined cases, for documents with any columns beside doc_id and text, of any names: a null text counts as empty and
stays null until passages are cut, which makes it empty; rows of one id and text, and rows with a null id, are
documents like others, of which one of each group of equal (near-equal) texts stays; without usable labels of both
kinds nothing is toxic; an empty table gives no pieces. A passage is a run of over 50 whole words covered by strings of
repeats.PASSAGE bytes that occur elsewhere, too; all its places are cut, at whole characters, and what is left of the
document stays, be it empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import exact_dedup, packing, repeats, simhash, toxicity
from keelson.llm.common import materialise, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of docs, one row for each (doc_id, raw) of chosen. raw is the SHA-256 of the text: rows of other texts under a chosen id go, too."""
    key = lambda doc, raw: F.sha2(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(raw))), 256)
    raw = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    name = f"row-{uuid.uuid4().hex}"  # docs has no such column
    once = docs.withColumn(name, key(F.col("doc_id").cast("long"), raw)).dropDuplicates([name])  # combined map-side
    return once.join(chosen.select(key(F.col("doc_id"), F.col("raw")).alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the id that exact_dedup keeps."""
    return only(docs, exact_dedup.representatives(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies one row stays, with the component's id."""
    return only(docs, simhash.representatives(docs))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut out; n_chars follows."""
    cut = repeats.cut_texts(docs, repeats.PASSAGE, repeats.PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("packing", pack),
]

#: SQL can express neither the scores nor the fingerprints; tests compare the whole run with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
            release(before)  # what the stage has read is written anew now
    return docs
