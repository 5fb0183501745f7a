"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import crc_fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, text_col: str = "text", id_col: str = "doc_id", key_col: str = "doc_id") -> DataFrame:
    """Return ``order``, ``text`` and ``label`` of at most ``sample`` labelled ids, whose fold is not 1, in hash order of the id.

    The ids are chosen before the join, so the broadcast side has at most ``sample``
    rows and the documents are scanned once, not shuffled. Null labels, null ids and
    ids without a document don't count; of repeated labels of an id the largest holds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key_col).isNotNull() & (crc_fold(key_col) != 1))
    chosen = known.groupBy(F.col(key_col).alias("_key")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select(F.xxhash64("_key").alias("order"), "text", "label")
