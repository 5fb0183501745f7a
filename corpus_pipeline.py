"""A training corpus from raw documents, in five stages that each write their result.

``documents`` loses what the quality classifier rejects, repeated runs of lines, near
copies (five-word similarity of 0.8 or more; the smallest id of each component stays) and
documents that hold a benchmark item; what is left is packed into sequences of 1,024
tokens. Ids, texts and lengths stay
consistent: ``n_chars`` is recomputed where a text changes. A document that line dedup
leaves without anything but blanks goes; it was a copy.

Defined cases, in every stage: a null text is scored as the empty one, has no lines and no
item, is a near copy of the other texts without words, and is packed as its end token
alone; null ids rank first (in the near-copy stage: after all others); rows that repeat an
id are rows of their own, and lose lines alike; of ties the smaller id stays; a very long
text is worked on whole; empty tables give an empty result; columns besides those of
``documents`` are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.llm import decontamination, line_dedup, near_copies, packing, quality
from vicinia.llm.common import Workspace
from vicinia.llm.registry import table

CAPACITY = 1024


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), label="quality", sample=4000)
    return quality.accepted(docs, model, threshold=0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs, both=True, flag=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs, percent=80, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), least=0.8, radius=23)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), capacity=CAPACITY, end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The stages hash, learn and tokenise, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
