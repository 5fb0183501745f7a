"""Quality by nearest-neighbour voting among labelled documents.

A document is a bag of hashed byte trigrams with some shape terms (how much it repeats
itself, its size). Terms are weighted by log counts and inverse document frequency and
projected to a latent-semantic space, the leading right singular vectors of the labelled
sample. The labelled vectors are broadcast: ``sample`` rows of ``rank`` floats at most,
whatever the corpus. Every document is compared with all of them, exactly, as blocked
matrix products, and the nearest vote with weights that grow with their cosine.

Defined cases: a null text is empty and is scored like any other; a very long text is
counted in parts; a zero vector has cosine 0 with all; repeated rows are scored alike; of
neighbours at equal cosine the first ones of the sample (in order of the id's hash) vote; null ids are of fold crc32('') mod 3;
without labelled rows every score is 0.5; an empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import crc_fold, one_thread, utf8_rows
from vicinia.llm.labelled import training_rows

TERMS = 4096
#: Centres of the overlapping bins of: log2 of the trigrams' concentration, share of different words, log2 of the size.
BINS = ((np.linspace(-10, -3, 8), 1.0), (np.linspace(0, 1, 6), 1.0), (np.linspace(3, 15, 7), 0.3))
SHAPES = sum(len(c) for c, _ in BINS)
BLOCK = 256


def terms(text: bytes) -> np.ndarray:
    """log(1 + count) of each hashed trigram, then the shape terms."""
    out = np.zeros(TERMS + SHAPES, dtype=np.float32)
    n, squares = 0, 0.0
    counts = np.zeros(TERMS, dtype=np.int64)
    for at in range(0, max(0, len(text) - 2), 1 << 20):  # a very long text takes no more memory than a block
        b = np.frombuffer(text, dtype=np.uint8)[at : at + (1 << 20) + 2].astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        counts += np.bincount(h & np.uint32(TERMS - 1), minlength=TERMS)
        n += len(h)
    squares = float((counts.astype(np.float64) ** 2).sum())
    out[:TERMS] = np.log1p(counts)
    words = text.lower().split()
    size = max(n, 1)
    values = (np.log2(max(squares / size**2 - 1 / size, 1e-4)), len(set(words)) / max(1, len(words)), np.log2(size))
    at = TERMS
    for (centres, weight), v in zip(BINS, values, strict=True):
        near = np.abs(np.clip(v, centres[0], centres[-1]) - centres) / (centres[1] - centres[0])
        out[at : at + len(centres)] = weight * np.maximum(0, 1 - near)
        at += len(centres)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Inverse document frequencies, projection, labelled latent vectors and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 15
    sharpness: int = 8
    shape_weight: float = 0.5

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        return unit(np.hstack((unit(rows[:, :TERMS] * self.idf), self.shape_weight * rows[:, TERMS:])))

    def projected(self, rows: np.ndarray) -> np.ndarray:
        return self.weighted(rows).astype(np.float64) @ self.axes

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest; of equal cosines the sample's first count."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = np.round(unit(self.projected(rows)) @ self.vectors.T, 9)  # a product's last bits depend on the place in its block
        k = min(self.neighbours, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, tied = near > least, near == least
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        best = np.nonzero(chosen)[1].reshape(-1, k)
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** self.sharpness
        total = weight.sum(axis=1)
        return np.clip(np.where(total > 0, (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-300), 0.5), 0, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores in blocks of always the same shape, so that a row's score doesn't depend on the rows around it."""
        one_thread()
        out, block = [], np.zeros((BLOCK, TERMS + SHAPES), dtype=np.float32)
        held = 0
        for n, text in enumerate(utf8_rows(texts), 1):
            block[held] = terms(text)
            held += 1
            if held == BLOCK or n == len(texts):
                block[held:] = 0
                out.append(self.vote(block)[:held])
                held = 0
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: np.ndarray, labels: np.ndarray, rank: int = 32, reuse: bool = False) -> Model:
    """Latent-semantic axes by randomised subspace iteration over the labelled rows; reuse: the weighted rows overwrite them."""
    one_thread()
    idf = (np.log((1 + len(rows)) / (1 + (rows[:, :TERMS] > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(idf, np.zeros((TERMS + SHAPES, 0), np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float64))
    if len(rows):
        a = rows if reuse else np.empty_like(rows)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(rows), BLOCK)]  # with reuse the driver holds the matrix once, and no more
        for b in blocks:
            a[b] = model.weighted(rows[b])
        rank = min(rank, *a.shape)
        q = a @ np.random.default_rng(0).standard_normal((a.shape[1], rank + 10)).astype(np.float32)
        for _ in range(2):
            q = np.linalg.qr(a @ (a.T @ q))[0]
        _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
        model.axes = np.ascontiguousarray(vt[:rank].T).astype(np.float64)
        model.vectors = unit(np.concatenate([a[b].astype(np.float64) @ model.axes for b in blocks]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, rank: int = 32, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Train on at most ``sample`` labelled documents; their terms (8 KB a document) are what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t).astype(np.float16).tobytes() for t in utf8_rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["order", "terms", "label"])

    rows = training_rows(docs, labels, label, sample, text_col, id_col).mapInArrow(run, "order long, terms binary, label int").toArrow().sort_by([("order", "ascending"), ("terms", "ascending")])
    matrix, known = np.empty((rows.num_rows, TERMS + SHAPES), dtype=np.float32), (rows["label"].to_numpy() > 0).astype(int)
    for at in range(0, len(matrix), BLOCK):
        matrix[at : at + BLOCK] = np.frombuffer(b"".join(rows["terms"].slice(at, BLOCK).to_pylist()), dtype=np.float16).reshape(-1, TERMS + SHAPES)
    del rows  # the terms are held once while it trains
    return train(matrix, known, rank, reuse=True)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col) == 1).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
