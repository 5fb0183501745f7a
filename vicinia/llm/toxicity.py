"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and
word beginnings; noisy-or combines the sentences, P = 1 - prod(1 - p), so the weights are
trained from document labels alone and still tell which sentences offend. The model is
fitted on at most ``sample`` labelled documents; features that go with the label in that
sample make the vocabulary. Texts are scored whole, one pass, no shuffle; the broadcast
holds the vocabulary, which the sample bounds.

Defined cases: a null text is empty; a text without sentences scores 0 (noisy-or of
nothing); a very long text is scored whole, in memory that grows with its sentences;
repeated rows are scored alike, and so are texts with the same sentences in another order
but for rounding; a score at the threshold counts as toxic; labelled ids beyond the sample
are left out in order of the id's hash, ties of it by id; null ids are of fold crc32('') mod 3; without
labelled rows of both kinds every score is 0; an empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import crc_fold
from vicinia.llm.labelled import training_rows

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000


def features(word: str) -> list[str]:
    """The whole word, and its beginnings of 3 to 8 letters where it goes on."""
    return [word + "$", *(word[:k] for k in range(3, min(9, len(word))))]


@dataclass
class Model:
    """Weights of the features and the bias of every sentence."""

    weights: dict[str, float]
    bias: float
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def hits(self, word: str) -> tuple:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences in code points, and their probabilities."""
        spans, z, hits, weights = [], [], self.hits, self.weights
        for m in SENTENCE.finditer(text):
            found = {f for w in WORD.findall(m[0].lower()) for f in hits(w)}
            spans.append(m.span())
            z.append(self.bias + sum(weights[f] for f in sorted(found)) if found else self.bias)
        return spans, 1 / (1 + np.exp(-np.array(z, dtype=np.float64)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _spread(ids: np.ndarray, listed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id its stretch of ``listed``: the place among the ids, and the entry."""
    counts = ends[ids + 1] - ends[ids]
    at = np.repeat(np.arange(len(ids)), counts)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return at, listed[ends[ids][at] + inside]


def train(texts: list[str], labels: np.ndarray, least: int = 4, apart: float = 4.0, ridge: float = 3e-5, steps: int = 300, rate: float = 0.1) -> Model:
    """Fit by full-batch Adam on the documents' log-likelihood.

    Vocabulary: features in at least ``least`` positive documents whose shares of the
    positive and the negative documents lie ``apart`` standard errors from each other.
    """
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        return Model({}, -np.inf)
    # words, features and sentences are numbers: a sample takes a few hundred MB, not thousands
    vocabulary: dict[str, int] = {}
    word, sentence_of, bag_of = array("i"), array("i"), array("i")
    for k, text in enumerate(texts):
        for s in SENTENCE.findall(text):
            own = {vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(s.lower())}
            word.extend(own)
            sentence_of.extend([len(bag_of)] * len(own))
            bag_of.append(k)
    word, sentence_of, bag_of = (np.array(x, dtype=np.int64) for x in (word, sentence_of, bag_of))
    number: dict[str, int] = {}
    listed, ends = array("i"), array("q", [0])
    for w in vocabulary:
        listed.extend(number.setdefault(f, len(number)) for f in features(w))
        ends.append(len(listed))
    listed, ends = np.array(listed, dtype=np.int64), np.array(ends, dtype=np.int64)

    found = np.zeros((2, len(number)), dtype=np.int64)
    order = np.searchsorted(bag_of[sentence_of], np.arange(len(texts) + 1))
    for k, y in enumerate(labels.tolist()):
        _, hits = _spread(np.unique(word[order[k] : order[k + 1]]), listed, ends)
        found[int(y), np.unique(hits)] += 1
    share = found.sum(axis=0) / (n1 + n0)
    z = (found[1] / n1 - found[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = (found[1] >= least) & (np.abs(z) >= apart)
    kept = sorted((f, k) for f, k in number.items() if chosen[k])
    names = [f for f, _ in kept]
    place = np.full(len(number), -1, dtype=np.int64)
    place[[k for _, k in kept]] = np.arange(len(kept))
    # a feature that several words of a sentence share counts once
    left = place[listed] >= 0
    ends = np.concatenate(([0], np.cumsum(left)))[ends]
    at, hits = _spread(word, place[listed[left]], ends)
    both = np.unique(sentence_of[at] * max(1, len(names)) + hits)
    sentence, feature = both // max(1, len(names)), both % max(1, len(names))
    theta, mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    theta[-1] = -6.0
    for step in range(1, steps + 1):
        z = np.bincount(sentence, theta[feature], minlength=len(bag_of)) + theta[-1]
        log_none = np.bincount(bag_of, np.logaddexp(0, z), minlength=len(texts))  # -log of the chance that no sentence offends
        pull = np.where(labels == 1, -np.exp(-log_none) / np.maximum(-np.expm1(-log_none), 1e-9), 1.0)
        slope = pull[bag_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, slope[sentence], minlength=len(names)), slope.sum()) / len(texts)
        grad[:-1] += ridge * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(names, theta[:-1].tolist(), strict=True)), float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 6000, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Train on at most ``sample`` labelled documents (the bound on what the driver gets)."""
    rows = training_rows(docs, labels, label, sample, text_col, id_col).toArrow().sort_by([("order", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), (rows["label"].to_numpy() > 0).astype(int))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, offends: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Score every row; ``offending`` lists the sentences of probability ``offends`` or more as (begin, end, probability) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p, n, spans = [], [], []
            for t in b.column(2).to_pylist():
                at, each = m.sentences(t or "")
                p.append(noisy_or(each))
                n.append(len(at))
                spans.append([{"begin": at[k][0], "end": at[k][1], "probability": float(each[k])} for k in np.flatnonzero(each >= offends)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(n, pa.int32()), pa.array(spans, kind)], ["id", "held_out", "score", "predicted", "n_sentences", "offending"])

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col) == 1).alias("held_out"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("offending", T.ArrayType(span))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
