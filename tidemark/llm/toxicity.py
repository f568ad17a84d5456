"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and unlabelled ones; no text is
taken for clean.  With the class prior p, the risk to be minimised is

    p R_p(+) + max(0, R_u(-) - p R_p(-)),

R_p and R_u being the mean logistic losses over the toxic and the unlabelled texts
when they are taken for toxic (+) or clean (-).

A text is described by its distinct words: each adds the weights of the word and of
its first 4, 5 and 6 letters, known by their CRC-32.  Only features that tell toxic texts
from others are taken, and weights are kept at 0 or above and shrunk (L1), so that
only evidence of toxicity counts and a long clean text gathers none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: A feature that the model may use is in as many distinct toxic texts of the sample.
LEAST_TEXTS = 6.0
NOT_LETTERS = re.compile(r"[\W\d_]+")


def word_features(token: str) -> list[int]:
    """The hashed features of a token between white space: its letters, and their first 4 to 6."""
    word = NOT_LETTERS.sub("", token)
    if len(word) < 2:
        return []
    keys = [f"w:{word}", *(f"p:{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    # 31 bits: even numbers are whole words, odd ones beginnings.
    return [(zlib.crc32(k.encode()) & 0x3FFFFFFF) << 1 | (k[0] == "p") for k in keys]


def text_features(text: str | None) -> tuple[list[int], list[int]]:
    """Features of a text and how many of its distinct tokens have each."""
    seen: Counter[int] = Counter()
    for token in set((text or "").lower().split()):
        seen.update(word_features(token))
    return list(seen), list(seen.values())


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    prior: float

    def word_weight(self, token: str) -> float:
        return math.fsum(self.weights.get(i, 0.0) for i in word_features(token))


def precise_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_precision: float, least_texts: float) -> np.ndarray:
    """Features whose precision, the share of toxic texts among all that have them, is surely above least_precision.

    By positive-unlabelled data it is prior P(feature | toxic) / P(feature).  The share of the
    toxic texts is taken a standard deviation lower, that of all with one text more.
    """
    toxic_keys, in_toxic = np.unique(np.concatenate(positive), return_counts=True)
    all_keys, counts = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(all_keys, toxic_keys), max(0, len(all_keys) - 1))
    in_all = np.where(all_keys[at] == toxic_keys, counts[at], 0) if len(all_keys) else np.zeros(len(toxic_keys))
    low = prior * (in_toxic - np.sqrt(in_toxic)) / len(positive)
    high = (in_all + 1) / len(unlabelled)
    return toxic_keys[(low > least_precision * high) & (in_toxic >= least_texts)]


def distinct(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One of each set of features."""
    return list({np.sort(f).tobytes(): f for f in texts}.values())


def telling_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_precision: float) -> np.ndarray:
    """Precise whole words, and beginnings that are precise among the texts without any of those.

    So a beginning isn't taken for what one of its words explains.  Distinct texts count, so
    that copies can't make a feature.  A feature needs LEAST_TEXTS of them, or a quarter of
    the toxic ones where there are few, but two at least: by then hardly any neutral word is
    in so many toxic texts and next to no others by chance, whatever the size of the sample.
    """
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    least = min(LEAST_TEXTS, max(2.0, len(positive) / 4))
    words = precise_features([f[f & 1 == 0] for f in positive], [f[f & 1 == 0] for f in unlabelled], prior, least_precision, least)
    toxic_rest = [f for f in positive if not np.isin(f, words).any()]
    rest = [f for f in unlabelled if not np.isin(f, words).any()]
    if not toxic_rest or not rest:
        return words
    left = min(0.9, prior * (len(toxic_rest) / len(positive)) / (len(rest) / len(unlabelled)))
    begins = precise_features([f[f & 1 == 1] for f in toxic_rest], [f[f & 1 == 1] for f in rest], left, least_precision, least)
    return np.sort(np.concatenate([words, begins]))


def fit_nnpu(positive: list[tuple], unlabelled: list[tuple], prior: float, *, steps: int = 600, rate: float = 0.05, shrink: float = 1e-5, least_precision: float = 0.5) -> ToxicityModel:
    """Minimises the non-negative risk by full-batch Adam with a proximal step.

    positive, unlabelled: (features, counts) of each text.  No toxic text, or a
    prior of 0: all scores are 0.  Counts enter as min(count, 3).
    """
    if not positive or not unlabelled or prior <= 0:
        return ToxicityModel({}, -40.0, 0.0)
    p = min(prior, 0.9)
    arrays = lambda rows: [np.asarray(f, np.int32) for f, _ in rows]
    used = telling_features(arrays(positive), arrays(unlabelled), p, least_precision)
    # Only the features that are used go on: a few for each text.
    rows = []
    for f, c in (*positive, *unlabelled):
        kept = np.isin(f, used)
        rows.append((np.asarray(f, np.int32)[kept], np.asarray(c)[kept]))
    row_of = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    column = np.searchsorted(used, np.concatenate([f for f, _ in rows]))
    value = np.minimum(np.concatenate([c for _, c in rows]).astype(np.float64), 3.0)
    toxic = np.arange(len(rows)) < len(positive)
    share = np.where(toxic, p / len(positive), 1.0 / len(unlabelled))
    w, b = np.zeros(len(used)), float(np.log(p / (1 - p)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row_of, w[column] * value, len(rows))
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        minus = np.logaddexp(0, z) * share
        clean_risk = minus[~toxic].sum() - minus[toxic].sum()
        if clean_risk >= 0:
            # d/dz of p R_p(+) is (s - 1) share, of -p R_p(-) it is -s share: -share in all.
            grad_z = np.where(toxic, -share, s * share)
        else:
            # The estimate of the clean risk fell below 0, which it can't be: undo that part.
            grad_z = np.where(toxic, s * share, -s * share)
        grad = np.append(np.bincount(column, grad_z[row_of] * value, len(used)), grad_z.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        ratio = rate / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(0.0, w - move[:-1] - np.minimum(ratio * shrink, 1.0))
        b -= move[-1]
    return ToxicityModel({int(k): float(x) for k, x in zip(used, w, strict=True) if x > 0}, b, p)


def in_fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def train_toxicity(docs: DataFrame, labels: DataFrame, *, positives: int = 3000, unlabelled: int = 6000, folds: int = 5) -> ToxicityModel:
    """Fits the model on the rows of all folds but 0.

    At most about `positives` toxic texts and `unlabelled` others, chosen by a hash
    of doc_id, are described by the tasks and sent to the driver: the bound of the
    sample.  The class prior is the share of toxic rows among the labelled ones of
    the same folds.  A document with several labels is toxic if any says so; null
    ids and null labels teach nothing.
    """
    spread = 1 << 20
    mark = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(spread))
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (in_fold("doc_id", folds) != 0))
    known = train.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    total = docs.count()
    if not known.toxic or not total:
        return fit_nnpu([], [], 0.0)
    chosen = (
        train.where((F.col("toxic") == 1) & (mark < int(spread * min(1.0, positives / known.toxic))))
        .select(F.col("doc_id").alias("toxic_id")).distinct().limit(2 * positives)
    )
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (in_fold("doc_id", folds) != 0))
    marked = texts.join(F.broadcast(chosen), texts.doc_id == chosen.toxic_id, "left")
    unl = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(spread)) < int(spread * min(1.0, unlabelled / total * folds / max(1, folds - 1)))
    sent = marked.select(F.col("toxic_id").isNotNull().alias("toxic"), unl.alias("unlabelled"), "text").where("toxic or unlabelled")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [text_features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([[min(3, x) for x in c] for _, c in found], pa.list_(pa.int8()))],
                ["toxic", "unlabelled", "features", "counts"],
            )

    table = sent.mapInArrow(describe, "toxic boolean, unlabelled boolean, features array<int>, counts array<tinyint>").toArrow()
    rows = list(zip(*(table.column(c).to_pylist() if c in ("toxic", "unlabelled") else [x.values.to_numpy() for x in table.column(c)] for c in table.column_names), strict=True))
    # The order in which tasks end must not matter.
    rows.sort(key=lambda r: (len(r[2]), zlib.crc32(np.sort(r[2]).tobytes())))
    return fit_nnpu([(f, c) for t, _, f, c in rows if t], [(f, c) for _, u, f, c in rows if u], known.toxic / known.n)


def evidence_of(model: ToxicityModel, cache_entries: int) -> Callable[[str | None], float]:
    """A function that gives a text's log-odds; it keeps the weights of short tokens."""

    class Weights(dict):
        def __missing__(self, token: str) -> float:
            x = model.word_weight(token)
            if len(token) <= 64:
                if len(self) >= cache_entries:
                    self.clear()
                self[token] = x
            return x

    weight = Weights().__getitem__
    # fsum: the sum doesn't depend on the order of the words.
    return lambda text: math.fsum((model.bias, *map(weight, set((text or "").lower().split()))))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, cache_entries: int = 200_000) -> DataFrame:
    """doc_id, score and predicted of every row, from its whole text alone.

    A null text scores as an empty one: by the bias.  Repeated rows score alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = evidence_of(sent.value, cache_entries)
        for batch in slices(batches, 1):
            z = np.array([evidence(t) for t in batch.column(1).to_pylist()])
            s = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, *, cache_entries: int = 200_000) -> DataFrame:
    """The rows of docs that the model doesn't take for toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = evidence_of(sent.value, cache_entries)
        for series in texts:
            yield pd.Series([evidence(t) < 0 for t in series], dtype="bool")

    return docs.where(clean("text"))
