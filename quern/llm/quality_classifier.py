"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed byte trigrams and coarse measures of its form; their weights are sublinear counts times
inverse document frequencies, and a singular value decomposition of the labelled rows gives the latent space.  The
labelled vectors are broadcast (at most MAX_LABELLED of them), the cosines of all documents with all of them are exact
products in blocks, and each document's NEAREST labelled neighbours vote with their similarities.

Only the training rows and their labels are learnt from; neither id nor language nor source is an input.

Defined cases: a null text counts as an empty one; an empty text has only terms of form, and gets a score like any
other; very long texts are read whole, one at a time; of equally near neighbours those of the smallest doc_id vote; repeated
rows get scores that differ by less than 1e-5 (blocks of products are rounded differently); without labelled rows of both kinds every score is the share of ones (0.5 if there
are none); other columns stay and clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokens as K
from quern.llm.common import trimmed

#: Bound of the labelled sample (half of it for each label, by the hash of the id), and of the space.
MAX_LABELLED, TERMS, DIMENSIONS, NEAREST = 4_000, 4_096, 48, 15
#: Buckets of each measure of form, and the weight of those terms beside trigrams.
BUCKETS, FORM_WEIGHT = 8, 0.45
#: Words in which the length-free share of distinct words is measured.
WINDOW = 400
_MEASURES = 7
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@{}[]=+~^\\/_"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _distinct_in_windows(marks: np.ndarray) -> float:
    """The mean share of distinct words over consecutive windows of WINDOW words of a whole text; the last one may be shorter and counts by its words."""
    window = np.arange(len(marks)) // WINDOW
    order = np.lexsort((marks, window))
    marks, window = marks[order], window[order]
    return float(1 + np.count_nonzero((marks[1:] != marks[:-1]) | (window[1:] != window[:-1]))) / len(marks)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term counts for each text: trigrams of bytes, then soft buckets of the measures of form."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS + _MEASURES * BUCKETS), np.float32)
    w = K.words(data, offsets, K.NOT_SPACE)
    low = w.data.astype(np.uint32)
    grams = ((low[:-2] * 2654435761 + low[1:-1] * 40503 + low[2:] * 69069) * np.uint32(2246822519)) >> np.uint32(20) if len(low) > 2 else np.zeros(0, np.uint32)
    cumulative = {name: np.concatenate(([0], np.cumsum(table[data]))) for name, table in (("upper", _UPPER), ("symbol", _SYMBOL), ("letter", _LETTER), ("digit", _DIGIT))}
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a > 2:
            out[i, :TERMS] = np.bincount(grams[a : b - 2], minlength=TERMS)[:TERMS]
        size = max(b - a, 1)
        x, y = int(w.first[i]), int(w.first[i + 1])
        marks = w.marks[x:y]
        distinct = _distinct_in_windows(marks) if y > x else 0.0
        spread = len(np.unique(marks)) / len(marks) if y > x else 0.0
        share = {k: (c[b] - c[a]) / size for k, c in cumulative.items()}
        form = [share["upper"], 4 * share["symbol"], 1 - share["letter"], 8 * share["digit"], 1 - distinct, 1 - spread, np.log1p(y - x) / 12]
        for k, value in enumerate(form):
            place = min(max(float(value), 0.0), 1.0) * (BUCKETS - 1)
            at = int(place)
            out[i, TERMS + k * BUCKETS + at] += 1 - (place - at)
            if place > at:
                out[i, TERMS + k * BUCKETS + at + 1] += place - at
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    grams = np.log1p(counts[:, :TERMS]) * idf
    norm = np.linalg.norm(grams, axis=1, keepdims=True)
    return np.concatenate([grams / np.maximum(norm, 1e-9), FORM_WEIGHT * counts[:, TERMS:]], axis=1).astype(np.float32)


def _of_column(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = K.raw(column)
    for a, b in K.chunks(offsets):
        for c in range(a, b, 512):
            d = min(c + 512, b)
            yield features(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])


class Voters:
    """The labelled vectors, fitted on the driver from a bounded sample."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        self.share = float(np.mean(labels)) if labels else 0.5
        self.one_sided = len(set(labels)) < 2
        if self.one_sided:
            return
        counts = np.concatenate(list(_of_column(pa.array(texts, pa.large_string()))))
        self.idf = np.log((1 + len(counts)) / (1 + (counts[:, :TERMS] > 0).sum(0))).astype(np.float32)
        rows = _weighted(counts, self.idf)
        size = min(DIMENSIONS, *rows.shape)
        basis = np.linalg.qr(np.random.default_rng(5).standard_normal((rows.shape[1], min(size + 16, rows.shape[1]))).astype(np.float32))[0]
        for _ in range(8):  # subspace iteration
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        turn = np.linalg.svd(rows @ basis, full_matrices=False)[2]
        self.space = (basis @ turn[:size].T).astype(np.float32)
        self.vectors = _unit(rows @ self.space)
        self.labels = np.array(labels, np.float32)
        #: A vote counts by how rare its label is in the sample.
        self.weights = np.where(self.labels == 1, 0.5 / self.share, 0.5 / (1 - self.share)).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.one_sided:
            return np.full(len(column), self.share)
        out = []
        for counts in _of_column(column):
            cosines = _unit(_weighted(counts, self.idf) @ self.space) @ self.vectors.T
            k = min(NEAREST, cosines.shape[1])
            near = _nearest(cosines, k)
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6) ** 4 * self.weights[near]
            out.append((votes * self.labels[near]).sum(1) / votes.sum(1))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values; of equal ones the first."""
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, near, 1).min(1, keepdims=True)
    for i in np.flatnonzero((cosines >= least).sum(1) > k):  # a tie at the edge
        near[i] = np.argsort(-cosines[i], kind="stable")[:k]
    return near


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Voters:
    """From rows of ``labels`` (given for training only); at most ``most`` of them, chosen by the hash of their id."""
    own = labels.filter(F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("__y")).groupBy(doc_id).agg(F.min("__y").alias("__y"))
    half = [own.filter(F.col("__y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(most // 2) for y in (0, 1)]
    rows = docs.select(doc_id, text).join(F.broadcast(half[0].union(half[1])), doc_id).groupBy(doc_id).agg(F.min(text).alias(text), F.first("__y").alias("__y")).orderBy(doc_id)
    found = rows.toArrow()
    return Voters(found.column(text).to_pylist(), found.column("__y").to_pylist())


def scored(docs: DataFrame, voters: Voters, text: str = "text") -> DataFrame:
    """``docs`` with score (the likelihood of label 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.select(*kept).mapInArrow(trimmed(run), T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
