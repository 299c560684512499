"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded, class-balanced sample of labelled documents is turned into weighted term vectors (hashed byte
trigrams and a few terms of style), a truncated SVD gives the latent space, and the sample's vectors
with their labels are broadcast. Each document is projected, compared with all of them by exact cosine
products in blocks, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import PIECE, U64, cuts, pieces, words_of_bytes

#: Labelled rows used at most for each class; those with the smallest hash of their doc_id.
SAMPLE = 1024
TERM_BITS = 13
TERMS = 1 << TERM_BITS
STYLE = 6
RANK = 48
NEIGHBOURS = 25
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}=~^\\"]] = True


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    d = data.astype(np.uint32)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - TERM_BITS)).astype(np.int64)


def _share(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many places of each row are set."""
    total = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw trigram counts of rows laid end to end; per row: words, symbols, capitals, letters, repeated words, distinct words, bytes; word hashes."""
    n = len(bounds) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    code = _trigrams(data)
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a > 2:
            out[i] = np.bincount(code[a : b - 2], minlength=TERMS)
    facts = np.zeros((n, 7), dtype=np.float64)
    facts[:, 1] = _share(_SYMBOL[data], bounds)
    facts[:, 2] = _share((data - np.uint8(65)) < 26, bounds)
    facts[:, 3] = facts[:, 2] + _share((data - np.uint8(97)) < 26, bounds)
    h, _, _, words = words_of_bytes(data, bounds)
    at = np.concatenate(([0], np.cumsum(words)))
    facts[:, 0] = words
    if len(h):
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        same[at[:-1][words > 0]] = False
        facts[:, 4] = _share(same, at)
        for i in np.flatnonzero(words):
            facts[i, 5] = len(np.unique(h[at[i] : at[i + 1]]))
    facts[:, 6] = np.diff(bounds)
    return out, facts, h


def _long_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and facts of one text, piece by piece; only its distinct words are held throughout."""
    counts, facts, seen = np.zeros((1, TERMS), dtype=np.float32), np.zeros((1, 7)), np.zeros(0, dtype=U64)
    for a, b in cuts(data):
        c, f, h = _counts(data[a:b], np.array([0, b - a]))
        counts += c
        facts += f
        seen = np.union1d(seen, h)
    facts[0, 5] = len(seen)
    return counts, facts


def _finish(counts: np.ndarray, facts: np.ndarray) -> np.ndarray:
    """Term weights: log-scaled trigram counts of length 1, then style terms scaled by what share of the text shows them."""
    out = np.zeros((len(counts), TERMS + STYLE), dtype=np.float32)
    np.log1p(counts, out=counts)
    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    out[:, :TERMS] = counts / np.maximum(norm, 1e-9)[:, None]
    words, symbols, capitals, letters, repeated, fresh, size = facts.T
    some = np.maximum(words, 1)
    share = np.stack([symbols / some, capitals / np.maximum(letters, 1), repeated / np.maximum(words - 1, 1), 1 - fresh / some, np.minimum(1, 8 / some), np.minimum(1, size / some / 40)], axis=1)
    out[:, TERMS:] = np.minimum(share, 1.0) * np.array([1, 1, 1, 0.3, 0.1, 0.1]) * (words > 0)[:, None]
    out[words == 0] = 0
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Term weights of a column of texts; a long text is counted piece by piece."""
    found = []
    for _, _, data, bounds in pieces(column, PIECE // 4):
        if len(data) > 2 * PIECE:
            counts, facts = _long_counts(data)
        else:
            counts, facts, _ = _counts(data, bounds)
        found.append(_finish(counts, facts))
    return np.concatenate(found) if found else np.zeros((0, TERMS + STYLE), dtype=np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows travel as the places and weights of their terms that aren't 0: a text has a few hundred of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = _matrix(part.column(1)).astype(np.float16)
            places = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            sparse = [pa.array([x.tobytes() for x in xs], type=pa.binary()) for xs in (places, [r[x] for r, x in zip(rows, places, strict=True)])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *sparse], names=["doc_id", "label", "places", "weights"])


class Model:
    """The latent space (idf weights and basis) and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.vectors = np.zeros((0, rank), dtype=np.float32)
        if not len(terms):
            return
        present = (terms[:, :TERMS] > 0).sum(axis=0)
        self.weight = np.ones(terms.shape[1], dtype=np.float32)
        self.weight[:TERMS] = np.log((1 + len(terms)) / (1 + present)) + 0.3
        x = self._weighted(terms)
        value, vector = np.linalg.eigh(x @ x.T)
        keep = np.argsort(value)[::-1][: max(1, min(rank, len(terms)))]
        keep = keep[value[keep] > 1e-6]
        self.basis = ((x.T @ vector[:, keep].astype(np.float32)) / np.sqrt(value[keep]).astype(np.float32)).astype(np.float32)
        self.vectors = self._unit(x @ self.basis)
        self.labels = labels.astype(np.float32)

    def _weighted(self, terms: np.ndarray) -> np.ndarray:
        """Weighted in place, to spare the driver a second copy: the trigram terms of each row come to length 1."""
        x = terms if terms.dtype == np.float32 else terms.astype(np.float32)
        x[:, :TERMS] *= self.weight[:TERMS]
        norm = np.sqrt(np.einsum("ij,ij->i", x[:, :TERMS], x[:, :TERMS]))
        x[:, :TERMS] /= np.maximum(norm, 1e-9)[:, None]
        return x

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, terms: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the weighted votes of the k nearest; one half where nothing is similar, 0 for a text without words."""
        if not len(self.vectors):
            return np.where(terms.any(axis=1), 0.5, 0.0)
        some = terms.any(axis=1)
        near = self._unit(self._weighted(terms) @ self.basis) @ self.vectors.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 8
        return np.where(some, ((vote * self.labels[top]).sum(axis=1) + 5e-4) / (vote.sum(axis=1) + 1e-3), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of each class; labels need doc_id and the 0/1 column `label`.

    Rows without a label or a text of that doc_id are left out, and so are ids with both labels. Of rows that
    repeat a doc_id the least text counts. At most 2 * sample vectors reach the driver. With nothing to learn
    from, every text with words scores one half.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    ids = [(r.doc_id, r.label) for r in chosen.collect()]
    small = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, label int, places binary, weights binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    terms = np.zeros((len(rows), TERMS + STYLE), dtype=np.float32)
    for i, r in enumerate(rows):
        terms[i, np.frombuffer(r.places, dtype=np.uint16)] = np.frombuffer(r.weights, dtype=np.float16)
    return Model(terms, np.array([r.label for r in rows]))


def _scores(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(_matrix(batch.column(text_at).slice(at, 128))) for at in range(0, batch.num_rows, 128)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64))], names=[*batch.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns kept, with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Only the text is used, the whole of it. A text without words (null, empty, blank) scores 0; one like nothing in
    the sample scores one half. An empty table gives an empty one; repeated rows are scored each. Input columns named score or predicted are replaced. One pass without a shuffle.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    scored = docs.mapInArrow(_scores(shared, docs.columns.index("text")), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
