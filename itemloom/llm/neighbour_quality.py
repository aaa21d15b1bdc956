"""Quality: votes of the nearest labelled neighbours in a latent-semantic space.

A text's terms are its words, their shapes (``Xx.``, ``X!``, ``|``) and whether a
word repeats the one before it; words and shapes are hashed and weighted by the
root of their share. A singular value decomposition of the labelled sample's
terms gives the latent space. The sample's vectors are broadcast; every document
is compared with all of them, block by block, and the labels of its nearest
neighbours are weighted by similarity.

The sample has at most ``SAMPLE`` labelled rows. Null and empty texts have no
neighbours and get the labels' mean, as all do without labels.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.shared import labelled_sample, slices

#: The most labelled rows to compare with, the latent dimensions and the voters.
SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 24
#: Buckets of hashed words, and after them of hashed shapes.
WORD_BUCKETS = 3072
BUCKETS = 4096
REPEATS = WORD_BUCKETS
BLOCK = 512
REMEMBERED = 300_000


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits become one sign each, of other signs one stays."""
    out = []
    for sign in word:
        kind = "X" if sign.isupper() else "x" if sign.isalpha() else "9" if sign.isdigit() else sign
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)[:12]


def _buckets(word: str) -> tuple[int, int]:
    own = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_BUCKETS
    return own, WORD_BUCKETS + 1 + zlib.crc32(shape(word).encode("utf-8", "replace")) % (BUCKETS - WORD_BUCKETS - 1)


class _Terms:
    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def matrix(self, texts: list[str]) -> np.ndarray:
        """A row of weighted buckets for each text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, cells, counts = self.known, [], []
        for row, body in enumerate(texts):
            words = body.split()
            if not words:
                continue
            base, share = row * BUCKETS, 1 / len(words)
            for word, n in Counter(words).items():
                if (got := known.get(word)) is None:
                    got = known[word] = _buckets(word)
                cells += (base + got[0], base + got[1])
                counts += (n * share, n * share)
            cells.append(base + REPEATS)
            counts.append(sum(map(eq, words, words[1:])) * share)
        flat = np.bincount(np.array(cells, np.int64), np.array(counts), len(texts) * BUCKETS)
        return np.sqrt(flat).astype(np.float32).reshape(len(texts), BUCKETS)


@dataclass
class Voters:
    """``space``: from buckets to latent dimensions; the sample's unit vectors and labels."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, terms: np.ndarray) -> np.ndarray:
        mean = float(self.labels.mean()) if len(self.labels) else 0.5
        vectors = _unit(terms @ self.space)
        if not len(self.labels):
            return np.full(len(terms), mean)
        near = vectors @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weights = np.clip(np.take_along_axis(near, best, 1), 0, None).astype(np.float64) ** 2
        return (np.einsum("ij,ij->i", weights, self.labels[best]) + 0.01 * mean) / (weights.sum(1) + 0.01)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def latent_space(terms: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration, each scaled by
    the inverse root of its singular value so that no few directions rule."""
    random = np.random.default_rng(11)
    basis = random.normal(size=(terms.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(terms.T @ (terms @ basis))
    small = terms @ basis
    _, values, turn = np.linalg.svd(small, full_matrices=False)
    kept = min(dimensions, len(values))
    return (basis @ turn[:kept].T / np.sqrt(np.maximum(values[:kept], 1e-3))).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, key: str = "doc_id", text: str = "text") -> Voters:
    """The latent space and the labelled vectors of at most ``SAMPLE`` rows;
    their non-zero buckets come to the driver, not their texts."""
    sample = labelled_sample(documents, labels, label, F.lit(True) if usable is None else usable, SAMPLE, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                rows = terms.matrix(part.column("body").to_pylist())
                at = [np.flatnonzero(r).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "label": part.column("label"), "at": pa.array(at, pa.list_(pa.int32())), "weight": pa.array([r[x] for r, x in zip(rows, at, strict=True)], pa.list_(pa.float32()))})

    kind = documents.schema[key].dataType.simpleString()
    got = sample.select(F.col(key).alias("key"), "label", "body").mapInArrow(run, f"key {kind}, label double, at array<int>, weight array<float>").toPandas().sort_values("key", kind="stable")
    terms = np.zeros((len(got), BUCKETS), np.float32)
    for row, at, weight in zip(terms, got["at"], got["weight"], strict=True):
        row[at] = weight
    if not len(got):
        return Voters(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    space = latent_space(terms)
    return Voters(space, _unit(terms @ space), got["label"].to_numpy())


def score(documents: DataFrame, voters: Voters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double): the neighbours' weighted share of label 1."""
    source = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    shared = documents.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms = shared.value, _Terms()
        for batch in slices(batches, "body"):
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "score": pa.array(own.scores(terms.matrix(part.column("body").to_pylist())))})

    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
