"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first 4, 5 and 6
characters, each counted once a document and hashed. Of all terms in the
training rows those become features that tell the classes apart, alone or with
another term, by more than chance among so many terms or pairs of them (their
log-likelihood ratio beats a multiple of the logarithm of that number). So rare
terms count if the sample can tell, and terms that are as frequent in both
classes count if a pair isn't. The machine has a weight and a short vector per feature; the dot product of two
features' vectors is their interaction, so an insult beside a group's name can
weigh more than both alone.

Fitted on at most ``SAMPLE`` labelled rows. Their features alone come to the
driver, beside the counts of terms; pairs are counted in tasks (``together``). Null and empty texts score as a
text without features. Without labels every score is one fixed low value.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.shared import discard, labelled_sample, settle, slices

#: The most labelled rows to fit on, and the most features to keep.
SAMPLE = 20_000
FEATURES = 4096
#: What a ratio must beat, as a multiple of the logarithm of the number of terms or pairs.
CHANCE = 1.6
#: Bits of a term's hash.
BITS = 24
RANK = 8
REMEMBERED = 300_000

WORDS = re.compile(r"\w+").findall


def word_terms(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    shown = [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(t.encode("utf-8", "replace")) >> (32 - BITS) for t in shown]


@dataclass
class Machine:
    """``terms``: sorted hashes of the features; bias, weights and vectors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of documents whose features stand one after another up to their ``ends``."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        rows = np.repeat(np.arange(len(ends)), ends - starts)
        linear = np.bincount(rows, self.weights[features], len(ends))
        sums = np.stack([np.bincount(rows, self.vectors[features, k], len(ends)) for k in range(self.vectors.shape[1])], 1)
        squares = np.bincount(rows, (self.vectors[features] ** 2).sum(1), len(ends))
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(terms: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 128) -> Machine:
    """Adagrad on the logistic loss over documents given as feature numbers."""
    random = np.random.default_rng(7)
    n, size = len(documents), len(terms)
    share = (labels.sum() + 0.5) / (n + 2)
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.02, (size, RANK)))
    grown_w, grown_v, grown_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs if size else 0):
        for rows in np.array_split(random.permutation(n), max(1, n // batch)):
            own = [documents[r] for r in rows]
            ends = np.cumsum([len(x) for x in own])
            features = np.concatenate(own).astype(np.int64)
            row = np.repeat(np.arange(len(rows)), [len(x) for x in own])
            error = (_sigmoid(machine.logits(features, ends)) - labels[rows]) / len(rows)
            sums = np.stack([np.bincount(row, machine.vectors[features, k], len(rows)) for k in range(RANK)], 1)
            seen, at = np.unique(features, return_inverse=True)
            slope_w = np.bincount(at, error[row], len(seen)) + decay * machine.weights[seen]
            each = error[row, None] * (sums[row] - machine.vectors[features])
            slope_v = np.stack([np.bincount(at, each[:, k], len(seen)) for k in range(RANK)], 1) + decay * machine.vectors[seen]
            grown_w[seen] += slope_w**2
            grown_v[seen] += slope_v**2
            grown_b += error.sum() ** 2
            machine.weights[seen] -= rate * slope_w / np.sqrt(grown_w[seen])
            machine.vectors[seen] -= rate * slope_v / np.sqrt(grown_v[seen])
            machine.bias -= rate * error.sum() / np.sqrt(grown_b)
    return machine


def evidence(n: np.ndarray, hits: np.ndarray, total: float, positive: float) -> np.ndarray:
    """Log-likelihood ratio of something in ``n`` of ``total`` rows and ``hits`` of
    the ``positive`` ones against its being independent of the label."""
    out = np.zeros(len(n))
    for seen, rows, share in ((hits, n, positive), (n - hits, n, total - positive), (positive - hits, total - n, positive), (total - positive - n + hits, total - n, total - positive)):
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) * total / np.maximum(rows * share, 1e-9))
    return out


def fewest(bound: float, total: float, positive: float) -> int:
    """Rows without which no evidence can beat ``bound``."""
    return max(1, math.ceil(bound / (-2 * math.log(min(positive, total - positive) / total))))


@dataclass
class Pairs:
    """Documents given as numbers of terms, and the evidence of each term ``alone``."""

    flat: np.ndarray
    offsets: np.ndarray
    labels: np.ndarray
    alone: np.ndarray


def paired(spark: SparkSession, pairs: Pairs, bound: float) -> np.ndarray:
    """``together`` of documents that the caller holds."""
    texts = [pairs.flat[i:j].tolist() for i, j in zip(pairs.offsets[:-1], pairs.offsets[1:], strict=True)]
    rows = spark.createDataFrame([(float(label), text) for label, text in zip(pairs.labels, texts, strict=True)], "label double, terms array<int>")
    return together(rows, np.arange(len(pairs.alone)), pairs.alone, bound, len(texts), float(pairs.labels.sum()))


def _pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype(np.int32).tobytes(), 1)


def _unpack(packed: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows, one after another."""
    return np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x.as_py()), np.int32), dtype=np.int64) for x in packed])


def together(rows: DataFrame, terms: np.ndarray, alone: np.ndarray, bound: float, total: float, positive: float) -> np.ndarray:
    """For each of the sorted ``terms`` the most evidence that a pair with it adds
    to what both terms give ``alone``, or 0 if not more than ``bound``.

    ``rows`` has (label, terms: sorted). All pairs are counted: terms are dealt to
    parts, and for each two parts a task gets what the documents hold of these. So
    neither the driver nor a task gets all terms of all documents.
    """
    context = rows.sparkSession.sparkContext
    parts = max(1, min(len(terms), math.ceil(math.sqrt(8 * context.defaultParallelism))))
    pairs = [(a, b) for a in range(parts) for b in range(a, parts)]
    shared, least = context.broadcast((terms, alone)), fewest(bound, total, positive)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "terms"):
            flat, offsets = numbered(shared.value[0], batch.column("terms"))
            text, part = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), flat % parts
            own = [part == a for a in range(parts)]
            held = [_pack(flat[x] // parts) for x in own]
            count = [_pack(np.bincount(text[x], minlength=batch.num_rows)) for x in own]
            first, second = np.array(pairs).T
            labels = _pack((batch.column("label").to_numpy() > 0).astype(np.int32))
            columns = {"a": pa.array(first, pa.int32()), "b": pa.array(second, pa.int32()), "labels": pa.array([labels] * len(pairs), pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {f"{name}_{c}": pa.array([of[x] for x in side], pa.binary()) for c, side in (("a", first), ("b", second)) for name, of in (("held", held), ("count", count))})

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        mine, theirs, ends = _unpack(table.column("held_a")), _unpack(table.column("held_b")), np.cumsum(_unpack(table.column("count_b")))
        positives, texts = _unpack(table.column("labels")) > 0, np.split(theirs, ends[:-1])
        order = np.argsort(mine, kind="stable")
        found = np.repeat(np.arange(len(ends)), _unpack(table.column("count_a")))[order]
        alone_a, alone_b = shared.value[1][a::parts], shared.value[1][b::parts]
        bounds = np.searchsorted(mine[order], np.arange(len(alone_a) + 1))
        best_a, best_b = np.zeros(len(alone_a)), np.zeros(len(alone_b))
        for term in range(len(alone_a)):
            own = found[bounds[term] : bounds[term + 1]]
            if len(own) < least:
                continue
            both = np.bincount(np.concatenate([texts[i] for i in own]), minlength=len(alone_b))
            hits = np.bincount(np.concatenate([theirs[:0], *(texts[i] for i in own[positives[own]])]), minlength=len(alone_b))
            other = np.flatnonzero(both >= least)
            more = evidence(both[other].astype(float), hits[other].astype(float), total, positive) - np.maximum(alone_a[term], alone_b[other])
            other, more = other[more > bound], more[more > bound]
            best_a[term] = more.max(initial=0.0)
            best_b[other] = np.maximum(best_b[other], more)
        best = np.concatenate([best_a, best_b])
        numbers = np.concatenate([np.arange(len(best_a)) * parts + a, np.arange(len(best_b)) * parts + b])
        return pa.table({"id": numbers[best > 0], "best": best[best > 0]})

    out = np.zeros(len(terms))
    if len(terms):
        dealt = rows.mapInArrow(deal, "a int, b int, labels binary, held_a binary, count_a binary, held_b binary, count_b binary").repartition(2 * len(pairs), "a", "b")
        found = dealt.groupBy("a", "b").applyInArrow(run, "id long, best double").groupBy("id").agg(F.max("best").alias("best")).toArrow()
        out[found.column("id").to_numpy()] = found.column("best").to_numpy()
    return out


def numbered(known: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the sorted ``known`` of each list's values, one list after
    another, and where each begins; values that aren't known go."""
    values, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1)).astype(np.int32)
    held = known[at] == values if len(known) else np.zeros(len(values), bool)
    return at[held], np.concatenate([[0], np.cumsum(held)])[offsets]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, key: str = "doc_id", text: str = "text") -> Machine:
    """Fit on labelled rows; counts of terms and pairs are made by Spark, and only
    the features of at most ``SAMPLE`` documents come to the driver."""
    sample = labelled_sample(documents, labels, label, F.lit(True) if usable is None else usable, SAMPLE, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            found = [sorted({t for w in {*WORDS(body.lower())} for t in word_terms(w)}) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "terms": pa.array(found, pa.list_(pa.int32()))})

    rows = settle(sample.select("label", "body").mapInArrow(run, "label double, terms array<int>"), "toxicity")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 2)
        return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, RANK)))
    counts = settle(rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("hits")), "terms")
    size = max(2, counts.count())
    bound = CHANCE * math.log(size)
    # Evidence of a pair must beat chance among all pairs.
    found = counts.where(F.col("n") >= fewest(bound, n, positive)).orderBy("term").toArrow()
    terms, seen = found.column("term").to_numpy().astype(np.int64), found.column("n").to_numpy()
    alone = evidence(seen.astype(float), found.column("hits").to_numpy(), n, positive)
    number = np.flatnonzero(seen >= fewest(2 * bound, n, positive))
    strength = np.where(alone > bound, alone, 0.0)
    strength[number] = np.maximum(strength[number], together(rows, terms[number], alone[number], 2 * bound, n, positive))
    order = np.lexsort((terms, -strength))[:FEATURES]
    terms = np.sort(terms[order[strength[order] > 0]])
    wanted = rows.sparkSession.sparkContext.broadcast(terms)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = numbered(wanted.value, batch.column("terms"))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "terms": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})

    few = rows.mapInArrow(choose, "label double, terms array<int>").toArrow()
    lists = few.column("terms").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    discard(rows, counts)
    return train(terms, np.split(flat, ends[:-1]), few.column("label").to_numpy())


def score(documents: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """(key, score double): how likely the text is toxic; the columns ``more``
    pass through."""
    source = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"), *(F.col(c).alias(f"more_{i}") for i, c in enumerate(more)))
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = {int(t): i for i, t in enumerate(own.terms)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "body"):
            if len(known) > REMEMBERED:
                known = {}
            features, ends = [], []
            for body in batch.column("body").to_pylist():
                own_features: set[int] = set()
                for word in {*WORDS(body.lower())}:
                    if (got := known.get(word)) is None:
                        got = known[word] = tuple(number[t] for t in word_terms(word) if t in number)
                    if got:
                        own_features.update(got)
                features += own_features
                ends.append(len(features))
            scores = _sigmoid(own.logits(np.array(features, np.int64), np.array(ends, np.int64)))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "score": pa.array(scores)} | {f"more_{i}": batch.column(f"more_{i}") for i in range(len(more))})

    schema = T.StructType([source.schema["key"], T.StructField("score", T.DoubleType()), *(source.schema[f"more_{i}"] for i in range(len(more)))])
    return source.mapInArrow(run, schema).withColumnsRenamed({"key": key} | {f"more_{i}": c for i, c in enumerate(more)})
