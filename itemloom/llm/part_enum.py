"""Jaccard self-join of word shingles by PartEnum signatures.

Sets are dealt to size bands. In a band, similar sets differ in at most ``k``
shingles, so if the domain of shingles is cut into more than ``k`` parts, some
parts are equal in both sets. Each set gets a signature for every part (few
differences: for every pair of parts) with all its shingles therein; similar
sets then share a signature. There are more parts than that, so many are equal;
the best-filled one of these is enough. Parts are ordered by their number of
shingles, and a set leaves out as many of its emptiest as it can: parts of no or
one shingle, which many sets have by chance, seldom give signatures.

Rows of one signature are brought together by sorting ranges of (signature,
document), so a signature of any number of documents is spread over tasks. Of a
signature's documents only pairs with its first one are compared; what these
links connect needs no further comparison. After some rounds, pairs of documents
of a signature that are still in different components are compared one by one.
So no link between components is lost, and copies aren't expanded into pairs.

Rows with the same key have one component, and what links with one of their texts
has it, too; rows without a key share the component of an equal text, if there is
one. An empty table gives an empty one; columns of any other name don't matter. Null and empty texts have no shingles and no
links. Components are found without the driver (``components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.components import connect
from itemloom.llm.set_match import Stars, matched
from itemloom.llm.shared import discard, keep_shared, settle
from itemloom.llm.words import Words, blocks, mixed

#: Up to so many differences, pairs of parts are signed.
FEW = 7

def shingles_of(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a text of
    fewer words is one shingle."""
    hashes, out = words.hashes, np.zeros(max(0, len(words.hashes) - size + 1), np.uint64)
    for i in range(size):
        out = mixed(out + hashes[i : i + len(out)] + np.uint64(i))
    found = []
    for low, high in zip(words.texts[:-1].tolist(), words.texts[1:].tolist(), strict=True):
        if high - low >= size:
            found.append(np.unique(out[low : high - size + 1]))
        else:
            found.append(np.array([xxhash.xxh3_64_intdigest(hashes[low:high].tobytes(), high - low)], np.uint64) if high > low else hashes[:0])
    return found


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``high`` of which the smaller of two is at most ``middle``."""

    number: int
    low: int
    high: int
    k: int
    parts: int

    @property
    def room(self) -> int:
        """Parts that are equal in two similar sets, at least."""
        return self.parts - self.k


def bands(largest: int, share: int, of: int) -> list[Band]:
    """Bands for the similarity ``share / of``, up to sets of ``largest``."""
    out, low = [], 1
    while low <= largest:
        middle = max(low, low * 7 // 5)
        k = (of - share) * middle // share
        parts = k + 4 if 0 < k <= FEW else k + 1
        for _ in range(4 if k > FEW else 0):
            empty = parts * exp(-low / parts)
            parts = k + 1 + ceil(empty + 5 * sqrt(empty) + 3)
        out.append(Band(len(out), low, middle * of // share, k, parts))
        low = middle + 1
    return out


@cache
def _pairs(n: int) -> np.ndarray:
    return np.array([*combinations(range(n), 2)]).T


def signatures(items: np.ndarray, own: list[Band]) -> np.ndarray:
    """The signatures of a set in each of its bands."""
    out = []
    inner = mixed(items + np.uint64(0x9E3779B97F4A7C15))
    low, high = (inner & np.uint64(0xFFFFFFFF)).astype(np.float64), (inner >> np.uint64(32)).astype(np.float64)
    for band in own:
        part = ((items >> np.uint64(33)) % np.uint64(band.parts)).astype(np.int64)
        held = np.bincount(part, minlength=band.parts)
        sums = mixed(np.bincount(part, low, band.parts).astype(np.uint64)) + np.bincount(part, high, band.parts).astype(np.uint64)
        seed = np.uint64(band.number << 40)
        signs = mixed(mixed(sums) + seed + np.arange(band.parts, dtype=np.uint64))
        # Equal parts have the same place in any order by their shingles. Of the ``room`` or
        # more that two similar sets have in common, the last (two) in the order have all the
        # others before them, so neither set leaves them out.
        order = np.lexsort((signs, held))
        if 0 < band.k <= FEW:
            kept = np.sort(order[band.room - 2 :])
            first, second = (kept[i] for i in _pairs(len(kept)))
            signs = mixed(mixed(sums[first] + seed + first.astype(np.uint64)) + sums[second] + second.astype(np.uint64))
            filled = (held[first] > 0) | (held[second] > 0)
            out.append(signs[filled] if band.parts - np.count_nonzero(held) < band.room else signs)
        else:
            out.append(signs[order[band.room - 1 :]])
    return np.unique(np.concatenate(out))


def _sets(documents: DataFrame, key: str, text: str, size: int, share: int, of: int) -> DataFrame:
    """(key, n, digest, signs) of every row."""
    source = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bands(1000, share, of)
        for batch, words in blocks(batches, lowered=True):
            n, digests, signs = [], [], []
            for items in shingles_of(words, size):
                n.append(len(items))
                if not len(items):
                    digests.append(None)
                    signs.append(items.view(np.int64))
                    continue
                if known[-1].low <= len(items):
                    known = bands(4 * len(items), share, of)
                digests.append(xxhash.xxh3_128_digest(items.tobytes()))
                signs.append(signatures(items, [b for b in known if b.low <= len(items) <= b.high]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "signs": pa.array(signs, pa.list_(pa.int64()))})

    return source.mapInArrow(run, "key long, n long, digest binary, signs array<long>")


def similar(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """(key, n_shingles, component): documents link when their shingle sets'
    Jaccard similarity is at least ``share / of``; a component is named by its
    smallest key."""
    found = settle(_sets(documents, key, text, size, share, of), "sets")
    classes = found.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("node"))
    members = settle(found.select("key", "n", "digest").join(classes, "digest", "left").select("key", "n", F.coalesce("node", "key").alias("node")), "members")
    nodes = found.where("n > 0 AND key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("signs").alias("signs"))
    groups = settle(keep_shared(nodes.select(F.explode("signs").alias("sign"), "key", "n"), "n").withColumnRenamed("key", "node"), "groups")
    discard(found)
    # Texts with the same key belong together.
    keyed = members.where("n > 0 AND key IS NOT NULL")
    nodes = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top").select("key", F.col("low").alias("a"))
    twins = settle(keyed.join(nodes, "key").select("a", F.col("node").alias("b")).where("a < b").distinct(), "twins")
    wanted = groups.select(F.col("node").alias("key")).distinct()
    source = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, lowered=True):
            sets = [items.view(np.int64) for items in shingles_of(words, size)]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "items": pa.array(sets, pa.list_(pa.int64()))})

    sets = settle(source.mapInArrow(run, "key long, items array<long>"), "items")

    named = connect(groups, lambda pairs: matched(pairs, sets, share, of), lambda a, b: of * F.least(a, b) >= share * F.greatest(a, b), lambda stars: Stars(stars, sets, share, of), twins)
    discard(groups, sets)
    return members.join(named, "node", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


#: Of shingles of four words and a similarity of 0.85.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
