"""Document fingerprints by a randomised edit embedding.

A walk reads a text character by character while a clock runs: at each tick a
shared random bit, given by the tick and the character read, says whether to
move on. The sequence of characters read, tick by tick and with blanks after the
end, is the embedding: after few edits two walks soon read the same characters
at the same ticks again, so a small edit distance becomes a small Hamming
distance. A fingerprint keeps the embedding's length and a byte for each of the
``SAMPLED`` ticks of lowest shared priority, so fingerprints of texts of any
lengths share the ticks that both reach.

``likeness`` compares two fingerprints; ``near_documents`` finds candidates by
bands of sampled ticks, of which one must agree, and verifies them by likeness.
Texts are banded at their own length and at shorter ones, so lengths may differ.
Null counts as empty. Texts of any length are walked to their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.components import connect
from itemloom.llm.shared import keep_shared, settle, shuffle_width, slices

SAMPLED = 128
#: The embedding has so many ticks a character, and at least ``LEAST``.
TICKS = 3
LEAST = 256
#: Ticks after which the shared random bits begin again, and classes of characters.
PERIOD = 4096
CLASSES = 256
#: Up to so many texts are walked one by one.
ALONE = 16
#: Bands of sampled ticks, of which candidates share one.
BANDS, PER_BAND = 16, 6
#: The likeness of near documents.
LEAST_LIKE = 0.8


@cache
def _steps() -> list[list[int]]:
    """For a class of characters and a tick: ticks until the walk has moved on."""
    moves = np.random.default_rng(41).integers(0, 2, (CLASSES, 2 * PERIOD), dtype=np.uint8)
    moves[:, PERIOD:] = moves[:, :PERIOD]
    out = np.zeros((CLASSES, 2 * PERIOD + 1), np.int64)
    for tick in range(2 * PERIOD - 1, -1, -1):
        out[:, tick] = np.where(moves[:, tick] == 1, 1, out[:, tick + 1] + 1)
    return [row.tolist() for row in out[:, :PERIOD]]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _classes(points: np.ndarray) -> bytes:
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def walk(classes: bytes, tick: int = 0) -> np.ndarray:
    """The tick at which the walk leaves each character, begun at ``tick``."""
    steps, mask = _steps(), PERIOD - 1
    return np.fromiter(accumulate(classes, lambda t, c: t + steps[c][t & mask], initial=tick), np.int64, len(classes) + 1)[1:]


@cache
def _table() -> np.ndarray:
    return np.array(_steps(), np.int64).ravel()


def walks(classes: list[bytes], ticks: list[int]) -> list[np.ndarray]:
    """``walk`` of many texts, each begun at its tick: a character of every text at
    once, longer texts first; the last ``ALONE`` texts go on by themselves."""
    if not classes:
        return []
    ends = np.cumsum([len(c) for c in classes])
    starts = ends - [len(c) for c in classes]
    flat, left = np.frombuffer(b"".join(classes), np.uint8), np.empty(int(ends[-1]), np.int64)
    order = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[order]
    at, tick, table, mask = starts[order], np.array(ticks, np.int64)[order], _table(), PERIOD - 1
    upto = int(lengths[ALONE]) if len(order) > ALONE else 0
    # Texts that are longer than each place.
    for count in np.searchsorted(-lengths, -np.arange(upto), "left").tolist():
        at, tick = at[:count], tick[:count]
        tick = tick + table[flat[at].astype(np.int64) * PERIOD + (tick & mask)]
        left[at] = tick
        at = at + 1
    for text in order[: ALONE if upto else len(order)].tolist():
        begin = int(starts[text]) + upto
        left[begin : ends[text]] = walk(classes[text][upto:], int(left[begin - 1]) if upto else ticks[text])
    return np.split(left, ends[:-1])


@cache
def sampled_ticks(length: int) -> np.ndarray:
    """The ``SAMPLED`` ticks below ``length`` of lowest shared priority, in that order."""
    ticks, priorities = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for begin in range(0, length, 1 << 20):
        ticks = np.concatenate([ticks, np.arange(begin, min(length, begin + (1 << 20)), dtype=np.uint64)])
        x = (ticks + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        priorities = x ^ (x >> np.uint64(32))
        ticks = ticks[np.argsort(priorities)[:SAMPLED]]
    return ticks.astype(np.int64)


def rounded(ticks: int) -> int:
    """Lengths are rounded up to eight steps an octave, so few differ."""
    spare = max(0, ticks.bit_length() - 4)
    return -(-ticks >> spare) << spare if ticks > 0 else 0


def fingerprint(points: np.ndarray, left: np.ndarray) -> str:
    """Of a text's code points and the ticks at which its walk leaves them."""
    length = max(LEAST, rounded(TICKS * len(points)))
    ticks = sampled_ticks(length)
    at = np.searchsorted(left, ticks, side="right")
    read = np.zeros(len(ticks), np.uint8)
    inside = at < len(points)
    read[inside] = ((points[at[inside]] * np.uint32(2246822519)) >> np.uint32(24)).astype(np.uint8) | np.uint8(1)
    return f"{length:08x}{read.tobytes().hex()}"


def of_text(text: str) -> str:
    points = _code_points(text)
    return fingerprint(points, walk(_classes(points)))


def likeness(one: str, two: str) -> float:
    """The share of equal bytes among the first ticks of both samples: those that
    only the longer text reaches count as different, blanks of both don't count."""
    if one == two:
        return 1.0
    lengths = int(one[:8], 16), int(two[:8], 16)
    a, b = np.frombuffer(bytes.fromhex(one[8:]), np.uint8), np.frombuffer(bytes.fromhex(two[8:]), np.uint8)
    if lengths[0] != lengths[1]:
        if lengths[0] > lengths[1]:
            a, b, lengths = b, a, lengths[::-1]
        within = sampled_ticks(lengths[1]) < lengths[0]
        common = int(within.sum())
        a, longer = a[:common], b[within]
        outside = int((b[~within] > 0).sum())
        b = longer
    else:
        outside = 0
    told = (a > 0) | (b > 0)
    total = int(told.sum()) + outside
    return float(((a == b) & told).sum() / total) if total else 1.0


def band_signs(own: str, least: float) -> list[int]:
    """Hashes of a fingerprint's bands at its length and at each shorter one of a
    text that ``likeness`` may find as like as ``least``: enough of what is read
    must lie below it. The samples of two lengths begin with the same ticks below
    the shorter one, so their bands are the same."""
    length, read = int(own[:8], 16), np.frombuffer(bytes.fromhex(own[8:]), np.uint8)
    ticks, needed, signs = sampled_ticks(length), least * int((read > 0).sum()), []
    while length >= LEAST:
        seen = read[ticks < length]
        if int((seen > 0).sum()) < needed:
            break
        signs += [xxhash.xxh3_64_intdigest(seen[PER_BAND * i : PER_BAND * (i + 1)].tobytes(), seed=(length << 8) + i) for i in range(min(BANDS, len(seen) // PER_BAND))]
        length -= 1 << max(0, (length - 1).bit_length() - 4)
    return signs


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) of every row."""
    source = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            bodies = batch.column("body").to_pylist()
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_chars": pa.array([len(b) for b in bodies], pa.int64()), "fingerprint": pa.array([of_text(b) for b in bodies], pa.string())})

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def near_documents(prints: DataFrame, key: str = "doc_id", least: float = LEAST_LIKE) -> DataFrame:
    """(key, component) of (key, fingerprint): documents whose fingerprints agree
    in all ticks of a band are candidates, and linked if they are as like as
    ``least``. Equal fingerprints are one class; see ``connect`` for large bands."""
    classes = settle(prints.groupBy("fingerprint").agg(F.min(key).cast("long").alias("node")), "prints")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(band_signs(x, least), np.uint64).view(np.int64) for x in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column("node"), "signs": pa.array(found, pa.list_(pa.int64()))})

    signed = classes.where("node IS NOT NULL").select("node", "fingerprint").mapInArrow(sign, "key long, signs array<long>")
    groups = keep_shared(signed.select(F.explode("signs").alias("sign"), "key")).select("sign", F.col("key").alias("node"), F.lit(1).alias("n"))

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("one")), classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("two"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [likeness(x, y) >= least for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")})

        return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")

    named = connect(settle(groups, "bands"), verify, lambda a, b: F.lit(True))
    return prints.select(key, "fingerprint").join(classes, "fingerprint").join(named, "node", "left").select(key, F.coalesce("component", "node").alias("component"))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = ("edited_sha256", "edited_fingerprint", "near_edited", "near_next", "bands_edited", "bands_next")
EDITED = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long"


#: A text's code points, the ticks at which its walk leaves them, fingerprint and bands.
Walked = tuple[np.ndarray, np.ndarray, str, set[int]]


def _bands(own: str) -> set[int]:
    return set(band_signs(own, LEAST_LIKE))


def _compared(pairs: list[tuple[str, Walked, str, str, set[int]]]) -> list[tuple]:
    """For each text, given with what follows it, that one's fingerprint and bands:
    digest and fingerprint of the edited text, and for this and the following text
    the likeness and the number of shared bands, of which candidates have one."""
    others = [edited(text, following) for text, _, following, _, _ in pairs]
    kept = [len(text) - len(text) // 2 for text, *_ in pairs]
    rests = [_code_points(other[k:]) for other, k in zip(others, kept, strict=True)]
    # The walk over what is kept is the same.
    tails = walks([_classes(rest) for rest in rests], [int(own[1][k - 1]) if k else 0 for (_, own, *_), k in zip(pairs, kept, strict=True)])
    out = []
    for (_, (points, left, mine, bands), _, next_print, next_bands), other, k, rest, tail in zip(pairs, others, kept, rests, tails, strict=True):
        theirs = fingerprint(np.concatenate([points[:k], rest]), np.concatenate([left[:k], tail]))
        out.append((hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), theirs, likeness(mine, theirs), likeness(mine, next_print), len(bands & _bands(theirs)), len(bands & next_bands)))
    return out


def _walked(texts: list[str]) -> list[Walked]:
    points = [_code_points(text) for text in texts]
    lefts = walks([_classes(p) for p in points], [0] * len(texts))
    prints = [fingerprint(p, left) for p, left in zip(points, lefts, strict=True)]
    return [(p, left, own, _bands(own)) for p, left, own in zip(points, lefts, prints, strict=True)]


def compare_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint, its edited text's (the last half replaced by the
    beginning of the next document in descending order of keys; after the last
    comes the first), and their likeness to each other and to the next one's.

    Rows are sorted over ranges of keys. Each range pairs its rows; its last one
    meets the next range's first one afterwards, in a table of a row per range.
    Equal keys are ordered by their texts' hashes.
    """
    source = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    order = F.col("key").desc(), F.xxhash64("body").desc(), F.col("body").desc()
    ordered = source.repartitionByRange(shuffle_width(documents.sparkSession), *order[:2]).sortWithinPartitions(*order)
    fields = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands_edited", pa.int64()), ("bands_next", pa.int64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head = TaskContext.get().partitionId(), None, None

        def row(key: int, text: str, own: tuple, compared: tuple, tail: str | None) -> dict:
            return {"key": key, "n_chars": len(text), "fingerprint": own[2], "part": part, "head": head, "tail": tail} | dict(zip(COMPARED, compared, strict=True))

        for batch in slices(batches, "body", 4_000_000):
            bodies = batch.column("body").to_pylist()
            if not bodies:
                continue
            texts = [*([] if held is None else [held]), *zip(batch.column("key").to_pylist(), bodies, _walked(bodies), strict=True)]
            if held is None:
                head = bodies[0]
            rows = []
            for one, compared in zip(texts, _compared([(text, own, body, *after[2:]) for (_, text, own), (_, body, after) in pairwise(texts)])):
                rows.append(row(*one, compared, None))
                head = None
            held = texts[-1]
            yield pa.RecordBatch.from_pylist(rows, fields)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row(*held, (None,) * len(COMPARED), held[1])], fields)

    done = settle(ordered.mapInArrow(run, EDITED + ", part int, head string, tail string"), "edits")
    # A row for each range of keys.
    heads = done.where("head IS NOT NULL").select("part", F.col("head").alias("body"), F.col("fingerprint").alias("body_print"))
    over = Window.orderBy("part")
    nexts = heads.select("part", *(F.coalesce(F.lead(c).over(over), F.first(c).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(c) for c in ("body", "body_print")))
    tails = done.where("tail IS NOT NULL").select("part", "key", "tail").join(nexts, "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.to_pylist()
            walked = _walked([x["tail"] for x in ends])
            found = _compared([(x["tail"], own, x["body"], x["body_print"], _bands(x["body_print"])) for x, own in zip(ends, walked, strict=True)])
            rows = [{"key": x["key"], "n_chars": len(x["tail"]), "fingerprint": own[2]} | dict(zip(COMPARED, compared, strict=True)) for x, own, compared in zip(ends, walked, found, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*fields][:-3]))

    return done.where("tail IS NULL").drop("part", "head", "tail").unionByName(tails.select("key", "tail", "body", "body_print").mapInArrow(meet, EDITED)).withColumnRenamed("key", key)
