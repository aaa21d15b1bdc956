"""Line dedup: an exact set-similarity join of lines with prefix filters.

A line is the set of its words (A-Z lowered, split at ASCII white space). Words
are ordered by rarity, from counts over all documents in a table of fixed size;
any order is right, a good one keeps candidates few. Lines that are similar
enough share one of their first words, so each line is signed by these; a word that
all documents have once signs nothing. Rows of
a sign come together, and its lines are compared: lengths, the words'
places and 64 parity bits of the sets leave few pairs. A pair that also shares the
word before the sign is met under that one, so not once more. Of each line's pairs, the
earliest is verified on the sets, the rest only where it doesn't match. A line goes if it matches one that
begins earlier (smaller key, or same key and smaller line number), whatever
becomes of that one; so one match is enough.

Spark moves the rows of signs packed: parts of the signs are a few for each task, and
a part's rows of a block of documents are one row of Spark, with the bytes of each column.

What this leaves open is settled by the sets: lines with more than ``MANY``
candidates that weren't removed, lines of signs with more than ``RUN`` lines, and
those of words so frequent that their rows are dealt to many tasks. Such lines, the probes, meet all earlier
ones of the sign. Where a sign is crowded it is first joined with each other one
of a line's first words, of which similar lines share as many as are taken, up
to ``DEPTH`` words. So no match is lost, and no group is expanded into pairs.

Lines of equal sets are told by a 64-bit hash, and all but the first of them go.
Lines without words stay. Rows with the same key and text are one document, rows
with the same key and other texts are different ones (in the order of a hash of
the text), and rows without a key stay as they are; null counts as empty. Lines
of any length stay whole. An empty table gives an empty one; columns of any other
name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from itemloom.llm.shared import discard, settle, shuffle_width, slices, told_apart
from itemloom.llm.words import Words, blocks, mixed

#: Cells of the table of word counts.
CELLS, BLOCK = 1 << 22, 1 << 14
#: The earliest candidates of a row, which are noted in any case.
FEW = 4
#: Candidates of a row up to which all are noted at once.
MANY = 64
#: The most lines of a sign that are all compared with each other.
RUN = 1 << 14
#: Neighbours that a line of a longer run is compared with.
NEAR = 64
#: Words of a sign, at most.
DEPTH = 4
#: The most lines that are broadcast.
BROADCAST = 100_000
#: Lines of more words have ``MORE`` times 64 further bits (a power of two less one).
LONG, MORE = 64, 3
#: A word is frequent if it makes up this share of what a task gets on average.
FREQUENT = 0.25
#: And if it is among so many words, at least.
LEAST = 1 << 12
#: Rows that are compared at once; a longer run is handled in pieces.
CHUNK = 1 << 18
#: Parts of the signs for each task, at least.
PARTS = 8
#: The rank of a word that all documents have once.
ONCE = 8
PLACE = (1 << 32) - 1
PARITIES = [f"parity{i}" for i in range(1 + MORE)]
#: The columns of a sign's row and their types; ``more`` has the further parities of long lines only.
PACKED = {"sign": np.int64, "before": np.uint64, "class": np.int64, "key": np.int64, "line": np.int64, "n": np.int32, "place": np.int32, "hot": np.bool_, "parity0": np.uint64, "more": np.uint64}


def least_common(n, share: int, of: int):
    """The fewest words that a line of ``n`` shares with a match."""
    return -(-share * n // of)


def only_equal(n, share: int, of: int):
    """Whether a line of ``n`` words matches none but equal ones."""
    return (n * of // share == n) & (least_common(n, share, of) == n)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


class _Lines:
    """The distinct words of a block's lines, line by line; with ``rarity`` (by
    cell) the rarest come first."""

    def __init__(self, words: Words, rarity: np.ndarray | None = None):
        self.first, line = words.lines()
        hashes = words.hashes
        rank = np.zeros(len(hashes), np.uint64) if rarity is None else rarity[_cells(hashes)].astype(np.uint64)
        self.n = int(self.first[-1])
        slim = (line.astype(np.uint64) << np.uint64(40)) | (rank << np.uint64(32)) | (hashes >> np.uint64(32))
        at = np.argsort(slim)
        key = slim[at]
        if self.n >= 1 << 24 or ((key[1:] == key[:-1]) & (hashes[at[1:]] != hashes[at[:-1]])).any():
            at = np.lexsort((hashes, rank, line))
        line, hashes = line[at], hashes[at]
        new = np.ones(len(at), bool)
        new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.hashes = line[new], hashes[new]
        self.sizes = np.bincount(self.line, minlength=self.n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.full = np.flatnonzero(self.sizes)

    def classes(self) -> np.ndarray:
        """A hash of each line's set."""
        sums = np.zeros(self.n, np.uint64)
        if len(self.full):
            sums[self.full] = np.add.reduceat(mixed(self.hashes), self.starts[self.full])
        return mixed(sums + self.sizes.astype(np.uint64))

    def parities(self) -> np.ndarray:
        """64 bits per line, of which each word flips one: two lines differ in as
        many words, at least, as their bits do. For lines of more than ``LONG`` words
        further rows tell which of these words flip one of 64, 128 and 192 other bits."""
        out = np.zeros((1 + MORE, self.n), np.uint64)
        if len(self.full):
            bits, part = np.uint64(1) << (self.hashes & np.uint64(63)), (self.hashes >> np.uint64(6)) & np.uint64(MORE)
            out[0, self.full] = np.bitwise_xor.reduceat(bits, self.starts[self.full])
            long = self.full[self.sizes[self.full] > LONG]
            if len(long):
                some = self.sizes[self.line] > LONG
                bits, part = bits[some], part[some]
                starts = np.cumsum(self.sizes[long]) - self.sizes[long]
                for i in range(1, 1 + MORE):
                    out[i, long] = np.bitwise_xor.reduceat(np.where(part == i, bits, 0), starts)
        return out

    def signs(self, classes: np.ndarray, share: int, of: int) -> tuple[np.ndarray, ...]:
        """(line, place, sign, word, before): the rarest words, of which similar lines
        share one, and the words before these, or 0. Lines that only equal ones match
        have one sign for their set."""
        n = self.sizes
        alone = only_equal(n, share, of)
        length = np.where(alone, np.minimum(n, 1), n - least_common(n, share, of) + 1)
        place = np.arange(len(self.hashes)) - self.starts[self.line]
        some = np.flatnonzero(place < length[self.line])
        line, place, word = self.line[some], place[some], self.hashes[some]
        return line, place, np.where(alone[line], mixed(~classes[line]), word), word, np.where(place > 0, self.hashes[some - 1], np.uint64(0))


def _rarity(source: DataFrame) -> tuple[np.ndarray, int]:
    """Per cell the logarithm of its words' count in all documents, as a small
    number, and the number of words; the cells' counts are summed by
    Spark, in blocks of ``BLOCK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for _, words in blocks(batches, lowered=True):
            np.add.at(counts, _cells(words.hashes), 1)
        full = np.flatnonzero(counts)
        edges = np.searchsorted(full, np.arange(0, CELLS + 1, BLOCK))
        parts = [(i, full[low:high]) for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if low < high]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([i for i, _ in parts], pa.int64()), "cells": pa.array([(at % BLOCK).astype(np.uint16).tobytes() for _, at in parts], pa.binary()),
            "counts": pa.array([np.minimum(counts[at], (1 << 32) - 1).astype(np.uint32).tobytes() for _, at in parts], pa.binary()),
        })

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts")), strict=True):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
        ranks = [np.minimum(8 * np.log2(x + 1), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int64()), "ranks": pa.array(ranks, pa.binary()), "words": pa.array([int(x.sum()) for x in sums.values()], pa.int64())})

    parts = source.select("body").mapInArrow(run, "block long, cells binary, counts binary").repartition("block")
    summed = settle(parts.mapInArrow(total, "block long, ranks binary, words long"), "rarity")
    out, words = np.zeros((CELLS // BLOCK, BLOCK), np.uint8), 0
    # A byte for each cell in all.
    for row in summed.toLocalIterator():
        out[row.block] = np.frombuffer(bytes(row.ranks), np.uint8)
        words += row.words
    discard(summed)
    return out.reshape(-1), words


def _packed(held: list[dict[str, np.ndarray]], parts: int) -> pa.RecordBatch:
    """A row for each part, with its rows' columns as bytes."""
    columns = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
    part = (mixed(columns.pop("dealt")) % np.uint64(parts)).astype(np.int32)
    at = np.argsort(part)
    names, edges = np.unique(part[at], return_index=True)
    edges = np.append(edges, len(at))
    parity, long = columns.pop("parity")[at], columns["n"][at] > LONG
    columns = {c: x[at].astype(PACKED[c], copy=False) for c, x in columns.items()} | {"parity0": parity[:, 0].copy(), "more": parity[long, 1:].reshape(-1)}
    ends = {c: edges * x.itemsize for c, x in columns.items()} | {"more": np.append(0, np.cumsum(long))[edges] * MORE * 8}
    packed = [pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends[c].astype(np.int32)), pa.py_buffer(columns[c])]) for c in PACKED]
    return pa.RecordBatch.from_arrays([pa.array(names), *packed], ["part", *PACKED])


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The rows of some parts, each with its part."""
    columns = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in PACKED.items()}
    more, long = columns.pop("more").reshape(-1, MORE), np.flatnonzero(columns["n"] > LONG)
    for i, c in enumerate(PARITIES[1:]):
        columns[c] = np.zeros(len(columns["n"]), np.uint64)
        columns[c][long] = more[:, i]
    sizes = [len(x) // np.dtype(PACKED["sign"]).itemsize for x in batch.column("sign").to_pylist()]
    return columns | {"part": np.repeat(batch.column("part").to_numpy(), sizes)}


def _signed(source: DataFrame, rarity: np.ndarray, frequent: int, parts: int, share: int, of: int) -> DataFrame:
    """Rows of the lines' signs, packed by ``parts``. Rows that are ``hot``, those of
    frequent words, are dealt by their lines. Of equal lines of a block only the first
    has all signs, the others the one at place 0."""
    shared = source.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch, words in blocks(batches, lowered=True):
            own = _Lines(words, shared.value)
            classes, parity = own.classes(), own.parities()
            number = np.arange(own.n) - np.repeat(own.first[:-1], np.diff(own.first)) + np.repeat(batch.column("twin").to_numpy(), np.diff(own.first))
            key = np.repeat(batch.column("key").to_numpy(), np.diff(own.first))
            order = np.lexsort((number, key, classes))
            later = np.zeros(own.n, bool)
            later[order[1:]] = classes[order[1:]] == classes[order[:-1]]
            line, place, sign, word, before = own.signs(classes, share, of)
            rank = shared.value[_cells(word)]
            # A word of one place has no other line.
            used = (~later[line] | (place == 0)) & (rank > ONCE)
            line, place, sign, before, hot = line[used], place[used], sign[used], before[used], rank[used] >= frequent
            held.append({
                "sign": sign.view(np.int64), "before": before, "class": classes[line].view(np.int64), "key": key[line], "line": number[line], "n": own.sizes[line], "place": place, "hot": hot,
                "parity": parity.T[line], "dealt": np.where(hot, classes[line] + key[line].astype(np.uint64), sign),
            })
            if sum(len(x["sign"]) for x in held) >= CHUNK // 2:
                yield _packed(held, parts)
                held = []
        if held:
            yield _packed(held, parts)

    return source.mapInArrow(run, ", ".join(["part int", *(f"{c} binary" for c in PACKED)]))


class _Earliest:
    """The ``FEW`` smallest candidates of each row, and how many it has."""

    def __init__(self, rows: int):
        self.best = np.full((FEW, rows), np.iinfo(np.int64).max)
        self.count = np.zeros(rows, np.int64)

    def offer(self, row: np.ndarray, candidate: np.ndarray) -> None:
        """Each row is named once."""
        new = (self.best[:, row] != candidate).all(axis=0)
        row, candidate = row[new], candidate[new]
        self.count[row] += 1
        for best in self.best:
            known = best[row]
            best[row] = np.minimum(known, candidate)
            candidate = np.maximum(known, candidate)


def _alike(i: np.ndarray, j: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray, parity: np.ndarray, share: int, of: int) -> np.ndarray:
    """Whether rows of one sign may match: by length, place and parity. Lines that
    share the word before, too, meet there: what the places tell is the same."""
    both = n[i] + n[j]
    good = of * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
    good &= (before[i] != before[j]) | (before[i] == 0)
    most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
    good &= most * (of + share) >= share * both
    at = np.flatnonzero(good)
    i, j = i[at], j[at]
    both = both[at]
    apart = parity[:, i] ^ parity[:, j]
    least = np.bitwise_count(apart[0]).astype(np.int64)
    long = np.flatnonzero((n[i] > LONG) & (n[j] > LONG))
    if len(long):
        # What the further parts don't have is in the first one.
        more = apart[1:, long]
        least[long] = np.bitwise_count(more).sum(axis=0, dtype=np.int64) + np.bitwise_count(apart[0, long] ^ np.bitwise_xor.reduce(more))
    good[at] = least * (of + share) <= (of - share) * both
    return good


def _in_order(sign: np.ndarray, n: np.ndarray, name: np.ndarray, key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The rows by sign, size, class, key and line."""
    run = np.unique(sign, return_inverse=True)[1]
    if len(n) and n.max() < 1 << 12 and len(run) < 1 << 20:
        slim = (run.astype(np.uint64) << np.uint64(44)) | (n.astype(np.uint64) << np.uint64(32)) | (name.view(np.uint64) >> np.uint64(32))
        at = np.argsort(slim)
        slim = slim[at]
        same = slim[1:] == slim[:-1]
        if not (same & (name[at[1:]] != name[at[:-1]])).any():
            equal = np.zeros(len(at), bool)
            equal[1:] |= same
            equal[:-1] |= same
            some = at[equal]
            at[equal] = some[np.lexsort((line[some], key[some], slim[equal]))]
            return at
    return np.lexsort((line, key, name, n, sign))


def _compared(columns: dict[str, np.ndarray], cut: np.ndarray, share: int, of: int) -> tuple[np.ndarray, ...]:
    """Of rows sorted by sign, size, class, key and line: copies of a line
    that stands before them; pairs of an earlier and a later row, the earliest of each later one;
    more such pairs; rows that may have still more; the rows of their signs; the rows of open
    signs, and whether they may match others. Rows are given by number; signs that are
    ``cut`` have rows elsewhere, too."""
    sign, name, key, line = (columns[c] for c in ("sign", "class", "key", "line"))
    n, place, before, parity = columns["n"].astype(np.int64), columns["place"].astype(np.int64), columns["before"], np.stack([columns[c] for c in PARITIES])
    again = np.zeros(len(sign), bool)
    again[1:] = (sign[1:] == sign[:-1]) & (name[1:] == name[:-1])
    whole = np.maximum.accumulate(np.where(again, 0, np.arange(len(sign))))
    copies = np.flatnonzero(again & (place == 0) & ((key != key[whole]) | (line != line[whole])))
    begins = np.ones(len(sign), bool)
    begins[1:] = sign[1:] != sign[:-1]
    rows = np.flatnonzero(~again)
    run = np.cumsum(begins)[rows] - 1
    length = np.bincount(run, minlength=int(begins.sum()))
    rows, run = rows[(length[run] > 1) | cut[rows]], run[(length[run] > 1) | cut[rows]]
    n, place, before, parity, open_ = n[rows], place[rows], before[rows], parity[:, rows], cut[rows]
    by_age = np.lexsort((line[rows], key[rows]))
    age = np.empty(len(rows), np.int64)
    age[by_age] = np.arange(len(rows))

    found = _Earliest(len(rows))
    crowded = length[run] > RUN
    if len(rows):
        # The first row of each longer run, by age.
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        lead = by_age[np.repeat(np.minimum.reduceat(age, starts), np.diff(np.append(starts, len(run))))]
        some = np.flatnonzero(crowded & (lead != np.arange(len(rows))))
        some = some[_alike(some, lead[some], n, place, before, parity, share, of)]
        found.offer(some, age[lead[some]])
    met = _Met(n, place, before, parity, run, ~crowded, share, of)
    for i, j in met.pairs(np.ones(len(rows), bool)):
        late = age[i] > age[j]
        found.offer(i[late], age[j[late]])
        found.offer(j[~late], age[i[~late]])
    open_ = (crowded | open_) & ~only_equal(n, share, of)
    which, later = np.nonzero(found.best < np.iinfo(np.int64).max)
    earlier = by_age[found.best[which, later]]
    first, rest = [(earlier[which == 0], later[which == 0])], [(earlier[which > 0], later[which > 0])]
    # All candidates of rows with some more.
    some = (found.count > FEW) & (found.count <= MANY) & ~open_
    for i, j in met.pairs(np.isin(run, run[some])) if some.any() else ():
        late = age[i] > age[j]
        i, j = np.where(late, i, j), np.where(late, j, i)
        rest.append((j[some[i]], i[some[i]]))
    first, rest = (tuple(rows[np.concatenate(x)] for x in zip(*pairs, strict=True)) for pairs in (first, rest))
    marked = (found.count > MANY) & ~open_
    kept = np.flatnonzero(crowded | cut[rows])
    return copies, first, rest, rows[marked], rows[np.isin(run, run[marked])], rows[kept], open_[kept]


class _Met:
    """Pairs of rows in runs that may match."""

    def __init__(self, n: np.ndarray, place: np.ndarray, before: np.ndarray, parity: np.ndarray, run: np.ndarray, whole: np.ndarray, share: int, of: int):
        self.n, self.place, self.before, self.parity, self.run, self.whole, self.share, self.of = n, place, before, parity, run, whole, share, of

    def pairs(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) with i beyond j, each i and each j once in an array, of the
        ``wanted`` runs; rows of runs that aren't ``whole`` meet some neighbours."""
        n, run, share, of = self.n, self.run, self.share, self.of
        offset, active = 1, np.flatnonzero((run[1:] == run[:-1]) & wanted[1:]) + 1
        while len(active):
            # Sizes only fall from here: a row whose neighbour is too small has met all it can.
            active = active[of * n[active - offset] >= share * n[active]]
            i = active[_alike(active, active - offset, n, self.place, self.before, self.parity, share, of)]
            if len(i):
                yield i, i - offset
            offset += 1
            active = active[active >= offset]
            active = active[(run[active] == run[active - offset]) & (self.whole[active] | (offset <= NEAR))]


_MET = ", ".join(["kind int", *(f"{c} long" for c in ("key", "line", "a_key", "a_line", "sign", "class", "n", *PARITIES))])
#: Kinds of rows: copies of earlier lines; lines with the earliest one that may match,
#: and with a further one; lines with still more in this sign, and the rows of such
#: signs; rows of open signs, and those of them that may match others.
COPY, PAIR, FURTHER, MARK, STAND, TARGET, PROBE = range(7)


def _met(rows: DataFrame, share: int, of: int) -> DataFrame:
    """What comes of comparing the lines of each sign, by kind."""
    ordered = rows.repartition(shuffle_width(rows.sparkSession), "part").sortWithinPartitions("part")

    def told(columns: dict[str, np.ndarray], cut: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
        """Of the rows that are ``done``; empties ``columns``."""
        # Most of the rows that have a sign alone go before the sorting.
        some = np.flatnonzero(done)
        _, run, count = np.unique(columns["sign"][some], return_inverse=True, return_counts=True)
        some = some[(count[run] > 1) | cut[some]]
        some = some[_in_order(*(columns[c][some] for c in ("sign", "n", "class", "key", "line")))]
        # A column's unsorted values go as soon as they are copied.
        columns, cut = {c: columns.pop(c)[some] for c in list(columns)}, cut[some]
        copies, (earlier, later), (earlier_too, later_too), marks, stand, kept, probes = _compared(columns, cut, share, of)
        parts = [(COPY, copies), (PAIR, later), (FURTHER, later_too), (MARK, marks), (STAND, stand), (TARGET, kept)]
        own = np.concatenate([x for _, x in parts])
        kind = np.repeat(np.array([k for k, _ in parts], np.int32), [len(x) for _, x in parts])
        kind[len(own) - len(kept) :] += probes
        other = own.copy()
        other[len(copies) : len(copies) + len(earlier) + len(earlier_too)] = np.concatenate([earlier, earlier_too])
        paired, signed, open_ = (kind == PAIR) | (kind == FURTHER), kind >= MARK, kind >= STAND
        sign, name, key, line = (columns[c] for c in ("sign", "class", "key", "line"))
        return pa.RecordBatch.from_pydict({
            "kind": kind, "key": key[own], "line": line[own], "a_key": pa.array(key[other], mask=~paired), "a_line": pa.array(line[other], mask=~paired),
            "sign": pa.array(sign[own], mask=~signed), "class": pa.array(name[own], mask=~open_), "n": pa.array(columns["n"][own].astype(np.int64), mask=~open_),
        } | {c: pa.array(columns[c][own].view(np.int64), mask=~open_) for c in PARITIES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        # Signs whose runs are handled in several pieces.
        split = np.empty(0, np.int64)

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal split
            columns = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            part, sign = columns.pop("part"), columns["sign"]
            done = (part != part[-1]) | last
            if not done.any():
                # A part that is too long, so the longest runs of it go ahead.
                names, which, count = np.unique(sign, return_inverse=True, return_counts=True)
                longest = np.argsort(-count, kind="stable")
                longest = longest[: 1 + int(np.searchsorted(np.cumsum(count[longest]), len(sign) // 2))]
                split, done = np.union1d(split, names[longest]), np.isin(which, longest)
            held.clear()
            if not done.all():
                held.append({c: x[~done] for c, x in columns.items()} | {"part": part[~done]})
            # Rows of frequent words and of runs in pieces have others elsewhere.
            cut = columns["hot"] | np.isin(sign, split)
            del sign
            yield told(columns, cut, done)

        for batch in batches:
            if batch.num_rows:
                held.append(_unpacked(batch))
                if sum(len(x["sign"]) for x in held) >= CHUNK:
                    yield from pieces(False)
        if held and sum(len(x["sign"]) for x in held):
            yield from pieces(True)

    return ordered.mapInArrow(run, _MET)


def _sets(source: DataFrame, wanted: DataFrame, unique: bool, few: bool = False) -> DataFrame:
    """(key, line, items) of the ``wanted`` lines (key, line), which are broadcast if
    they are ``few``."""
    twin = F.shiftright("line", 32)
    lines = wanted.groupBy("key", twin.alias("twin_at")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    rows = source.withColumn("twin_at", F.shiftright("twin", 32)).join(lines.hint("broadcast" if few else "shuffle_hash"), ["key", "twin_at"])
    rows = (rows if unique else rows.dropDuplicates(["key", "twin_at"])).select("key", "twin", "body", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, lowered=True):
            own = _Lines(words)
            per_text = np.diff(batch.column("lines").offsets.to_numpy())
            line = batch.column("lines").flatten().to_numpy()
            at = line - np.repeat(batch.column("twin").to_numpy() - own.first[:-1], per_text)
            ends = np.concatenate([[0], np.cumsum(own.sizes[at])])
            items = np.repeat(own.starts[at] - ends[:-1], own.sizes[at]) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own.hashes[items].view(np.int64))
            yield pa.RecordBatch.from_pydict({"key": np.repeat(batch.column("key").to_numpy(), per_text), "line": line, "items": lists})

    return rows.mapInArrow(run, "key long, line long, items array<long>")


def _matching(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """The lines (key, line) of the pairs whose sets match."""
    theirs = sets.select(F.col("key").alias("a_key"), F.col("line").alias("a_line"), F.col("items").alias("theirs"))
    rows = pairs.select("key", "line", "a_key", "a_line").distinct().join(theirs, ["a_key", "a_line"]).drop("a_key", "a_line").join(sets, ["key", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "theirs", 4_000_000):
                rows = np.arange(batch.num_rows)
                sizes = [np.diff(batch.column(c).offsets.to_numpy()) for c in ("theirs", "items")]
                hashes = np.concatenate([batch.column(c).flatten().to_numpy() for c in ("theirs", "items")])
                row = np.concatenate([np.repeat(rows, s) for s in sizes])
                at = np.lexsort((hashes, row))
                same = (hashes[at[1:]] == hashes[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
                common = np.bincount(row[at[1:]][same], minlength=batch.num_rows)
                good = of * common >= share * (sizes[0] + sizes[1] - common)
                yield batch.select(["key", "line"]).filter(pa.array(good))

    return rows.mapInArrow(run, "key long, line long").distinct()


def _deeper(rows: DataFrame, sets: DataFrame, rarity: np.ndarray, share: int, of: int) -> DataFrame:
    """``rows`` (key, line, words, ...) with each other one of a line's first words
    added to ``words``; similar lines that share these share one of the new ones."""
    shared = rows.sparkSession.sparkContext.broadcast(rarity)
    more = [c for c in rows.columns if c not in ("key", "line", "words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (words, items) in enumerate(zip(batch.column("words").to_pylist(), batch.column("items"), strict=True)):
                own = items.values.to_numpy().view(np.uint64)
                own = own[np.lexsort((own, shared.value[_cells(own)]))][: len(own) - least_common(len(own), share, of) + 1 + len(words)].view(np.int64).tolist()
                new = [sorted([*words, word]) for word in own if word not in words]
                found += new
                at += [i] * len(new)
            out = batch.select(["key", "line", *more]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.list_(pa.int64()))], [*out.schema.names, "words"])

    wide = rows.join(sets, ["key", "line"])
    fields = {f.name: f.dataType.simpleString() for f in wide.schema}
    return wide.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in ("key", "line", *more)) + ", words array<long>").distinct()


def _settled_by_sets(open_: DataFrame, probes: DataFrame, source: DataFrame, sets: DataFrame, rarity: np.ndarray, share: int, of: int) -> DataFrame:
    """The lines among the ``probes`` (key, line, sign) that match an earlier one of
    the ``open_`` rows of the same sign."""
    line = ["key", "line"]
    rows = open_.join(probes.select("sign").distinct(), "sign", "left_semi").join(probes.withColumn("probe", F.lit(True)), [*line, "sign"], "left")
    rows = rows.select(*line, "n", *PARITIES, F.coalesce("probe", F.lit(False)).alias("probe"), F.array("sign").alias("words")).distinct()
    found, spent = None, []
    for depth in range(1, DEPTH + 1):
        rows = settle(rows, "open")
        spent.append(rows)
        groups = rows.groupBy("words").agg(F.count("*").alias("rows"), F.max("probe").alias("probed")).where("rows > 1 AND probed")
        rows = rows.join(groups, "words")
        small = rows if depth == DEPTH else rows.where(F.col("rows") <= RUN)
        other = small.select("words", *(F.col(c).alias(f"a_{c}") for c in ("key", "line", "n", *PARITIES)))
        first, *more = (F.col(c).bitwiseXOR(F.col(f"a_{c}")) for c in PARITIES)
        least = sum((F.bit_count(x) for x in more), F.bit_count(reduce(Column.bitwiseXOR, more, first)))
        least = F.when((F.col("n") > LONG) & (F.col("a_n") > LONG), least).otherwise(F.bit_count(first))
        fits = (of * F.least("n", "a_n") >= share * F.greatest("n", "a_n")) & (least * (of + share) <= (of - share) * (F.col("n") + F.col("a_n")))
        earlier = (F.col("a_key") < F.col("key")) | ((F.col("a_key") == F.col("key")) & (F.col("a_line") < F.col("line")))
        met = _matching(small.where("probe").join(other, "words").where(earlier & fits), sets, share, of)
        found = met if found is None else found.unionByName(met)
        rows = rows.where(F.col("rows") > RUN)
        if depth == DEPTH or rows.isEmpty():
            break
        rows = _deeper(rows.select(*line, "n", *PARITIES, "probe", "words"), sets, rarity, share, of)
    out = settle(found.distinct(), "removed")
    discard(*spent)
    return out


def removed_lines(source: DataFrame, share: int = 80, of: int = 100, unique: bool = False) -> DataFrame:
    """(key, line): the lines of ``source`` (key, twin, body) that match an earlier
    one; ``line`` counts from the document's ``twin``. ``unique`` says that no key is
    repeated."""
    line, width = ["key", "line"], shuffle_width(source.sparkSession)
    rarity, words = _rarity(source)
    frequent = int(8 * np.log2(FREQUENT * words / width + LEAST))
    # A line has no more signs than words, so a part has far fewer rows than are compared at once.
    parts = max(PARTS * width, 2 * words // CHUNK)
    met = settle(_met(_signed(source, rarity, frequent, parts, share, of), share, of), "pairs")
    copies, open_ = met.where(F.col("kind") == COPY).select(*line), met.where(F.col("kind") >= TARGET)
    # Equal lines of frequent words.
    first = open_.groupBy("class").agg(F.min(F.struct(*line)).alias("first"), F.max(F.struct(*line)).alias("last")).where("first < last").select("class", "first")
    copies = copies.unionByName(open_.join(first, "class").where(F.struct(*line) > F.col("first")).select(*line))
    pairs = met.where(F.col("kind").isin(PAIR, FURTHER)).select("kind", *line, "a_key", "a_line")
    ends = [pairs.select(*line), pairs.select(F.col("a_key").alias("key"), F.col("a_line").alias("line")), open_.select(*line)]
    sets = [settle(_sets(source, reduce(DataFrame.unionByName, ends).distinct(), unique), "items")]
    # Most lines match the earliest candidate; only of the others all are compared.
    best = pairs.where(F.col("kind") == PAIR).groupBy(*line).agg(F.min(F.struct("a_key", "a_line")).alias("a")).select(*line, "a.a_key", "a.a_line")
    # Tables without a common row.
    gone = [settle(copies.unionByName(_matching(best, sets[0], share, of)).distinct(), "removed")]
    gone.append(settle(_matching(pairs.join(gone[0], line, "left_anti"), sets[0], share, of), "removed"))

    def left(kinds: Column) -> DataFrame:
        return met.where(kinds).select(*line, "sign").join(reduce(DataFrame.unionByName, gone), line, "left_anti")

    probes = settle(left(F.col("kind").isin(MARK, PROBE)), "probes")
    marks = settle(left(F.col("kind") == MARK).select("sign").distinct(), "marks")
    slim = [*line, "sign", "n", *PARITIES]
    open_ = open_.select(*slim)
    if not marks.isEmpty():
        # The rows of these signs, too.
        again = settle(met.where(F.col("kind") == STAND).select(*slim).join(marks, "sign", "left_semi").select(*slim), "open")
        wanted = settle(again.select(*line).distinct().join(sets[0].select(*line), line, "left_anti"), "wanted")
        sets.append(settle(_sets(source, wanted, unique, few=wanted.count() <= BROADCAST), "items"))
        discard(wanted)
        open_ = open_.unionByName(again)
    if not probes.isEmpty():
        gone.append(_settled_by_sets(open_, probes, source, reduce(DataFrame.unionByName, sets), rarity, share, of))
    discard(met, *sets, probes, marks)
    return reduce(DataFrame.unionByName, gone)


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text", share: int = 80, of: int = 100) -> DataFrame:
    """``documents`` with the later matches removed from ``text``, and n_lines and
    n_removed (both of lines with words) added."""
    own, unique = told_apart(documents, key, text)
    gone = removed_lines(own.select("key", "twin", "body").where("key IS NOT NULL"), share, of, unique)
    per_text = gone.groupBy("key", F.shiftright("line", 32).alias("twin_at")).agg(F.collect_list(F.col("line").bitwiseAND(F.lit(PLACE))).alias("gone"))
    rows = own.withColumn("twin_at", F.shiftright("twin", 32)).join(per_text.hint("shuffle_hash"), ["key", "twin_at"], "left").select("row", "gone")
    names = documents.columns
    changed = names.index(text)
    passed = [i for i, c in enumerate(names) if c not in ("n_lines", "n_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "row", 16_000_000):
                texts, lines, removed = [], [], []
                for had, gone in zip(batch.column("row").field(changed).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                    own_lines = (had or "").encode("utf-8", "surrogatepass").split(b"\n")
                    lines.append(sum(1 for x in own_lines if x.split(None, 1)))
                    removed.append(len(gone or ()))
                    if gone:
                        dead = set(gone)
                        had = b"\n".join(x for i, x in enumerate(own_lines) if i not in dead).decode("utf-8", "surrogatepass")
                    texts.append(had)
                columns = [batch.column("row").field(i) for i in passed]
                columns[passed.index(changed)] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*(names[i] for i in passed), "n_lines", "n_removed"])

    schema = StructType([documents.schema.fields[i] for i in passed]).add("n_lines", "long").add("n_removed", "long")
    return rows.mapInArrow(run, schema)
