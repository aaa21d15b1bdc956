"""Token ids in files of compressed byte or bit planes.

A file set is a folder with two tables. ``chunks`` holds one row per chunk of
whole documents: the ids are cut into blocks of a fixed number, every block is
transposed into planes (plane 0 holds the lowest byte or bit of each id), and
plane by plane the blocks are joined and compressed with zstandard.
``index`` holds a chunk's place (shard, number, first id, first and last key),
so a range of ids or keys is found without touching the planes. Both are
written by Spark's own committers: a lost executor leaves no partial file.

Documents lie in ascending order of their key over the shards; equal keys are
ordered by text. Null and empty texts have only the end id. Texts of any length
stay whole: a chunk ends with the document that reaches its size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.llm.byte_bpe import byte_characters
from itemloom.llm.shared import shuffle_width, slices

BLOCK = 4096
CHUNK = 1 << 18
#: Distinct words whose ids a worker remembers, about.
REMEMBERED = 400_000
#: Latin-1 letters and at most one full stop or comma: the tokenizer lowers the
#: letters, keeps them as one piece and takes the point as another.
SHAPE = "([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)"
PLAIN = re.compile(SHAPE).fullmatch

CHUNKS = "shard int, chunk int, start long, n_ids long, keys array<long>, lengths array<long>, planes array<binary>"


def to_planes(ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> list[bytes]:
    """Planes of uint32 ids, block after block; the last block is filled up with zeros."""
    full = np.zeros(-(-len(ids) // block) * block, "<u4")
    full[: len(ids)] = ids
    cells = full.view(np.uint8).reshape(-1, block, 4)
    if bits:
        cells = np.unpackbits(cells, axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.moveaxis(cells, 2, 0))
    if bits:
        planes = np.packbits(planes, axis=2)
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids back; 4 planes are bytes, 32 are bits."""
    cells = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        cells = np.unpackbits(cells.reshape(32, -1, block // 8), axis=2).reshape(32, -1)
        cells = np.packbits(cells.reshape(4, 8, -1), axis=1, bitorder="little").reshape(4, -1)
    return np.ascontiguousarray(cells.T).view("<u4").ravel()[:n_ids]


class _Words:
    """Ids of a text, word by word: the tokenizer drops white space and none of
    its steps reaches across it, so a batch's distinct words are encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.shown = dict(enumerate(byte_characters()))
        self.points = {p: self.ids(p).tobytes() for p in ("", ".", ",")}
        self.plain = self.shortcut_holds()
        #: A character with one id, which stands between new words when they are encoded together.
        self.mark, self.mark_id = next((c, ids[0]) for c in "™®©♥★§" if len(ids := self.ids(c)) == 1)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def shortcut_holds(self) -> bool:
        """Whether words may be encoded apart (an error if not) and ``PLAIN`` ones by
        their letters alone, tried on generated words of all these letters."""
        letters = [chr(c) for c in range(0x41, 0x100) if PLAIN(chr(c))]
        words = letters + ["".join(letters[(7 * i + j * j) % len(letters)] for j in range(2 + i % 9)) for i in range(300)]
        words = [w + point for w in words for point in ("", ".", ",")]
        mixed = [*words[:60], "a-b", "1.5", "™x", "日本", "it's"]
        if self.ids(" \t".join(mixed)).tobytes() != b"".join(self.ids(w).tobytes() for w in mixed):
            raise ValueError("the tokenizer's words depend on what stands beside them")
        return all(self.letters_ids(*PLAIN(w).groups()) == self.ids(w).tobytes() for w in words)

    def letters_ids(self, core: str, point: str) -> bytes:
        return self.cores_ids(pa.array([core.lower()]))[0] + self.points[point]

    def cores_ids(self, cores: pa.Array) -> list[bytes]:
        """Ids of lowered letters, each as a piece of its own."""
        shown = "\n".join(cores.to_pylist()).encode().decode("latin-1").translate(self.shown)
        tokenize, four = self.tokenizer.model.tokenize, self.four
        return [b"".join([four[t.id] for t in tokenize(core)]) for core in shown.split(self.shown[10])]

    def learn(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words."""
        found = np.full(len(words), None, object)
        # Letters are told, lowered and parted from their point by Arrow, all at once.
        plain = pc.match_substring_regex(words, f"^{SHAPE}$") if self.plain else pa.array(np.zeros(len(words), bool))
        easy = words.filter(plain)
        if len(easy):
            pieces = pc.utf8_lower(pc.utf8_rtrim(easy, ".,")).dictionary_encode()
            ids = np.array([*self.cores_ids(pieces.dictionary), None], object)[:-1][pieces.indices.to_numpy()]
            points = np.select([pc.ends_with(easy, p).to_numpy(zero_copy_only=False) for p in ".,"], [1, 2], 0)
            found[plain.to_numpy(zero_copy_only=False)] = ids + np.array([self.points[p] for p in ("", ".", ",")], object)[points]
        at = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        hard = [*zip(at.tolist(), words.take(pa.array(at)).to_pylist(), strict=True)]
        together = [(k, t) for k, t in hard if self.mark not in t]
        for i in range(0, len(together), 1000):
            some = together[i : i + 1000]
            ids = self.ids(f" {self.mark} ".join([t for _, t in some]))
            cut = np.flatnonzero(ids == self.mark_id)
            starts, ends, data = [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), 4 * len(ids)], ids.tobytes()
            for (k, _), low, high in zip(some, starts, ends, strict=True):
                found[k] = data[low:high]
        for k, text in hard:
            if self.mark in text:
                found[k] = self.ids(text).tobytes()
        return found.tolist()

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        if len(self.known) > REMEMBERED // 2:
            # What is used again comes back from the older half.
            self.older, self.known = self.known, {}
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        names = words.dictionary.cast(pa.binary()).to_pylist()
        found = [*map(self.known.get, names)]
        gaps = [k for k, ids in enumerate(found) if ids is None]
        old = [self.older.get(names[k]) for k in gaps]
        new = [k for k, ids in zip(gaps, old, strict=True) if ids is None]
        for k, ids in zip(gaps, old, strict=True):
            found[k] = ids
        for k, ids in zip(new, self.learn(words.dictionary.take(pa.array(new, pa.int64()))), strict=True):
            found[k] = ids
        self.known.update((names[k], found[k]) for k in gaps)
        # The ids of all words of the texts, gathered from those of the distinct ones.
        held, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(ids) // 4 for ids in found], np.int64)
        own = words.indices.to_numpy()
        counts = sizes[own]
        ends = np.cumsum(counts)
        data = held[np.repeat((np.cumsum(sizes) - sizes)[own] - (ends - counts), counts) + np.arange(counts.sum())].tobytes()
        cuts = 4 * np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [data[low:high] for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_words: dict[str, _Words] = {}


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", bits: bool = False, level: int = 3) -> None:
    """Encode every text, add ``end_id`` to each document and write the file set."""
    spark = df.sparkSession
    source = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ordered = source.repartitionByRange(shuffle_width(spark), "key", F.xxhash64("body")).sortWithinPartitions("key", F.xxhash64("body"), "body")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        if tokenizer not in _words:
            _words[tokenizer] = _Words(tokenizer)
        encode, shard = _words[tokenizer].encode, TaskContext.get().partitionId()
        chunk = start = size = 0
        keys, parts = [], []

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "keys": pa.array([keys], pa.list_(pa.int64())), "lengths": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                "planes": pa.array([[pack(p) for p in to_planes(ids, bits=bits)]], pa.list_(pa.binary())),
            })

        for batch in slices(batches, "body", 4_000_000):
            for k, ids in zip(batch.column("key").to_pylist(), encode(batch.column("body")), strict=True):
                keys.append(k)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
                if size >= CHUNK:
                    yield row()
                    chunk, start, size, keys, parts = chunk + 1, start + size, 0, [], []
        if keys:
            yield row()

    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(f"{folder}/chunks")
    placed = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").select("shard", "chunk", "start", "n_ids", F.array_min("keys").alias("first_key"), F.array_max("keys").alias("last_key"))
    # As many rows as shards, whatever the number of documents.
    shards = placed.groupBy("shard").agg(F.sum("n_ids").alias("ids"), F.min("first_key").alias("low"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    placed.join(F.broadcast(offsets), "shard").withColumn("first_id", F.col("offset") + F.col("start")).drop("offset", "start").write.parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids): per document its ids as little-endian uint32
    bytes, and the number of ids of all documents before it."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").drop("start", "n_ids")
    places = spark.read.parquet(f"{folder}/index").select("shard", "chunk", "first_id", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.slice(i, 1).to_pylist()[0]
                data = from_planes([unpack(p) for p in chunk["planes"]], chunk["n_ids"]).tobytes()
                lengths = np.array(chunk["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(chunk["keys"], pa.int64()), "start": pa.array(starts + chunk["first_id"]), "n_tokens": pa.array(lengths),
                    "ids": pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                })

    return chunks.join(places, ["shard", "chunk"]).mapInArrow(run, "key long, start long, n_tokens long, ids binary")
