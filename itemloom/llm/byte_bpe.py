"""Byte-level BPE through a sentencepiece model made straight from a rank file.

The rank file (one base64 piece and its rank per line) becomes a sentencepiece
BPE model without training: each piece is written with its bytes mapped to
printable characters, scored by the negative rank, under an identity
normaliser. Merging the best-scored neighbours is then merging by lowest rank.
Texts are split by the given pattern, each piece is encoded on its own, and ids
are decoded by looking up their bytes.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.shared import slices

#: Distinct pre-tokens whose ids a worker remembers before it starts afresh.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1
    prints it, else the next unused one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """ModelProto with one BPE piece per entry (its index is its rank and id)
    and the unknown piece, which mapped bytes never reach, after them."""
    shown = dict(enumerate(byte_characters()))
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = piece.decode("latin-1").translate(shown).encode()
        out += _field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _flag(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, len(pieces) + 1) + _flag(40, len(pieces))
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class _Codec:
    """One worker's tokenizer with its memory of pre-tokens."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.whole = pieces, {p: i for i, p in enumerate(pieces)}
        self.shown = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        rest = []
        for word in words:
            rank = self.whole.get(word.encode())
            if rank is None:
                rest.append(word)
            else:
                self.known[word] = struct.pack("<i", rank)
        mapped = [w.encode().decode("latin-1").translate(self.shown) for w in rest]
        for word, ids in zip(rest, self.processor.encode(mapped, num_threads=1) if mapped else (), strict=True):
            self.known[word] = np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        known = self.known
        if new := {w for w in words if w not in known}:
            self.learn(new)
            if len(self.known) < len(known):  # it started afresh: the others of this text are gone
                self.learn({*words} - self.known.keys())
            known = self.known
        return np.frombuffer(b"".join([known[w] for w in words]), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[str, _Codec] = {}


def _codec(shared) -> _Codec:
    name, *parts = shared.value
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = _Codec(*parts)
    return _codecs[name]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, "<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32, copy=False)))


@dataclass
class ByteBpe:
    """Tokenizer over DataFrames: ``pieces`` by rank and the splitting pattern.

    A null text counts as empty and gives no ids; repeated keys keep a row
    each; texts of any length are encoded whole.
    """

    pieces: list[bytes]
    pattern: str

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        return cls(read_ranks(path), pattern)

    def _shared(self, df: DataFrame):
        return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sentencepiece_model(self.pieces), self.pieces, self.pattern))

    def encode(self, df: DataFrame, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
        """(key, token_ids array<int>), and with ``decoded`` also the bytes that
        the ids decode to, read back from the ids in the same pass."""
        source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        shared = self._shared(df)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared)
            for batch in slices(batches, "body"):
                ids = [codec.encode(t) for t in batch.column("body").to_pylist()]
                columns = {"key": batch.column("key"), "token_ids": _lists(ids)}
                if decoded:
                    columns["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

        fields = [T.StructField("key", source.schema["key"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
        schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * decoded)
        return source.mapInArrow(run, schema).withColumnRenamed("key", key)

    def decode(self, df: DataFrame, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
        """(key, decoded binary); null ids give no bytes."""
        source = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
        shared = self._shared(df)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared)
            for batch in slices(batches, "ids"):
                out = [codec.decode(np.array(x or [], "<i4")) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "decoded": pa.array(out, pa.binary())})

        schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("decoded", T.BinaryType())])
        return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and the digests of the decimal ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
