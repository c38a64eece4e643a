"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The model is written directly in sentencepiece's format: each vocabulary entry becomes a
piece in which every byte stands as one visible character, scored by its negative rank, so
the merge with the lowest rank wins; the normaliser is the identity. Texts are split into
pre-tokens by the vocabulary's pattern, each is encoded separately, and ids are decoded by
mapping pieces back to bytes.

Texts are cut into units before that, at the start of white space that follows a visible
character; no pre-token crosses such a place. Distinct units are encoded once per slice.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import text as T
from riskloom.llm.tokens import UnitEncoder

RANK_FILE = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, in order of rank."""
    with open(path, "rb") as file:
        entries = [line.split() for line in file if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in entries)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    characters = byte_characters()
    pieces = [
        _block(1, _block(1, "".join(characters[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank)))
        for rank, token in enumerate(vocabulary)
    ]
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    # Trainer: model type BPE, vocabulary size, unknown id, and no sentence or padding pieces.
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(vocabulary))
    trainer += _number(41, -1) + _number(42, -1) + _number(43, -1)
    # Normaliser: no dummy prefix, no removal and no escaping of spaces.
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one model, as used inside a Python worker."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        characters = byte_characters()
        self.to_characters = {b: c for b, c in enumerate(characters)}
        byte_of = {c: b for b, c in enumerate(characters)}
        size = self.processor.get_piece_size() - 1
        pieces = [bytes(byte_of[c] for c in self.processor.id_to_piece(k)) for k in range(size)]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_heads = np.concatenate([[0], np.cumsum(self.piece_sizes)[:-1]])
        self.units = UnitEncoder(self._encode_units)

    def _encode_units(self, units: list[bytes]) -> list[np.ndarray]:
        split = [self.pattern.findall(u.decode("utf-8")) for u in units]
        tokens = list({t for s in split for t in s})
        mapped = [t.encode("utf-8").decode("latin-1").translate(self.to_characters) for t in tokens]
        ids = dict(zip(tokens, self.processor.encode(mapped, out_type=int, num_threads=1))) if tokens else {}
        return [np.array([i for t in s for i in ids[t]], np.uint32) for s in split]

    def encode(self, part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts in one array, and n + 1 bounds by text."""
        starts = unit_starts(part)
        ids, bounds = self.units(part.data, starts, np.append(starts[1:], len(part.data)) if len(starts) else starts)
        return ids, bounds[np.searchsorted(starts, part.offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids' pieces in one array, and n + 1 bounds by text."""
        sizes = self.piece_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.piece_bytes[T.ragged(self.piece_heads[ids], sizes)], ends[bounds]


def unit_starts(part: T.Slice) -> np.ndarray:
    """Starts of texts, and of ASCII white space after a character that is surely not a space.

    After bytes that may end a wider Unicode space no cut is made; units then just get longer.
    """
    data = part.data
    if not len(data):
        return np.empty(0, np.int64)
    space = np.isin(data, np.frombuffer(b" \t\n\r", np.uint8))
    before = np.concatenate([[np.uint8(0)], data[:-1]])
    second = np.concatenate([np.zeros(2, np.uint8), data[:-2]])[: len(data)]
    third = np.concatenate([np.zeros(3, np.uint8), data[:-3]])[: len(data)]
    doubtful = (before < 0x21) | (before == 0x7F) | ((before >= 0x80) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))))
    cut = space & ~doubtful
    cut[part.offsets[:-1][part.lengths > 0]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def _worker_coder(model: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(model, pattern)


def round_trip(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False
) -> DataFrame:
    """doc_id, number of tokens, SHA-256 of ids and of decoded bytes; ids and text too if asked for."""
    # The model's size follows the vocabulary, never the data.
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(path or public_tokenizers.path(RANK_FILE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_coder(model.value, pattern)
        for batch in batches:
            for part in T.slices(batch.column("text")):
                ids, bounds = coder.encode(part)
                data, ends = coder.decode(ids, bounds)
                raw, plain, b, e = ids.astype("<u4").tobytes(), data.tobytes(), bounds.tolist(), ends.tolist()
                columns = {
                    "doc_id": batch.column("doc_id").slice(part.first, len(part)),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(b, b[1:])], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(plain[x:y]).hexdigest() for x, y in zip(e, e[1:])], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[x:y].tolist() for x, y in zip(b, b[1:])], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([plain[x:y].decode("utf-8") for x, y in zip(e, e[1:])], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
