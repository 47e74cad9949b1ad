"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Every byte is mapped to one printable character; a vocabulary entry becomes a NORMAL piece spelled in these
characters with score -rank, so that sentencepiece's best-score-first merges are the lowest-rank-first merges of
byte-level BPE. Normalisation is the identity, nothing is escaped and no dummy prefix is added. The one unknown
piece that the format asks for comes after the last rank and is never produced, as all 256 bytes are pieces.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The rank file as a sentencepiece ModelProto of type BPE; piece i is rank i."""
    alphabet = byte_alphabet()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every single byte")
    pieces = [_field(1, _field(1, "".join(alphabet[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(i)) + _field(3, 1)) for i, t in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder over one rank file. Keeps what it knows of up to `cache` pre-tokens."""

    def __init__(self, path: str, pattern: str, cache: int = 400_000):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialize_model(self.ranks))
        alphabet = byte_alphabet()
        self.to_chars = {b: c for b, c in enumerate(alphabet)}
        back = {c: b for b, c in enumerate(alphabet)}
        self.piece_bytes = [bytes(back[c] for c in self.model.IdToPiece(i)) for i in range(len(self.ranks))]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def learn(self, pretokens: set[str]) -> None:
        if len(self.known) > self.cache:
            self.known = {}
        missing = [p for p in pretokens if p not in self.known]
        hard = []
        for p in missing:
            rank = self.ranks.get(p.encode())
            if rank is None:
                hard.append(p)
            else:
                self.known[p] = (rank,)
        coded = self.model.EncodeAsIds([p.encode().decode("latin-1").translate(self.to_chars) for p in hard], num_threads=1) if hard else []
        for p, ids in zip(hard, coded, strict=True):
            self.known[p] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        pretokens = self.split(text)
        self.learn(set(pretokens))
        known = self.known
        return [i for p in pretokens for i in known[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, round_trip of every text.

    path and pattern are the vocabulary file and the pre-token pattern; the file has to be readable on every
    worker. A null or empty text has no tokens: its digests are those of empty input. Rows map one to one; repeated
    rows are kept; other columns are left aside. Works a document at a time, so a long text is held once.
    """
    coder: list[ByteBpe] = []

    def run(texts: list[str | None]) -> list[tuple]:
        if not coder:
            coder.append(ByteBpe(path, pattern))
        bpe, rows = coder[0], []
        for text in texts:
            text = text or ""
            ids = bpe.encode(text)
            decoded = bpe.decode(ids)
            rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded), decoded == text.encode()))
        return rows

    return per_text(docs.select("doc_id", "text"), "text", run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
