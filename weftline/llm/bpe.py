"""Byte-level BPE through a sentencepiece model that is serialised here from a rank file.

Every token of the vocabulary becomes one BPE piece: its bytes written as characters (byte b as U+0100+b, none of
which sentencepiece treats as space), scored by minus its rank, under the identity normaliser. sentencepiece then
merges the pair of the highest score, leftmost first, which is the pair of the lowest rank.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table, tidy

#: Distinct chunks whose ids a task remembers; beyond it the memory starts anew.
MEMORY = 200_000
#: Texts encoded at once.
SLICE = 512
FIRST = 0x100


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        pairs = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip())]
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_piece(token: bytes) -> str:
    return "".join([chr(FIRST + b) for b in token])


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece ModelProto: id i is the token of rank i; the unknown piece comes after them, as any byte has a token it is never used."""
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_field(1, _field(1, as_piece(t).encode()) + score(-float(i))) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(40, len(tokens))  # model_type BPE, unk_id
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, all spaces kept as they are
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes lists of texts to little-endian unsigned 32-bit ids, and ids to bytes."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import sentencepiece

        self.tokens, self.whole = tokens, {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.memory: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Remembers the ids of chunks; a pre-token that is a token itself isn't merged, the others go to the model at once."""
        parts = [[x.encode() for x in self.split(c)] for c in chunks]
        whole = self.whole
        rest = list({x for p in parts for x in p if x not in whole})
        merged = dict(zip(rest, self.model.encode([as_piece(x) for x in rest], num_threads=1), strict=True)) if rest else {}
        for c, p in zip(chunks, parts, strict=True):
            self.memory[c] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [i for x in p for i in ((whole[x],) if x in whole else merged[x])]) else b""

    def chunks(self, text: str) -> list[str]:
        """A pre-token begins at each space that stands between characters which aren't white space, so text is cut there."""
        first, *rest = text.split(" ")
        out = [first, *[" " + c for c in rest]]
        if "  " not in text and not _ODD.search(text):
            return out
        joined, held = [], [out[0]]
        for c in out[1:]:
            if len(c) < 2 or c[1].isspace() or not held[-1] or held[-1][-1].isspace():
                held.append(c)
            else:
                joined.append("".join(held))
                held = [c]
        return [*joined, "".join(held)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        if new := {c for x in cut for c in x if c not in memory}:
            self._learn(list(new))
        out = [b"".join([memory[c] for c in x]) for x in cut]
        for c in new:
            if len(c) > 64:
                del memory[c]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ODD = regex.compile(r"\s | \s")
_codecs: dict[int, Codec] = {}


def encode_documents(documents: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array) if asked for.

    A null text counts as empty: no tokens, the digests of nothing. Rows aren't compared with each other: repeated
    ones give repeated rows, in no order; an empty table gives none. Whole texts are encoded however long. The rank
    file is read by the driver and sent to the executors, 1 to 2 MB whatever the input.
    """
    spark = documents.sparkSession
    tokens = read_ranks(path)
    sent = spark.sparkContext.broadcast((tokens, serialise(tokens), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((len(sent.value[1]), sent.value[1][-999:], sent.value[2]))
        codec = _codecs.get(key) or _codecs.setdefault(key, Codec(*sent.value))
        for batch in batches:
            n, ids_at, text_at, ids = [], [], [], []
            texts = batch.column(1)
            for got in (y for i in range(0, len(texts), SLICE) for y in codec.encode([x or "" for x in texts.slice(i, SLICE).to_pylist()])):
                n.append(len(got) // 4)
                ids_at.append(hashlib.sha256(got).hexdigest())
                text_at.append(hashlib.sha256(codec.decode(got)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(got, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_at, pa.string()), pa.array(text_at, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        codec.memory.clear()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def byte_bpe(documents: DataFrame, with_ids: bool = False) -> DataFrame:
    """encode_documents with the public multilingual byte-level vocabulary."""
    import public_tokenizers

    return encode_documents(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))
