"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and types, the normaliser, the marker of white space and
byte fallback.  From these a fast tokenizer is rebuilt (unigram, or BPE whose merges follow from the piece scores),
batches are encoded by several threads, and the tasks compare ids and decoded text of every text with the reference library.
Where no piece goes on beyond a word, a word is encoded once and remembered; the reference encodes whole texts all the same.

Rows: a null or empty text has no ids and decodes to an empty text; strings such as ``<s>`` in a text are ordinary
text; repeated rows give equal ids; an empty table gives an empty result; further columns are kept by :func:`encoded`.
A long text is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.shared import ship, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
PARITY_SHARE = 1  # one text in so many is encoded by the reference library as well: every text
BATCH_BYTES = 1 << 18
KNOWN_CHARACTERS = 4 << 20  # of remembered words
MARK = "▁"
# Numbers of the model file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    """What the model file holds."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protobuf message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        else:
            raise ValueError("not a piece model")
        yield number, value


def parse(data: bytes) -> PieceModel:
    """The model of a serialised protobuf."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode("utf-8"), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            normaliser = dict(_fields(value))
            model.charsmap = normaliser.get(2, b"")
            model.dummy_prefix = bool(normaliser.get(3, 1))
            model.remove_extra_spaces = bool(normaliser.get(4, 1))
            model.escape_spaces = bool(normaliser.get(5, 1))
    model.unknown_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs that join to a piece, the best scored piece first, and of one piece the pair with the earlier left side."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER):
            found += [(-score, ids[piece], ids[piece[:k]], piece[:k], piece[k:])
                      for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel):
    """The tokenizer of the tokenizers library for a parsed model."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        # Only normal pieces can come out of merges; names of the others are changed, so that no text equals them.
        names = {(p if kind in (NORMAL, USER, BYTE) else f"{p}"): i for i, (p, _, kind) in enumerate(model.pieces)}
        unknown = next(n for n, i in names.items() if i == model.unknown_id)
        core = models.BPE(vocab=names, merges=_merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        lowest = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        scored = [(p, s) if kind in (NORMAL, USER) else (p if kind == BYTE else f"{p}", lowest)
                  for p, s, kind in model.pieces]
        core = models.Unigram(scored, model.unknown_id, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has no counterpart")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    return tokenizer


def _apart(model: PieceModel) -> bool:
    """No piece goes on after a word into the next marker, so words can be encoded (and remembered) apart."""
    crossing = any(a != MARK and b == MARK for p, _, kind in model.pieces if kind in (NORMAL, USER) for a, b in zip(p, p[1:]))
    return model.escape_spaces and not crossing


def _word_pattern(model: PieceModel) -> re.Pattern | None:
    """Words with their markers in front; runs of letters and digits, and of others, if no piece or unknown goes on beyond one."""
    if not _apart(model) or model.charsmap or model.remove_extra_spaces:
        return None
    pairs = {(a, b) for p, _, kind in model.pieces if kind in (NORMAL, USER) for a, b in zip(p, p[1:]) if a != MARK}
    joins = {c for a, b in pairs if a.isalnum() != b.isalnum() for c in (a, b) if c.isalnum()}
    inner = lambda c: c.isalnum() and c not in joins
    others = "_" + "".join(sorted(joins))
    if not model.byte_fallback or any(inner(a) != inner(b) for a, b in pairs):
        return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    letters, rest = f"[^\\W{others}]+", f"(?:[^\\w{MARK}]|[{others}])+"
    return re.compile(f"{MARK}+(?:{letters}|{rest})?|{letters}|{rest}")


class _Known(dict):
    """Ids of words, packed; a word not met before is encoded."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.size = tokenize, 0

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("i", [token.id for token in self.tokenize(word)]).tobytes()
        self.size += len(word)
        return found


class Codec:
    """Encoding and decoding of batches with one model."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.pattern, self.known = _word_pattern(self.model), _Known(self.tokenizer.model.tokenize)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
                      else b" \xe2\x81\x87 " if kind == UNKNOWN
                      else (p.replace(MARK, " ") if self.model.escape_spaces else p).encode()
                      for p, _, kind in self.model.pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text, without special ids."""
        if not self.pattern:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        prefix = MARK if self.model.dummy_prefix else ""
        if self.known.size > KNOWN_CHARACTERS:
            self.known = _Known(self.tokenizer.model.tokenize)
        ids = self.known.__getitem__
        split = (self.pattern.findall(prefix + text.replace(" ", MARK)) if text else () for text in texts)
        return [np.frombuffer(b"".join(map(ids, words)), np.intc).tolist() for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of the pieces side by side, without the space put in front."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(data: bytes, threads: int = THREADS) -> Codec:
    """One codec a process and model."""
    return Codec(data, threads)


def read_model(path: str = MODEL) -> bytes:
    """The bytes of a model file, read once by the driver and sent along; the bound is the size of one vocabulary."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def reference(data: bytes):
    """One processor of the reference library a process and model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def parity(data: bytes, texts: list[str]) -> list[str]:
    """The texts whose ids or decoded text differ from those of the reference library."""
    own = codec(data)
    ids = own.encode(texts)
    return [t for t, same in zip(texts, _agrees(data, texts, ids, list(map(own.decode, ids)))) if not same]


def _agrees(data: bytes, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
    other = reference(data)
    wanted = other.encode(texts, num_threads=1)
    return [a == b and text == other.decode(b) for a, b, text in zip(ids, wanted, decoded)]


def _pieces_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + BATCH_BYTES)))
        yield first, min(last, len(texts))
        first = last


def _encoder(data: bytes, threads: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(data, threads)
        for batch in batches:
            texts = batch.column(0)
            for first, last in _pieces_of(texts):
                own = texts.slice(first, last - first).to_pylist()
                ids = coder.encode(own)
                sizes = np.array([len(i) for i in ids], np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                fallback = np.add.reduceat(np.append(coder.is_byte[flat], False).astype(np.int64), np.minimum(offsets[:-1], len(flat)))
                fallback[sizes == 0] = 0
                decoded = list(map(coder.decode, ids))
                same = [a == b for a, b in zip(decoded, own)]
                agrees = _agrees(data, own, ids, decoded)
                columns = [c.slice(first, last - first) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sizes), pa.array(fallback), pa.array(same), pa.array(agrees, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*batch.schema.names[1:], "_n_tokens", "_n_bytes", "_round_trip", "_parity", "_ids"])
    return encode


def encoded(docs: DataFrame, model: bytes, threads: int = THREADS, text: str = "text") -> DataFrame:
    """``docs`` with ``_n_tokens``, ``_n_bytes`` (of byte fallback), ``_round_trip`` (decoded text equals), ``_parity`` and ``_ids``.

    ``_parity`` says whether the reference library agrees.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    added = [T.StructField("_n_tokens", T.LongType()), T.StructField("_n_bytes", T.LongType()),
             T.StructField("_round_trip", T.BooleanType()), T.StructField("_parity", T.BooleanType()), T.StructField("_ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.select(text_of(text).alias("_text"), *docs.columns).mapInArrow(_encoder(model, threads), schema)


def decoded(rows: DataFrame, model: bytes, ids: str = "_ids", into: str = "_decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(model)
        for batch in batches:
            yield batch.map(lambda i: "" if i is None else coder.decode(list(i)))

    return rows.withColumn(into, decode(F.col(ids)))
