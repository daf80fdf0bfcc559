"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` splits each text by the public pattern and merges every distinct piece once per
two bounded caches; pieces are independent of each other, so the ids are those of the whole text.
``decode`` reverses the byte table of the vocabulary. Characters split over several ids are
whole again because bytes, not strings, are joined; ``char_offsets`` says which characters
each id touches.

Defined results: a null text is an empty one (no ids); invalid UTF-8 is read with U+FFFD;
null ids decode to empty bytes, an id outside the vocabulary is an error. Other columns pass
through ``encode`` and ``decode`` untouched, except that a column with the output's name is
replaced. Repeated rows give repeated results.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused_prefix

#: Distinct pieces kept per task before the cache becomes the older one and starts anew; it bounds memory only.
CACHE_PIECES = 80_000
#: Longer pieces are encoded each time they occur.
CACHE_CHARS = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and the byte.

    Printable Latin-1 characters stand for themselves, the rest follow from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Vocabulary of one worker task: encodes texts to ids, ids to bytes and to offsets."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize  # knows no special tokens: their strings are ordinary text
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.characters = {byte: ord(c) for c, byte in byte_characters().items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._table = None

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a piece that none of the caches has is merged once for all of them."""
        found, cache, older = [self.pieces(t) for t in texts], self.cache, self.older
        new = set().union(*found).difference(cache)
        for piece in new:
            code = older.get(piece)
            if code is None:
                shown = piece.encode().decode("latin-1").translate(self.characters)
                code = array("i", [t.id for t in self.merge(shown)]).tobytes()
            cache[piece] = code
        coded = [np.frombuffer(b"".join(map(cache.__getitem__, f)), dtype="<i4") for f in found]
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del cache[piece]
        if len(cache) > CACHE_PIECES:  # pieces in use come back from the older cache
            self.cache, self.older = {}, cache
        return coded

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes one after the other, and where each begins."""
        if self._table is None:
            of = byte_characters()
            size = self.model.get_vocab_size(with_added_tokens=False)
            parts = []
            for k in range(size):
                token = self.model.id_to_token(k)
                # a special token's string is not written in byte characters
                parts.append(bytes(of[c] for c in token) if all(c in of for c in token) else token.encode())
            self._table = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return self._table

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        data, begin = self.table
        if ids.min() < 0 or ids.max() >= len(begin) - 1:
            raise ValueError("id outside the vocabulary")
        start = begin[ids]
        size = begin[ids + 1] - start
        end = np.cumsum(size, dtype=np.int64)
        wide = np.int32 if end[-1] < 1 << 31 else np.int64  # narrow places move half the memory
        at = np.repeat((start - (end - size)).astype(wide), size)
        at += np.arange(end[-1], dtype=wide)
        return data.take(at).tobytes()

    def char_offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character (exclusive) that each id touches."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        _, begin = self.table
        end = np.cumsum(begin[ids + 1] - begin[ids])
        whole = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((whole & 0xC0) != 0x80) - 1  # the character of each byte
        return char[np.concatenate(([0], end[:-1]))].astype(np.int32), (char[end - 1] + 1).astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32, copy=False)))


def _slices(b: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in one column; a single longer row is a part."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0))
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", offsets: bool = False, path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int); with ``offsets`` also ``<ids>_start`` and ``<ids>_end`` in characters."""
    new = [ids, f"{ids}_start", f"{ids}_end"] if offsets else [ids]
    path = path or vocabulary_path()
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(f"{unused_prefix(docs)}bytes")
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema] + [f"`{c}` array<int>" for c in new])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        codec = Codec(path)
        for whole in batches:
            for b in _slices(whole, whole.num_columns - 1):
                coded = codec.encode_all([t.decode("utf-8", "replace") for t in b.column(b.num_columns - 1).to_pylist()])
                made = [_lists(coded)]
                if offsets:
                    spans = [codec.char_offsets(c) for c in coded]
                    made += [_lists([s for s, _ in spans]), _lists([e for _, e in spans])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*kept, *new])

    return docs.select(*[F.col(f"`{c}`") for c in kept], raw).mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the bytes that ``ids`` stand for."""
    path = path or vocabulary_path()
    kept = [c for c in coded.columns if c != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(kept).schema] + [f"`{out}` binary"])
    at = kept.index(ids)

    def run(batches):
        codec = Codec(path)
        for b in batches:
            lists = b.column(at)
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            whole = [codec.decode(flat[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole, pa.binary())], names=[*kept, out])

    return coded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
