"""SentencePiece encoding with byte spans of the original text, and decoding.

A text is normalised by the model's compiled character map: at each position the
longest prefix that the map knows is replaced, else one character is taken as it
is. For every byte of the result the byte of the source that it came from is
recorded, so that each piece of the segmentation projects to a span of the
original text.

That result is what is segmented. The merges are the library's, by a copy of the
model whose own normaliser does no more than put the leading blank before it; the
projection needs only the width of each piece in the normalised text.
"""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

META = "▁"

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("begins", T.ArrayType(T.IntegerType(), False)),
    T.StructField("ends", T.ArrayType(T.IntegerType(), False)),
    T.StructField("decoded", T.StringType()),
])


def fields(message: bytes):
    """(number, value) of a protobuf message's fields, without a schema."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def with_normaliser(model: bytes, spec: bytes) -> bytes:
    """A model file's bytes with another normaliser. All its top fields are messages."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    parts = [(number, value) for number, value in fields(model) if number != 3] + [(3, spec)]
    return b"".join(varint(number << 3 | 2) + varint(len(value)) + value for number, value in parts)


#: A normaliser without a map that takes no blank out, turns blanks into ``META``, and by its last byte puts one in front.
AS_IT_IS = b"\x0a\x08identity\x20\x00\x28\x01\x18"


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 prefixes, then the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Codec:
    """A model: normalise, encode with spans, decode."""

    def __init__(self, path: str):
        self.read(Path(path).read_bytes())

    def read(self, raw: bytes) -> None:
        pieces, normaliser = [], {}
        for number, value in fields(raw):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 3:
                normaliser = dict(fields(value))
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.squeeze = (bool(normaliser.get(n, 1)) for n in (3, 4))
        texts = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.user = sorted((t.encode() for t, k in zip(texts, kinds, strict=True) if k == 4), key=len, reverse=True)
        self.widths = [1 if k == 6 else len(t.replace(META, " ").encode()) for t, k in zip(texts, kinds, strict=True)]
        self.widths = np.array(self.widths, np.int32)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=with_normaliser(raw, AS_IT_IS + bytes([self.prefix])))
        self.unknown = self.library.unk_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The text that is segmented, white space as blanks, and for each of its
        bytes, and its end, the byte of ``text`` that it stems from.

        No array where only the leading blank is new: then byte i stems from i - 1.
        """
        if not self.map.units and not self.squeeze and self.prefix and META not in text:
            return (" " + text if text else ""), None
        source, out, starts, at = text.encode(), bytearray(), [], 0
        if self.squeeze:  # leading white space goes
            while at < len(source):
                size, piece = self._step(source, at)
                if piece.strip(b" "):
                    break
                at += size
        if self.prefix and at < len(source):
            out += b" "
            starts.append(at)
        blank = self.squeeze
        while at < len(source):
            size, piece = self._step(source, at)
            if blank:
                piece = piece.lstrip(b" ")
            out += piece
            starts += [at] * len(piece)
            at += size
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(b" "):
                out.pop()
                at = starts.pop()
        return out.decode(), np.array([*starts, at], dtype=np.int32)

    def _step(self, source: bytes, at: int) -> tuple[int, bytes]:
        for u in self.user:
            if source.startswith(u, at):
                return len(u), u
        if (found := self.map.longest(source, at)) is None:
            lead = source[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            found = size, source[at : at + size]
        return found[0], found[1].replace(META.encode(), b" ")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, and begin and end of each piece in its bytes."""
        normal = [self.normalise(t) for t in texts]
        coded = self.library.encode([self._without_lead(n) for n, _ in normal], num_threads=1)
        return [self._spans(n, starts, np.array(ids, np.int32)) for (n, starts), ids in zip(normal, coded, strict=True)]

    def _without_lead(self, normal: str) -> str:
        return normal[1:] if self.prefix else normal

    def _spans(self, normal: str, starts: np.ndarray | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        widths = self.widths[ids]
        if (ids == self.unknown).any():  # as wide as what they stand for
            pieces = self.library.encode(self._without_lead(normal), return_type="proto").pieces
            widths = np.array([len(p.piece.replace(META, " ").encode()) if p.id == self.unknown else w for p, w in zip(pieces, widths, strict=True)], np.int32)
        edges = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(widths, out=edges[1:])
        edges = np.maximum(edges - 1, 0) if starts is None else starts[edges]
        return ids, edges[:-1], edges[1:]

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = [self.library.decode(x) if x else "" for x in ids]
        return texts if self.prefix or not self.squeeze else [t.removeprefix(" ") for t in texts]


def encode_frame(df: DataFrame, model: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append ids, begins, ends (bytes of the text, one span for each id) and decoded.

    ``model``: path of a model file that every executor has. A null text counts as
    empty; empty gives empty arrays and "". Texts of any length are encoded whole;
    repeated rows stay; an empty table gives no rows. Columns of the same names are replaced.
    """

    def setup():
        codec = Codec(model)

        def fn(texts: list) -> list:
            coded = codec.encode([t or "" for t in texts])
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum([len(c[0]) for c in coded], out=offsets[1:])
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([c[k] for c in coded]))) for k in range(3)]
            return [*lists, codec.decode([c[0].tolist() for c in coded])]

        return fn

    return map_texts(df, text, ENCODED, setup, keep_text)
