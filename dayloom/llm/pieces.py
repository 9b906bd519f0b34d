"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, byte for byte with its source: the longest prefix that the model's
compiled character map knows is replaced, everything else is copied, and white space is escaped.
Every normalised byte remembers the source bytes it stands for, so every piece can be projected to
a span of the original text. The normalised text is cut where no piece of the vocabulary can
reach across (proven from the vocabulary), and the segments go to the library's merge engine with
its own normaliser switched off. Equal segments are merged once.
"""

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.words import gives_back, values

SPACE = "▁"
#: A worker that remembers more segments than this empties its memory. Results don't depend on it.
REMEMBERED = 300_000

# Numbers of fields and piece types in a model file.
PIECES, NORMALIZER = 1, 3
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """(number, wire type, value, start, end) of each field of a serialised message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value, start, at


@dataclass
class Normalised:
    """A normalised text in UTF-8; `begin` and `end` are the source bytes each of its bytes stands for."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray


class Normaliser:
    """The normalisation of a model file: character map, dummy prefix, white space rules."""

    def __init__(self, spec: bytes):
        values = {number: value for number, _, value, _, _ in _fields(spec)}
        charsmap = values.get(2, b"")
        self.dummy_prefix = bool(values.get(3, 1))
        self.squeeze = bool(values.get(4, 1))
        self.escape = bool(values.get(5, 1))
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        self.starts: frozenset[int] = frozenset()
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.replacements = charsmap[4 + size :]
            self.starts = frozenset(b for b in range(1, 256) if self._child(self._base(0), b))

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int) -> int:
        """The node below for a byte, 0 if there is none."""
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else 0

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what replaces it."""
        found, base = None, self._base(0)
        for i in range(at, len(data)):
            node = self._child(base, data[i])
            if not node:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                found = i + 1 - at, self.units[base] & 0x7FFFFFFF
        if not found:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    def _mapped(self, data: bytes) -> Normalised:
        source = np.frombuffer(data, np.uint8)
        here = np.arange(len(data), dtype=np.uint32)
        if not self.starts:
            return Normalised(data, here, here + 1)
        out, begins, ends, done = [], [], [], 0
        for at in np.flatnonzero(np.isin(source, list(self.starts))):
            if at < done or not (hit := self.longest_prefix(data, int(at))):
                continue
            size, new = hit
            out += [data[done:at], new]
            begins += [here[done:at], np.full(len(new), at, np.uint32)]
            ends += [here[done:at] + 1, np.full(len(new), at + size, np.uint32)]
            done = int(at) + size
        return Normalised(
            b"".join([*out, data[done:]]),
            np.concatenate([*begins, here[done:]]).astype(np.uint32),
            np.concatenate([*ends, here[done:] + 1]).astype(np.uint32),
        )

    def __call__(self, text: str) -> Normalised:
        """Empty text stays empty. White space rules hold for the space character after mapping."""
        raw = self._mapped(text.encode())
        values = np.frombuffer(raw.data, np.uint8)
        begin, end = raw.begin, raw.end
        if self.squeeze:
            blank = values == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            if keep.any() and blank[np.flatnonzero(keep)[-1]]:
                keep[np.flatnonzero(keep)[-1]] = False
            values, begin, end = values[keep], begin[keep], end[keep]
        if self.dummy_prefix and len(values):
            values = np.concatenate([np.array([32], np.uint8), values])
            begin, end = np.concatenate([begin[:1], begin]), np.concatenate([begin[:1], end])
        if not self.escape:
            return Normalised(values.tobytes(), begin, end)
        size = np.where(values == 32, 3, 1)
        return Normalised(values.tobytes().replace(b" ", SPACE.encode()), np.repeat(begin, size), np.repeat(end, size))

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if self.starts or self.squeeze:
            return self(text).data.decode()
        shown = f" {text}" if self.dummy_prefix and text else text
        return shown.replace(" ", SPACE) if self.escape else shown


class PieceModel:
    """A model file with its normaliser, its vocabulary and a merge engine that leaves text as it is."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec, rest, self.pieces, self.kinds = b"", [], [], []
        for number, _, value, start, end in _fields(data):
            if number == NORMALIZER:
                spec = value
                continue
            rest.append(data[start:end])
            if number == PIECES:
                piece = {n: v for n, _, v, _, _ in _fields(value)}
                self.pieces.append(piece[1].decode())
                self.kinds.append(piece.get(3, NORMAL))
        self.normaliser = Normaliser(spec)
        # The same model whose normaliser copies: identity, no prefix, no squeezing, no escaping.
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain)
        self.lengths = np.array([1 if k == BYTE else 0 if k == CONTROL else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.segment = re.compile(self._segment_pattern())
        self.remembered: dict[str, bytes] = {}

    def _segment_pattern(self) -> str:
        """Segments that no piece can reach across.

        Merges only ever join neighbours into a piece of the vocabulary. If no piece has a
        character before an escaped space, and none has a line break next to anything, then no
        merge crosses those places, and encoding the segments one by one gives the same ids.
        """
        words = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in words) or USER in self.kinds:
            return "(?s).+"
        if any("\n" in p for p in words):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut where no merge can cross."""
        return self.segment.findall(self.normaliser.text(text))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        for cut in chunks(texts):
            segments = [self.segments(t) for t in cut]
            remember(self.remembered, segments, self._merge)
            for s in segments:
                yield b"".join(map(self.remembered.__getitem__, s))
            forget(self.remembered)

    def _merge(self, segments: list[str]) -> Iterator[bytes]:
        for ids in self.merger.encode(segments, num_threads=1):
            yield struct.pack(f"<{len(ids)}I", *ids)

    def spans(self, text: str, ids: bytes) -> np.ndarray:
        """A row (begin, end) of original bytes for every id; ids outside the text (begin, end, empty) get equal ones.

        A piece that is only the added leading space is empty at 0.
        """
        norm = self.normaliser(text)
        size = self.lengths[np.frombuffer(ids, "<u4")]
        stop = np.cumsum(size)
        if len(stop) and stop[-1] != len(norm.data):
            raise ValueError("the pieces don't add up to the normalised text")
        if not len(norm.data):
            return np.zeros((len(size), 2), np.uint32)
        last = len(norm.data) - 1
        begin = norm.begin[np.minimum(stop - size, last)]
        end = norm.end[np.maximum(stop - 1, 0)]
        return np.column_stack([begin, np.where(size > 0, end, begin)]).astype(np.uint32)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def chunks(texts: Iterable[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about `size` characters; a longer text is alone in its list."""
    cut, n = [], 0
    for t in texts:
        if cut and n + len(t) > size:
            yield cut
            cut, n = [], 0
        cut.append(t)
        n += len(t)
    if cut:
        yield cut


def remember(memory: dict, segments: list[list[str]], compute) -> None:
    """Add what `memory` lacks of the segments, each computed once."""
    if new := list(set().union(*segments).difference(memory)):
        memory.update(zip(new, compute(new), strict=True))


def forget(memory: dict, always: dict = MappingProxyType({})) -> None:
    """Empty a memory that has grown beyond its limit, but for what it holds from the start."""
    if len(memory) > len(always) + REMEMBERED:
        memory.clear()
        memory.update(always)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """The model of a worker; the file must be at the same path on every machine."""
    return PieceModel(path)


def _with_ends(model: PieceModel, ids: bytes) -> bytes:
    return struct.pack("<I", model.library.bos_id()) + ids + struct.pack("<I", model.library.eos_id())


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", ends: bool = True) -> DataFrame:
    """(id, ids array<int>, begins array<int>, ends array<int>): the ids of every text and the original bytes of each.

    One pass, without a shuffle. NULL counts as empty: with `ends` its ids are begin and end
    alone. Texts of any length are encoded whole. Other columns are ignored, whatever their names.
    """

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            ids, begins, stops = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t, raw in zip(texts, model.encode(texts), strict=True):
                span = model.spans(t, raw)
                if ends:
                    raw, size = _with_ends(model, raw), len(t.encode())
                    span = np.concatenate([[[0, 0]], span, [[size, size]]])
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                begins.append(span[:, 0].astype(np.int32))
                stops.append(span[:, 1].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array(begins, kind), pa.array(stops, kind)], names=[id, "ids", "begins", "ends"])

    rows = docs.select(F.col(id).alias(id), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): ids back to text; NULL or empty ids give the empty text."""

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            texts = [model.library.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "text"])

    rows = encoded.select(F.col(id).alias(id), F.col(ids).alias("__ids"))
    return rows.mapInArrow(run, f"`{id}` {encoded.schema[id].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of every text, begin and end ids included.

    The same encoding, spans and decoding as `encode` and `decode`, digested where they are made.
    """

    @gives_back
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            rows = []
            for texts in chunks(t or "" for t in values(batch.column(1))):
                for t, raw in zip(texts, model.encode(texts), strict=True):
                    spans = hashlib.sha256(model.spans(t, raw)).hexdigest()
                    raw = _with_ends(model, raw)
                    back = hashlib.sha256(model.decode(raw).encode()).hexdigest()
                    rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), back, spans))
            n, a, b, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c))],
                names=[id, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )
        # The worker lives on, for tasks that may have no use for what this one remembers.
        model.remembered.clear()

    rows = docs.select(F.col(id).alias(id), F.col(text).alias("__text"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
