"""SentencePiece encoding with the source span of every piece, and decoding.

Normalisation walks the text by the longest prefix that the model's compiled character
map has a rule for, and notes for each byte it writes which bytes of the source it
stands for. The library segments; the bytes that each piece covers in the normalised
text are projected through these notes to byte spans of the source. Null texts count
as empty, and empty texts have no pieces. Equal texts get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import small_batches

MARK = "▁".encode()


class CharacterMap:
    """The compiled character map of a model: a double array over prefixes, then their replacements."""

    def __init__(self, blob: bytes):
        self.rules = len(blob) > 4
        if self.rules:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that the bytes from `at` start with, and its replacement."""
        if not self.rules:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        length, place = found
        return length, self.strings[place : self.strings.index(b"\0", place)]


class Normalizer:
    """Normalises as the model says and keeps, for each byte made, the source bytes [start, end) it stands for."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not data:
            return b"", none, none
        lead_end = 0
        if self.map.rules or self.squeeze:
            text, start, end, lead_end = self._by_rule(data)
        else:
            text = np.frombuffer(data, np.uint8)
            start = np.arange(len(text))
            lead = np.flatnonzero((text & 0xC0) != 0x80)
            size = np.diff(np.append(lead, len(text)))
            start, end = np.repeat(lead, size), np.repeat(lead + size, size)
        if not len(text) and (self.squeeze or not self.prefix):
            return b"", none, none
        space = MARK if self.escape else b" "
        blank = text == 32
        width = np.where(blank, len(space), 1)
        out = np.repeat(text, width)
        if len(space) > 1:
            out[np.repeat(blank, width)] = np.tile(np.frombuffer(space, np.uint8), int(blank.sum()))
        start, end = np.repeat(start, width), np.repeat(end, width)
        if self.prefix:
            out = np.concatenate([np.frombuffer(space, np.uint8), out])
            start, end = (np.concatenate([np.full(len(space), lead_end), x]) for x in (start, end))
        return out.tobytes(), start, end

    def _by_rule(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Bytes, their source spans, and how many leading bytes of the source are blanks that squeezing drops."""
        out, start, end = bytearray(), [], []
        at = lead = 0
        heading = self.squeeze
        while at < len(data):
            rule = self.map.longest(data, at)
            if rule is None:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                rule = size, data[at : at + size]
            size, made = rule
            heading = heading and made == b" "
            lead += size if heading else 0
            if self.squeeze and (not out or out[-1] == 32):
                made = made.lstrip(b" ")
            out += made
            start += [at] * len(made)
            end += [at + size] * len(made)
            at += size
        while self.squeeze and out:  # a mark for blanks that stands at the end counts as one
            blank = 1 if out[-1] == 32 else len(MARK) if self.escape and out.endswith(MARK) else 0
            if not blank:
                break
            del out[-blank:], start[-blank:], end[-blank:]
        return np.frombuffer(bytes(out), np.uint8), np.array(start, np.int64), np.array(end, np.int64), lead


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.normalize = Normalizer(proto.normalizer_spec)
        # A byte piece covers one byte; -1 stands for an unknown piece, whose length hangs on the text.
        self.covers = np.array([{2: -1, 6: 1}.get(p.type, len(p.piece.encode())) for p in proto.pieces], np.int64)
        self.names = [str(i) for i in range(len(proto.pieces))]

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte span of each piece. Pieces made from the same source character share its span."""
        normal, start, end = self.normalize(text)
        covers = self.covers[ids]
        if (covers < 0).any():
            parts = self.processor.encode(text.decode(), return_type="proto").pieces
            return np.array([p.begin for p in parts], np.int64), np.array([p.end for p in parts], np.int64)
        stop = np.cumsum(covers)
        if (stop[-1] if len(stop) else 0) != len(normal):
            raise ValueError(f"pieces cover {stop[-1] if len(stop) else 0} of {len(normal)} normalised bytes")
        return start[stop - covers], end[stop - 1]


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


@T.tidy
def _rows(batches: Iterator[pa.RecordBatch], model: bytes, digests: bool) -> Iterator[pa.RecordBatch]:
    coder = _encoder(model)
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            texts = [x or "" for x in part.column("text").to_pylist()]
            every = coder.processor.encode(texts, num_threads=1)
            back = coder.processor.decode(every, num_threads=1)
            arrays = [np.array(x, np.int64) for x in every]
            raws = [x.encode() for x in texts]
            spans = [coder.spans(raw, ids) if len(ids) else (np.zeros(0, np.int64),) * 2 for raw, ids in zip(raws, arrays, strict=True)]
            if digests:
                # The spans tile a text if each starts where an earlier one ended, or within the same character.
                tiled = [not len(s) or bool(s[0] == 0 and e[-1] == len(raw) and (s[1:] <= e[:-1]).all() and (e[1:] >= e[:-1]).all()) for (s, e), raw in zip(spans, raws, strict=True)]
                columns = {
                    "n_tokens": pa.array([len(x) for x in every], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join([coder.names[i] for i in x]).encode()).hexdigest() for x in every]),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                    "n_bytes": pa.array([len(x) for x in raws], pa.int64()),
                    "spans_tile": pa.array(tiled, pa.bool_()),
                }
            else:
                columns = {
                    "ids": pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())),
                    "starts": pa.array([s for s, _ in spans], pa.list_(pa.int64())),
                    "ends": pa.array([e for _, e in spans], pa.list_(pa.int64())),
                    "decoded": pa.array(back, pa.string()),
                }
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns.values()], names=["id", *columns])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids, spans and decoded text of each row of `docs`, or with `digests` their counts and digests.

    The driver reads the model file, and sends its bytes to the executors.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_tile boolean" if digests else "ids array<int>, starts array<long>, ends array<long>, decoded string"
    return source.mapInArrow(lambda it: _rows(it, model.value, digests), "id long, " + schema).withColumnRenamed("id", id_col)
