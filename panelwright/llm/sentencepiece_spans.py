"""SentencePiece BPE encoding that keeps, for every piece, the bytes of the source it stands for.

A text is normalised by longest-prefix replacement through the model's compiled character map; each
normalised byte remembers the source byte it came from. Where the vocabulary cannot merge across a
boundary (before a run of spaces, at a newline) the normalised text is cut into chunks, each distinct
chunk is encoded once by the library, and the byte lengths of its pieces are summed up and projected
through the alignment to source spans. ``decode`` is the library's.

Defined results: a null or empty text has the begin and end ids alone and decodes to an empty text.
Null and repeated ids are rows like others; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import PieceCache, Pieces, batch_of, text_rows, text_slices

MARK = "▁"


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 keys, then the replacements.

    Layout of the blob: trie size in bytes (u32), trie units (u32 each), replacements ended by zeros.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.values = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.values = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""

        def base(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        found, place = None, base(self.units[0])
        for i in range(at, len(raw)):
            place ^= raw[i]
            if place >= len(self.units):
                break
            unit = self.units[place]
            if unit & 0x800000FF != raw[i]:
                break
            place ^= base(unit)
            if unit >> 8 & 1:
                start = self.units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.values[start : self.values.index(b"\0", start)]
        return found

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text after replacement, and the source byte of each of its bytes (and of its end)."""
        raw = text.encode()
        if not self.units:
            return text, np.arange(len(raw) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            found = self.longest(raw, at)
            if found:
                length, value = found
            else:
                first = raw[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                value = raw[at : at + length]
            out += value
            source += [at] * len(value)
            at += length
        return out.decode(), np.array([*source, at])


class SpanEncoder:
    """Ids and source spans of whole texts under one BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(self.library.serialized_model_proto())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        pieces = [p.piece for p in model.pieces]
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        if trainer.model_type != 2 or not trainer.byte_fallback or inner or any("\n" in p for p in pieces):
            raise ValueError("Only BPE models with byte fallback and no piece across words are supported")
        if spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("Only models that keep white space, escaped, after a dummy prefix are supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        spec.precompiled_charsmap, spec.add_dummy_prefix = b"", False
        self.plain = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.cache = PieceCache(self._encode, np.uint32)

    def _encode(self, keys: list[str]) -> list[bytes]:
        literal = [k[2:] if k[:2] == "\n\n" else k if k[:1] == "\n" else MARK + k for k in keys]
        return [array("I", ids).tobytes() for ids in self.plain.encode(literal, num_threads=1)]

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        """A key means a space and the key; with two leading newlines the rest literally, with one itself."""
        import pyarrow.compute as pc

        spaces = pc.replace_substring(texts, MARK, " ")
        cut = pc.split_pattern(pc.replace_substring(spaces, "\n", " \n"), " ")
        runs = pc.match_substring_regex(spaces, "^ |  ")
        empty = pc.equal(texts, "")
        if not runs.true_count and not empty.true_count:
            return cut
        rows = cut.to_pylist()
        for i, text in enumerate(spaces.to_pylist()):
            if not text:
                rows[i] = []
            elif text[0] == " " or "  " in text:
                rows[i] = self._runs(f" {text}")
        return pa.array(rows, pa.list_(pa.string()))

    @staticmethod
    def _runs(text: str) -> list[str]:
        import re

        return ["\n\n" + x.replace(" ", MARK) for x in re.findall(r"\n| +[^ \n]*|[^ \n]+", text)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids and the first and last (exclusive) source byte of each piece."""
        sources = texts.to_pylist()
        normal = [self.map.normalise(t) for t in sources] if self.map.units else None
        ready = pa.array([n for n, _ in normal], pa.string()) if normal else texts
        ids, bounds = self.cache.gather(Pieces(self._chunks(ready)))
        lengths = self.lengths[ids]
        for i, text in enumerate(sources):
            own = slice(bounds[i], bounds[i + 1])
            raw = np.frombuffer((normal[i][0] if normal else text).encode(), np.uint8)
            widths = np.where(raw == 32, 3, 1)
            back = np.append(np.repeat(np.arange(len(raw)), widths), len(raw))
            ends = np.cumsum(lengths[own]) - len(MARK.encode())
            begins = np.maximum(ends - lengths[own], 0)
            first, last = back[begins], back[np.maximum(ends, 0)]
            if normal:
                first, last = normal[i][1][first], normal[i][1][last]
            yield ids[own], first, last

    def with_ends(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate(([self.library.bos_id()], ids, [self.library.eos_id()])).astype("<u4")


_ENCODERS: dict[str, SpanEncoder] = {}


def span_encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian u32, with begin and end), ``decoded``, ``covered_bytes``
    (source bytes under the pieces) and, if asked for, ``span_begin`` and ``span_end`` (binary,
    little-endian u32; one for each id between begin and end)."""
    fields = [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("covered_bytes", pa.int64())]
    fields += [("span_begin", pa.binary()), ("span_end", pa.binary())] if spans else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = span_encoder(model)
        for batch in batches:
            doc_ids, at = batch.column("doc_id"), 0
            for texts in text_slices(batch.column("text")):
                rows: dict[str, list] = {n: [] for n in schema.names[1:]}
                for ids, first, last in tool.encode(texts):
                    whole = tool.with_ends(ids)
                    rows["ids"].append(whole.tobytes())
                    rows["decoded"].append(tool.library.decode(whole.tolist()))
                    rows["covered_bytes"].append(int((last - first).sum()))
                    if spans:
                        rows["span_begin"].append(first.astype("<u4").tobytes())
                        rows["span_end"].append(last.astype("<u4").tobytes())
                yield batch_of(schema, {"doc_id": doc_ids.slice(at, len(texts)), **rows})
                at += len(texts)

    ddl = "doc_id long, ids binary, decoded string, covered_bytes long" + ", span_begin binary, span_end binary" * spans
    return text_rows(docs, id_col, text_col).mapInArrow(run, ddl)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and sha256 digests of what ``encode_documents`` returns."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "covered_bytes",
    )
