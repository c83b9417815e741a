"""SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

A text is normalised by the model's compiled character map, always taking the longest mapped prefix, while the source
byte of every normalised byte is recorded. The library then gives the ids; a piece's length in normalised bytes is a
property of its id, so running sums of lengths are the pieces' places in the normalised text, and the record projects
them to spans of original bytes.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from weftline.llm.common import pieces, slim

SPACE = "▁"
#: Encodings of words that a Python worker remembers from one batch to the next, at most.
REMEMBERED = 400_000
BPE = 2
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6


class CharacterMap:
    """The compiled character map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken and their replacement, for the longest mapped string that starts here."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        place = _offset(units[0])
        for length in range(1, len(source) - at + 1):
            byte = source[at + length - 1]
            node = place ^ byte
            # A unit holds the byte that leads to it; the top bit marks a value.
            if units[node] & 0x800000FF != byte:
                break
            place = node ^ _offset(units[node])
            if units[node] >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = (length, self.replacements[begin : self.replacements.index(b"\0", begin)])
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class Normaliser:
    """Normalised bytes, and for each the first original byte that it comes from (one more at the end)."""

    def __init__(self, spec: model_pb2.NormalizerSpec, blank_behind: bool) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.blank = SPACE.encode() if self.escape else b" "
        self.behind = blank_behind

    def plain(self) -> bool:
        """Whether only spaces change: no character map, no squeezing."""
        return not self.map.units and not self.squeeze and self.escape and self.prefix and not self.behind

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.plain():
            return self._spaces_only(source)
        out, origin, at = bytearray(), [], 0
        steps = []
        while at < len(source):
            mapped = self.map.longest(source, at)
            if mapped is None:
                mapped = (taken := _character(source, at), source[at : at + taken])
            steps.append((at, mapped[0], mapped[1]))
            at += mapped[0]
        if self.squeeze:
            while steps and steps[0][2].strip(b" ") == b"":
                steps.pop(0)
            while steps and steps[-1][2].strip(b" ") == b"":
                steps.pop()
        last_blank = self.squeeze
        first = steps[0][0] if steps else 0
        if self.prefix and not self.behind and steps:
            out += self.blank
            origin += [first] * len(self.blank)
        for at, _, text in steps:
            if self.squeeze and last_blank:
                text = text.lstrip(b" ")
            for byte in text:
                added = self.blank if byte == 32 else bytes([byte])
                out += added
                origin += [at] * len(added)
            if text:
                last_blank = text.endswith(b" ") and self.squeeze
        end = steps[-1][0] + steps[-1][1] if steps else len(source)
        while self.squeeze and out.endswith(self.blank) and len(out) > (len(self.blank) if self.prefix else 0):
            del out[-len(self.blank) :], origin[-len(self.blank) :]
        if self.prefix and self.behind and steps:
            out += self.blank
            origin += [end] * len(self.blank)
        return bytes(out), np.array([*origin, end], np.int64)

    def _spaces_only(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The same result without a loop over bytes: each space, and the one put in front, becomes a blank."""
        data = np.frombuffer(source, np.uint8)
        widths = np.where(data == 32, len(self.blank), 1)
        origin = np.concatenate([np.zeros(len(self.blank), np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]])
        return self.blank + source.replace(b" ", self.blank), origin


def _character(source: bytes, at: int) -> int:
    lead = source[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Encoder:
    """One model: ids as the library gives them, and each piece's span of original bytes."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalise = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        # A byte piece stands for one byte; an unknown piece's length shows only in the text.
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.fallback = model.trainer_spec.byte_fallback
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        # No piece crosses from a word into the blank behind it, so words are encoded apart.
        self.by_word = (
            model.trainer_spec.model_type == BPE
            and self.normalise.plain()
            and self.fallback
            and not inner
            and not any(p.type == USER_DEFINED for p in model.pieces)
        )
        self.words: dict[str, tuple[bytes, str]] = {}

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text all ids, and the same as decimal numbers joined by commas."""
        cut: list[list[str] | None] = []
        for text in texts:
            parts = text.split(" ")
            cut.append(parts if self.by_word and SPACE not in text and "" not in parts else None)
        words = self.words
        new = list({p for parts in cut if parts for p in parts if p not in words})
        words.update(zip(new, map(_packed, self.library.encode(new, num_threads=1)), strict=True))
        whole = iter(self.library.encode([t for t, c in zip(texts, cut, strict=True) if c is None], num_threads=1))
        out = []
        for parts in cut:
            found = [_packed(next(whole))] if parts is None else list(map(words.__getitem__, parts))
            out.append((np.frombuffer(b"".join([f[0] for f in found]), np.int32), ",".join([f[1] for f in found])))
        if len(words) > REMEMBERED:  # the older half stays: frequent words are met early
            for word in list(itertools.islice(words, REMEMBERED // 2, None)):
                del words[word]
        return out

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Rows (begin, end) of original UTF-8 bytes, one for each id.

        A blank put in front takes no original bytes of its own. Pieces that a mapped string is spread over share it.
        """
        source = text.encode()
        normal, origin = self.normalise(source)
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            lengths = self._with_unknown(text, ids, lengths)
        ends = np.cumsum(lengths)
        if ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        begins, ends = origin[ends - lengths], origin[ends]
        return np.stack([begins, np.maximum(ends, begins)], axis=1)

    def _with_unknown(self, text: str, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        lengths = lengths.copy()
        said = self.library.encode(text, out_type=str)
        for i in np.flatnonzero(ids == self.unknown):
            lengths[i] = len(said[i].encode())
        return lengths

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def _packed(ids: list[int]) -> tuple[bytes, str]:
    return array.array("i", ids).tobytes(), ",".join(map(str, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, ids array<int>, begins array<int>, ends array<int>``: every piece and its original bytes.

    A null or empty text has no pieces. Repeated rows each get their row, a null id stays null, an empty table gives
    no rows, other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(model)
        for batch in pieces(batches, 200):
            texts = batch.column("text").to_pylist()
            ids = [i for i, _ in one.ids(texts)]
            spans = [one.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([i.tolist() for i in ids], pa.list_(pa.int32())),
                    pa.array([s[:, 0].tolist() for s in spans], pa.list_(pa.int32())),
                    pa.array([s[:, 1].tolist() for s in spans], pa.list_(pa.int32())),
                ],
                names=["doc_id", "ids", "begins", "ends"],
            )

    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
    return slim(docs, key, text).mapInArrow(rows, schema)


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row ``doc_id, text``: the library's text of the ids. Null or no ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(model)
        for batch in pieces(batches, 200):
            texts = [one.library.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    slimmed = encoded.selectExpr(f"CAST(`{key}` AS LONG) AS doc_id", f"`{ids}` AS ids")
    return slimmed.mapInArrow(rows, "doc_id long, text string")


def digest_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass, answering digests instead of lists.

    Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, widest_piece``: the ids joined by commas and
    the decoded text as lowercase SHA-256, the bytes that the spans cover, and the longest span. Edge cases as
    in ``encode``.
    """
    return slim(docs, key, text).mapInArrow(_digests(model), DIGESTS)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, widest_piece long"


def _digests(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(model)
        for batch in pieces(batches, 500):
            out, texts = [], batch.column("text").to_pylist()
            for doc, text, (ids, said) in zip(batch.column("doc_id").to_pylist(), texts, one.ids(texts), strict=True):
                spans = one.spans(text, ids)
                covered = int(spans[-1, 1] - spans[0, 0]) if len(ids) else 0
                widest = int((spans[:, 1] - spans[:, 0]).max()) if len(ids) else 0
                back = hashlib.sha256(one.decode(ids).encode()).hexdigest()
                out.append((doc, len(ids), hashlib.sha256(said.encode()).hexdigest(), back, covered, widest))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows
