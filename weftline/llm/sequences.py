"""Tokenized documents in as few sequences of one capacity as can be, none cut that fits.

Texts are encoded once; a plan is made from the histogram of lengths, which has as many entries as the capacity; pieces are
numbered among those of their length, and length and number say where a piece goes. Pieces never meet in a task.
"""

from __future__ import annotations

import itertools
import json
import os
import pathlib
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import configurations
from weftline.llm.common import blocks, slim
from weftline.session import settle

#: Words that a Python worker remembers from one batch to the next.
REMEMBERED = 600_000
#: Words that are encoded as one text, and bytes of texts that are encoded side by side.
JOINED, TOGETHER = 512, 8 << 20
#: Parts that all pieces are numbered in, dealt among the lengths by their share.
PARTS = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
# One task, one thread: Spark does the spreading.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _flat(node: dict | None, inner: str) -> list[dict]:
    return [] if not node else [x for n in node[inner] for x in _flat(n, inner)] if node["type"] == "Sequence" else [node]


def _word_by_word(stated: dict) -> bool:
    """Whether a vocabulary never looks across ASCII white space: it drops it, and normalises on either side alone."""

    def harmless(n: dict) -> bool:
        blanks = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        return blanks or n["type"] in ("NFC", "NFD", "Lowercase")

    first, *others = _flat(stated.get("pre_tokenizer"), "pretokenizers") or [{"type": "none"}]
    # Only what is matched stays, and white space is in no alternative: classes of letters, of digits, and of neither.
    drops = (
        first["type"] == "Split"
        and first["behavior"] == "Removed"
        and first["invert"]
        and first["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and " " not in first["pattern"]["Regex"]
    )
    joins = [n for n in others if n["type"] != "ByteLevel" or n.get("use_regex", True) or n.get("add_prefix_space")]
    added = [t for t in stated.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]]
    return drops and not joins and not added and all(map(harmless, _flat(stated.get("normalizer"), "normalizers")))


class Encoder:
    """Ids as the library gives them, as packed unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        stated = json.loads(pathlib.Path(path).read_text())
        self.by_word = _word_by_word(stated)
        self.lowers = {"type": "Lowercase"} in ((stated.get("normalizer") or {}).get("normalizers") or [])
        self.added = [t["content"].lower() for t in stated.get("added_tokens", [])]
        self.known: dict[bytes, bytes] = {}
        suffix = stated["model"].get("end_of_word_suffix")
        self.light = None
        if self.by_word and suffix and {"type": "NFD"} not in _flat(stated.get("normalizer"), "normalizers"):
            # The same merges for words that no normaliser changes and no cut divides.
            bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytewise]}
            self.light = tokenizers.Tokenizer.from_str(json.dumps({**stated, "normalizer": None, "pre_tokenizer": plain}))
            vocabulary = self.library.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def whole(self, texts: list[bytes]) -> list[bytes]:
        said = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [_packed(e.ids) for e in said]

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after the other, and where each text's begin, with the end of the last."""
        if not self.by_word:
            packed = self.whole(texts.cast(pa.binary()).to_pylist())
            return np.frombuffer(b"".join(packed), "<u4"), _begins(np.array([len(x) // 4 for x in packed], np.int64))
        words = pc.ascii_split_whitespace(self._plain(texts))
        distinct = words.flatten().dictionary_encode()
        # Around white space there are empty words, which have no ids.
        each = distinct.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        packed = list(map(self.known.get, each))
        missing = [i for i, ids in enumerate(packed) if ids is None]
        if missing:
            self._learn(each, missing, pc.match_substring_regex(distinct.dictionary, f"^{_LETTER}+$"))
            for i in missing:
                packed[i] = self.known[each[i]]
        if len(self.known) > REMEMBERED:
            # Frequent words are met early: the older half stays.
            self.known = dict(itertools.islice(self.known.items(), REMEMBERED // 2))
        flat = np.frombuffer(b"".join(packed), "<u4")
        place = _begins(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        word = np.asarray(distinct.indices)
        begins = _begins((place[1:] - place[:-1])[word])
        ids = flat[np.repeat(place[word] - begins[:-1], np.diff(begins)) + np.arange(begins[-1])]
        offsets = np.asarray(words.offsets)
        return ids, begins[offsets - offsets[0]]

    def _plain(self, texts: pa.StringArray) -> pa.StringArray:
        """Fewer distinct words, where that changes no id: there is no mark that could join a letter, no added token.

        Letters become lower case from the start, and stops stand apart from the letter before them, where a cut lies
        anyway.
        """
        if not self.lowers:
            return texts
        low = pc.ascii_lower(texts)
        bound = pc.match_substring_regex(texts, r"[\x{300}-\x{37f}]")
        for a in self.added:
            bound = pc.or_(bound, pc.match_substring(low, a))
        return pc.if_else(bound, texts, pc.replace_substring_regex(low, f"({_LETTER})([.,])", r"\1 \2"))

    def _learn(self, words: list[bytes], missing: list[int], letters: pa.BooleanArray) -> None:
        """Ids of words not known yet. Plain words go many as one text: a word's last token, and no other, carries the
        suffix that ends it."""
        plain = np.asarray(letters)[missing] if self.light else np.zeros(len(missing), bool)
        others = [words[i] for i, easy in zip(missing, plain.tolist(), strict=True) if not easy]
        words = [words[i] for i, easy in zip(missing, plain.tolist(), strict=True) if easy]
        lines = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        said = self.light.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False) if lines else []
        for line, e in zip(lines, said, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            packed, begin = ids.tobytes(), 0
            if len(ends) != len(line):
                others += line
                continue
            for word, end in zip(line, ends, strict=True):
                self.known[word] = packed[begin:end]
                begin = end
        self.known.update(zip(others, self.whole(others), strict=True))


#: Lower-case Latin letters.
_LETTER = "[a-z\u00df-\u00f6\u00f8-\u00ff]"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[str, Encoder] = {}


def _cutter(path: str, capacity: int, end: int, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    closing = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in blocks(batches, "text", TOGETHER):
            rows: list[tuple[int | None, int, int, int, int, bytes | None]] = []
            all_ids, begins = encoder.ids(batch.column("text"))
            for key, low, high in zip(batch.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                ids = all_ids[low:high].tobytes() + closing
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, n, n * capacity, len(part) // 4, zlib.crc32(part), part if keep else None))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return cut


def _placer(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length, first, _, sequence, offset = plan

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A length's entries lie together, ordered by the number of their first piece.
        begins = np.searchsorted(length, np.arange(int(length[-1]) + 2) if len(length) else np.arange(1))
        for batch in batches:
            size, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            entry = np.empty(len(size), np.int64)
            for one in np.unique(size).tolist():
                rows = size == one
                own = first[begins[one] : begins[one + 1]]
                entry[rows] = begins[one] + np.searchsorted(own, number[rows], side="right") - 1
            found = [pa.array(sequence[entry] + number - first[entry]), pa.array(offset[entry])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end: int = 1,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and ``ids`` if asked for.

    A document is its ids by the tokenizers library, without added special tokens, and the id ``end``. Only a document of
    more than ``capacity`` ids is cut: into pieces of the capacity and a rest. ``start`` is a piece's place among its
    document's ids, ``offset`` its place in its sequence; sequences have no gaps. ``ids`` are little-endian unsigned 32-bit
    numbers, ``ids_crc32`` their checksum. A null or empty text is the id ``end`` alone. Repeated rows are packed each; a
    null id is packed like any other; an empty table gives no rows; other columns are ignored. Equal pieces are
    interchangeable; ties in length go by id, piece and checksum. A text is encoded whole by one task.
    """
    if capacity < 1:
        raise ValueError("a sequence holds at least one token")
    cut = slim(docs, key, text).mapInArrow(_cutter(tokenizer, capacity, end, with_ids), PIECES)
    kept = settle(cut if with_ids else cut.drop("ids"), "pieces")
    # One row for each length, whatever the corpus.
    counts = np.zeros(capacity + 1, np.int64)
    for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = configurations.pack(counts, capacity).arrays()
    numbered = _numbered(kept, counts)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.select(*columns, "number").mapInArrow(_placer(plan), schema + ", sequence_id long, offset long")


def _numbered(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``number``: a piece's place among all of its length, from 0.

    A length that many pieces have is numbered in many parts, and a part begins where the ones before end. There are at
    most PARTS parts and one for each length, so their sizes can be broadcast.
    """
    parts = np.maximum(1, np.ceil(counts * (PARTS / max(1, int(counts.sum()))))).astype(int)
    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("length") + 1).cast("int"))
    if len(parts) > 256:
        many = F.element_at(F.from_json(F.lit(json.dumps(parts.tolist())), "array<int>"), (F.col("length") + 1).cast("int"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(offsets), ["length", "part"]).withColumn("number", (F.col("before") + F.col("rank")).cast("long"))


def filled(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences themselves, from :func:`pack` with ``with_ids``.

    A sequence has at most as many pieces as tokens, so what meets in one group is bounded by the capacity.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(inside.alias("inside"))
    return joined.select("sequence_id", F.expr("aggregate(inside, X'', (whole, one) -> concat(whole, one.ids))").alias("ids"))
