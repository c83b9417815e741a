"""WARC archives compressed record by record against a dictionary of their own.

A Zstandard dictionary is trained on a bounded sample of the records. Every file starts with a skippable frame that
holds the dictionary, so a file can be read alone; each record is a frame of its own, so reading can start at any record.
Records whose payload is written elsewhere are revisits without a body.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions
from weftline.operators.lookup import lookup
from weftline.session import scratch_path, settle

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of the dictionary: records sampled, bytes of a sampled record, bytes of the dictionary.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 1 << 16, 1 << 16
#: A file is closed once it holds so many bytes; a task then starts the next.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20


def dictionary(pages: DataFrame, body: str = "html", key: str = "page_id") -> bytes:
    """A dictionary trained on the ``SAMPLES`` records of up to ``SAMPLE_BYTES`` with the smallest hash of their id.

    Records too few or too short to train on give an empty dictionary, and files are then written without one.
    """
    sized = pages.where(F.octet_length(F.col(body)).between(1, SAMPLE_BYTES))
    hashed = sized.select(F.col(body).alias("body"), F.xxhash64(F.col(key), F.octet_length(F.col(body))).alias("h"))
    # Thinned to about twice the sample first, so that no task sends more than its share of it.
    n = hashed.count()
    thinned = hashed.where(F.col("h") / 2.0**64 + 0.5 <= min(1.0, 2 * SAMPLES / max(n, 1)))
    picked = thinned.orderBy("h", F.md5("body")).limit(SAMPLES)
    samples = [r.body.encode() for r in picked.select("body").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _classified(pages: DataFrame, least: int, key: str, url: str, body: str) -> DataFrame:
    """Each page with its digest, and for a payload of ``least`` bytes or more the largest page_id that shares it."""
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size")
    shared = groups.agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Only payloads written more than once are looked up. A plain join to a side grouped by the same key would leave all
    # rows of a hot one, payloads included, in one task.
    shared = shared.withColumnsRenamed({"digest": "shared_digest", "size": "shared_size"})
    found = lookup(rows, shared, [("digest", "shared_digest"), ("size", "shared_size")])
    return found.select("page_id", "url", "payload", "digest", "size", "newest")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, date: str) -> bytes:
    """One WARC record; a revisit states the length of the payload that it leaves out."""
    revisit = refers is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def _one_line(url: str) -> str:
    """Control characters would end the header; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return headers, rest[:length]


class Writer:
    """Files of one task. Names hold the attempt, so that a repeated task never touches another's files."""

    def __init__(self, folder: str, trained: bytes, file_bytes: int) -> None:
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.base, recursive=True)
        self.folder, self.trained, self.most = folder, trained, file_bytes
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        task = TaskContext.get()
        self.name = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
        self.files: list[tuple[str, int, int]] = []
        self.out, self.written, self.records = None, 0, 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.out = self.store.open_output_stream(f"{self.base}/{self._file()}")
            head = struct.pack("<II", SKIPPABLE, len(self.trained)) + self.trained if self.trained else b""
            self.out.write(head)
            self.written, self.records = len(head), 0
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.written += len(frame)
        self.records += 1
        if self.written >= self.most:
            self.close()

    def _file(self) -> str:
        return f"pages-{self.name}-{len(self.files):04d}.warc.zst"

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((f"{self.folder}/{self._file()}", self.records, self.written))
            self.out = None


def _write(folder: str, trained: bytes, date: str, file_bytes: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "size", "newest")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, size, newest = (c[i].as_py() for c in columns)
                # The newest page keeps the payload; so does a page that cannot be told from it.
                refers = newest if newest is not None and page_id is not None and page_id != newest else None
                writer = writer or Writer(folder, trained, file_bytes)
                writer.add(record(page_id, url, payload, digest, size, refers, date))
        if writer:
            writer.close()
            path, n, size = zip(*writer.files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return rows


def write_archive(
    pages: DataFrame,
    folder: str,
    least: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes one record for each row below ``folder`` and answers the manifest ``path, records, bytes``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest ``key`` is the response and the
    others revisit it. Smaller payloads are all responses, and so are rows without an id and rows that repeat the
    largest id. A null body is empty. The manifest names the files of the tasks that succeeded; files that a lost
    task left behind are not in it. An empty table writes no file. Other columns are ignored.
    """
    trained = dictionary(pages, body, key)
    rows = _classified(pages, least, key, url, body)
    return settle(rows.mapInArrow(_write(folder, trained, date, file_bytes), "path string, records long, bytes long"), "warc-manifest")


def frames(data: memoryview) -> Iterator[tuple[int, int]]:
    """Begin and end of every frame, found from the block headers without decompressing."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        begin = at
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            at += zstandard.frame_header_size(bytes(data[at : at + 18]))
            last = False
            while not last:
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else size)
            if data[begin + 4] >> 2 & 1:
                at += 4
        else:
            raise ValueError(f"no frame at byte {at}")
        if at > len(data):
            raise ValueError("the file ends inside a frame")
        yield begin, at


def read_file(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of one file, by the dictionary in its first frame."""
    reader, view = zstandard.ZstdDecompressor(), memoryview(data)
    for begin, end in frames(view):
        if struct.unpack_from("<I", view, begin)[0] == SKIPPABLE:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[begin + 8 : end])))
        elif struct.unpack_from("<I", view, begin)[0] == FRAME:
            yield parse(reader.decompress(view[begin:end]))


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read(payloads: bool) -> Callable:
    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RECORD.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            store, where = fs.FileSystem.from_uri(path)
            with store.open_input_stream(where) as f:
                data = f.read()
            for headers, body in read_file(data):
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = headers["warc-type"]
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"a payload in {path} does not match its digest")
                refers = _page(headers.get("warc-refers-to")) if kind == "revisit" else None
                kept = body if payloads and kind == "response" else None
                page, size, url = _page(headers["warc-record-id"]), int(headers["x-payload-length"]), headers.get("warc-target-uri")
                found.append((page, size, digest, kind, refers, url, kept))
                held += len(kept or b"") + 200
                if held >= READ_BYTES:
                    yield batch(found)
                    found, held = [], 0
        if found:
            yield batch(found)

    return rows


def read_archive(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the files a manifest names; response payloads are checked against their digests.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``: length and digest are those of the
    full payload for revisits too; their ``payload`` is null. ``payloads=False`` leaves all payloads out.
    """
    return manifest.select("path").repartition(partitions(manifest), "path").mapInArrow(_read(payloads), RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes an archive below the shared folder and reads it back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, **options), payloads=False).drop("url", "payload")
