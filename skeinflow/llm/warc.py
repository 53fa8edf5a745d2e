"""WARC archives compressed per record with a shared Zstandard dictionary, and a reader of them.

Each archive file is: one skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame for each
record, so that any record can be read by its offset with nothing but the file's start. The dictionary is trained on a
bounded sample of the records (SAMPLE_ROWS by a hash of the payload, no more than SAMPLE_BYTES) and only affects size.

Of equal payloads of at least min_bytes bytes the row with the smallest page_id is a response; the others are revisit
records without payload that refer to it. Equal means equal length and SHA-256; the SHA-1 that archives carry is only shown.

Archives are written by tasks to new names in the shared folder; the index, which Spark commits as a table, names the
archives and record offsets that count. What a lost or repeated task left behind is in no index and never read.

A null html is an empty payload. A null url is written as about:blank. Null page_ids come after all others, and only a
group without any other has a null response. Rows with the same page_id and payload are of one kind. An empty table gives
an empty index and no archive. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow, new_path, raw, slices, staged, with_group

MAGIC = 0x184D2A5D
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 112_640
ARCHIVE_BYTES = 1 << 30
MIN_PAYLOAD = 0
LEVEL = 3
INDEX = "page_id {id}, archive string, offset bigint, length bigint"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(pages: DataFrame) -> bytes:
    """A dictionary from the sample, or none (b"") where there is too little to learn from."""
    picked = pages.where("html is not null and length(html) > 0").select("html", F.xxhash64("html").alias("h")).where(F.octet_length("html") <= SAMPLE_BYTES // 16)
    n = picked.count()
    if not n:
        return b""
    share = min(2**63 - 1, SAMPLE_ROWS * 2**63 // n)
    samples, size = [], 0
    for r in picked.where(F.abs(F.col("h")) <= share).limit(2 * SAMPLE_ROWS).toLocalIterator():
        samples.append(r.html.encode())
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """The bytes of one record."""
    def urn(x) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(x))}>"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {(url or 'about:blank').split(chr(10))[0].strip()}", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, block.partition(b"\r\n\r\n")[2]


def writer(folder: str, dictionary: bytes, archive_bytes: int):
    """An Arrow function (page_id, url, html, is_revisit, refers_to) that writes archives and returns their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True)
        out, name, place = None, "", 0
        try:
            for b in slices(batches, "html"):
                offsets, lengths, names = [], [], []
                for page_id, url, html, revisit, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    if out is None or place >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        out = files.open_output_stream(f"{at}/{name}", compression=None)
                        out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                        place = 8 + len(dictionary)
                    frame = pack.compress(record("revisit" if revisit else "response", page_id, url, html or b"", refers_to))
                    out.write(frame)
                    offsets.append(place)
                    lengths.append(len(frame))
                    names.append(name)
                    place += len(frame)
                yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def decoder(head: bytes) -> zstandard.ZstdDecompressor:
    own = zstandard.ZstdCompressionDict(head) if head else None
    return zstandard.ZstdDecompressor(dict_data=own)


def open_archive(files: pafs.FileSystem, path: str):
    """(input file, decompressor) of an archive, by its leading frame."""
    f = files.open_input_file(path)
    magic, n = struct.unpack("<II", f.read_at(8, 0))
    if magic != MAGIC:
        raise ValueError(f"{path} doesn't begin with a dictionary frame")
    return f, decoder(f.read_at(n, 8))


def read_record(folder: str, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record, by its place in the index."""
    files, at = pafs.FileSystem.from_uri(folder)
    f, unpack = open_archive(files, f"{at}/{archive}")
    return parse(unpack.decompress(f.read_at(length, offset)))


def reader(folder: str, id_type: pa.DataType):
    """An Arrow function: spans of archives (archive, offset, lengths of the records there) -> a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for archive, start, lengths in zip(*(b.column(k).to_pylist() for k in range(3))):
                f, unpack = open_archive(files, f"{at}/{archive}")
                rows = []
                for n in lengths:
                    fields, payload = parse(unpack.decompress(f.read_at(n, start)))
                    start += n
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError("a payload differs from its digest")
                    ids = [int(x) if x else None for x in (fields["X-Page-ID"], fields.get("X-Refers-To-Page", ""))]
                    rows.append((ids[0], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], ids[1]))
                f.close()
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.string(), pa.string(), id_type))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as archives in folder; returns the committed index: page_id, archive, offset, length."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    narrow = rows.where(F.col("bytes") >= min_bytes).select("page_id", "sha", "bytes")
    known = with_group(narrow, ["sha", "bytes"], [F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to")], [F.sum("n").alias("n"), F.min("refers_to").alias("refers_to")], by="page_id")
    revisits = staged(known.where((F.col("n") > 1) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to", F.lit(True).alias("is_revisit")).distinct(), "revisits")
    full = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    full = full.select("page_id", "url", "html", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "refers_to")
    return staged(in_arrow(full, writer(folder, train(pages), archive_bytes), INDEX.format(id=kind)), "index")


def read_archives(index: DataFrame, folder: str, span: int = 8 << 20) -> DataFrame:
    """A row for each record that a committed index names, read from its archive. One task reads about span bytes in a row."""
    kind = index.schema["page_id"].dataType
    parts = index.withColumn("part", F.floor(F.col("offset") / span)).groupBy("archive", "part").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("r"))
    spans = parts.select("archive", F.col("r")[0]["offset"].alias("start"), F.transform("r", lambda x: x["length"]).alias("lengths"))
    name = kind.simpleString()
    return in_arrow(spans, reader(folder, to_arrow_type(kind)), f"page_id {name}, payload_bytes bigint, payload_digest string, record_type string, refers_to {name}")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
