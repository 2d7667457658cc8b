"""WARC archives compressed with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary trained on the
archive's own records; each record follows as a frame of its own, so that records can
be read alone. Archives are written under names that no other attempt has and renamed
when whole. The manifest in their folder, a table that Spark commits, lists those of the
tasks that counted; readers go by it, so what a repeated or lost task left is not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_files, at_places, free_name, located, scratch_path, ship, sized_join, written

#: The magic number of the skippable frame that holds a dictionary (fixed value).
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: An archive is closed when its records reach this many bytes.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of records that a dictionary is trained on, taken evenly over the archive.
TRAINING_BYTES = 2 << 20
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{n}' if n else f'page:{page_id}')}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, n: int = 0) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` is set.
    Control characters and spaces of the URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, n)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES, most: int = TRAINING_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the records, None if they are too few or too short for one.
    Records are cut into samples of 2 KB, of which evenly spaced ones are used."""
    samples = [r[i : i + 2048] for r in records for i in range(0, len(r), 2048)]
    samples = samples[:: max(1, -(-len(samples) * 2048 // most))]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, d=8, k=256)
    except zstandard.ZstdError:
        return None


def format_archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary's frame (left out if none could be trained) and a frame for each
    record."""
    dictionary = train(records)
    out = [] if dictionary is None else [struct.pack("<II", DICTIONARY_FRAME, len(dictionary.as_bytes())), dictionary.as_bytes()]
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return b"".join([*out, *map(compressor.compress, records)])


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of each record."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(content[8:at])
    source = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content[at:]), read_across_frames=True)
    lines = io.BufferedReader(source, 1 << 16)
    while first := lines.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        headers = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = lines.read(int(headers["content-length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end as it should")
        yield headers, block


def _put(folder: str, name: str, content: bytes) -> str:
    """Write under another name and rename, so that a task that dies never leaves half a
    file under the final name."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}", compression=None) as f:
        f.write(content)
    store.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder}/{name}"


def _write_partition(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    part, number, records, size = pyspark.TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        content = format_archive(records)
        path = _put(folder, f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst", content)
        return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(content)], pa.int64())})

    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
            records.append(format_record(*[x.as_py() for x in row]))
            size += len(records[-1])
            if size >= archive_bytes:
                yield close()
                number, records, size = number + 1, [], 0
    if records:
        yield close()


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of pages with equal payloads of 100
    bytes or more, all but the one with the smallest page_id refer to that one. Digests
    decide by the pages' places in their files; payloads stay there."""
    pages = as_files(pages, "page_id", "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    file, at, first = (free_name(pages, c) for c in ("_file", "_at", "_first"))
    marks = located(pages, file, at).filter(F.octet_length(payload) >= MIN_REVISIT_BYTES)
    marks = written(marks.select(file, at, F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest")), "warc-marks")
    firsts = written(marks.groupBy("digest").agg(F.min("page_id").alias(first), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-firsts")
    refers = F.col(first).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(first))
    revisits = written(sized_join(marks, firsts, ["digest"], "inner", 90).filter(refers).select(file, at, first), "warc-revisits")
    rows = at_places(pages, revisits, "left", 200, file, at, ["page_id", "url", "html"])
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.col(first).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html) as archives; the folder, and a row for each
    archive with its path, records and bytes, which is the folder's manifest (for a folder
    that is given, with what it lists already).

    A null html is an empty payload; a null url leaves the target header out; a null
    page_id its header, and never takes the response's part from a page with an id. Rows
    that repeat a page_id with an equal payload are responses alike. Other columns are
    ignored. Empty input writes nothing.
    """
    ship(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = with_revisits(pages)
    made = rows.mapInArrow(lambda b: _write_partition(b, folder, archive_bytes), "path string, records long, bytes long")
    return folder, written(made, "warc-manifest", f"{folder}/_manifest")


def _read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")}
            held = 0
            for headers, block in read_archive(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                said = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (said, digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                revisit = headers["warc-type"] == "revisit"
                for k, v in (("page_id", headers.get("page-id")), ("refers_to", headers.get("refers-to-page-id"))):
                    rows[k].append(None if v is None else int(v))
                for k, v in (("url", headers.get("warc-target-uri")), ("record_type", headers["warc-type"]), ("payload", None if revisit else payload), ("payload_bytes", said), ("payload_digest", digest)):
                    rows[k].append(v)
                held += len(payload)
                if held > 16 << 20:
                    yield _batch(rows)
                    rows, held = {k: [] for k in rows}, 0
            yield _batch(rows)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest, refers_to of each record of the archives in the manifest of ``folder``;
    payloads are checked against their digests."""
    ship(spark)
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    name = F.substring_index("path", "/", -1).alias("name")
    listed = spark.read.schema("path string").parquet(f"{folder}/_manifest").select(name)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(name, "content")
    files = sized_join(files, listed, ["name"], "left_semi", 100).select("content")
    return files.mapInArrow(_read_partition, schema)
