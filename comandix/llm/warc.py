"""WARC archives whose records are Zstandard frames of their own, with a dictionary in front.

Each task writes its pages to files of its own: a skippable frame with a dictionary trained on the
first records of that file, then one frame per record. Files are named anew by every attempt, and only those that a finished task
reports are read, so a task that is repeated or lost leaves nothing that counts. Payloads that
occur before, by smallest page id, become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import common
from comandix.session import work_dir

#: Fixed values of the format: the magic numbers of the leading frame and of a Zstandard frame.
DICTIONARY_FRAME, PROFILE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_PAYLOAD = 100
#: Bytes and records from which a file's dictionary is trained, its size, and payload bytes in one file.
#: Compressed bytes that a task reads back.
READ = 128 << 20
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY, FILE = 4 << 20, 1000, 64 << 10, 64 << 20
LEVEL = 3


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page)}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, at: str) -> bytes:
    """One WARC record; a revisit has the headers of its response and no payload."""
    revisit = refers is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body += b"" if revisit else payload
    name = "null" if page is None else str(page)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(name)),
        ("WARC-Date", at),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
        ("Page-Id", name),
        ("Payload-Length", str(size)),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(refers))), ("Refers-To-Page-Id", str(refers))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def dictionary_of(records: list[bytes]):
    """A dictionary trained on records, or their bytes themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=400, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(content)) + content


def archived(folder: str, at: str):
    """Task code: pages to archive files in ``folder``; one row per finished file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        out = writer = None
        name, held, written, waiting, size = "", 0, 0, [], 0
        done: list[tuple[str, int, int]] = []

        def put(raw: bytes) -> None:
            nonlocal written, held
            frame = writer.compress(raw)
            out.write(frame)
            written, held = written + len(frame), held + 1

        def open_file() -> None:
            nonlocal out, writer, name, held, written, waiting
            name = f"{uuid.uuid4().hex}.warc.zst"
            out, held = store.open_output_stream(f"{root}/{name}", compression=None), 0
            dictionary = dictionary_of(waiting)
            dictionary.precompute_compress(level=LEVEL)
            writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
            lead = leading_frame(dictionary.as_bytes())
            out.write(lead)
            written = len(lead)
            for raw in waiting:
                put(raw)
            waiting = []

        def close_file() -> None:
            nonlocal out, size
            if out is None and waiting:
                open_file()
            if out is not None:
                out.close()
                done.append((name, held, written))
            out, size = None, 0

        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i) for i in range(5))):
                payload = (html.as_py() or "").encode()
                raw = record(page.as_py(), url.as_py(), payload, digest.as_py(), len(payload), refers.as_py(), at)
                size += len(raw)
                if out is None:
                    waiting.append(raw)
                    if size >= SAMPLE_BYTES or len(waiting) >= SAMPLE_RECORDS:
                        open_file()
                else:
                    put(raw)
                if size >= FILE:
                    close_file()
        close_file()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["file", "records", "bytes"])

    return run


def frames(read, chunk: int = 1 << 17) -> Iterator[bytes]:
    """The records of an archive that ``read(n)`` reads, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no leading dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(read(size)))
    rest = b""
    while True:
        rest = rest or read(chunk)
        if not rest:
            return
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def listed(folder: str, with_payload: bool):
    """Task code: archive files to one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for raw in frames(lambda n: _exactly(source, n)):
                        rows.append(_outcome(file, *parsed(raw), with_payload))
                        size += len(raw)
                        if len(rows) >= 5000 or size >= 8 << 20:
                            yield _record_rows(rows)
                            rows, size = [], 0
        if rows:
            yield _record_rows(rows)

    return run


def _exactly(source, n: int) -> bytes:
    return source.read(n)


def _outcome(file: str, headers: dict[str, str], payload: bytes, with_payload: bool) -> tuple:
    page, refers = headers["Page-Id"], headers.get("Refers-To-Page-Id")
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} is damaged")
    whole = int(headers["Payload-Length"])
    if kind == "response" and len(payload) != whole:
        raise ValueError(f"the payload of page {page} is cut")
    shown = payload if with_payload and kind == "response" else None
    return (None if page == "null" else int(page), whole, digest, kind, None if refers is None else int(refers), headers.get("WARC-Target-URI"), file, shown)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)], names)


def write_archives(pages: DataFrame, folder: str | None = None, at: str = "2020-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes one record per row of ``pages`` (page_id, url, html); gives the folder and its finished files.

    A NULL html is an empty payload. Of equal payloads of 100 bytes or more the smallest page_id is
    the response; rows with that id are all responses, and a NULL page_id is a revisit of another
    page's payload or, where there is none, a response. ``folder`` is new and empty, a path that all
    executors share. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "archive")
    html = F.coalesce(F.col("_html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("_page"), F.col("url").alias("_url"), F.col("html").alias("_html"))
    rows = rows.withColumn("_digest", F.sha2(html.cast("binary"), 256)).withColumn("_size", F.octet_length(html))
    first = rows.where(F.col("_size") >= LEAST_PAYLOAD).groupBy("_digest").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1 and _first is not null").select(F.col("_digest").alias("_of"), "_first")
    told = rows.join(first, F.col("_digest") == F.col("_of"), "left")
    refers = F.when(~F.col("_page").eqNullSafe(F.col("_first")), F.col("_first"))
    told = told.select("_page", "_url", "_html", "_digest", refers.alias("_refers"))
    return folder, common.stored(told.mapInArrow(archived(folder, at), "file string, records long, bytes long"))


def read_archives(folder: str, files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the files: see ``RECORD``. Payloads are checked against their digests.

    Files are dealt out evenly, ``READ`` bytes a task on average, to at least as many tasks as there are cores if there
    are as many files; the number of tasks is set, so that the adaptive planner doesn't join them.
    """
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = min(size.n, max(files.sparkSession.sparkContext.defaultParallelism, -(-size.bytes // READ)))
    return files.select("file").repartition(max(1, tasks)).mapInArrow(listed(folder, with_payload), RECORD)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
