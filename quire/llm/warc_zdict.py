"""WARC archives compressed record by record with a Zstandard dictionary.

Each archive file starts with a skippable frame that holds the dictionary its own records were
used to build; every record then is a frame of its own, so that one can be read by its offset.
Records with equal payloads are stored once: the row with the largest id is the response, the
others are revisit records that name it. Which is which is decided by DataFrame operations over
digests before payloads move; a payload with a third of all rows is dealt over several tasks.

Tasks write through a filesystem that driver and executors share. A file's name follows from its
partition and number, its content from the partition's rows, and it appears by a rename, so that
a task that runs again leaves the same files.

Defined results: a null html is an empty payload; rows equal in id and payload are responses alike;
null ids sort below all others; with an empty table there are no files and no rows; texts of any
length are one record each; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, salted_left_join, scratch_path

# Fixed values of the format: the dictionary's skippable frame, and its version line.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
NO_DATE = b"1970-01-01T00:00:00Z"

#: Where the dictionary is built from: so many bytes of the file's own records at most.
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 16 << 10
#: A file is closed when its records have so many bytes before compression.
FILE_BYTES = 32 << 20

WRITTEN = "file string, records long, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has headers of the exchange but no payload."""
    payload = b"" if revisit else (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:quire:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
        b"WARC-Date: " + NO_DATE,
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % (len(http) + len(payload)),
    ]
    if revisit:
        head[3:3] = [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to is not None:
            head[3:3] = [b"WARC-Refers-To: <urn:quire:page:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from the first records; raw content of the samples where they are too few to train on."""
    sample, held = [], 0
    for r in records:
        if held >= sample_bytes:
            break
        sample.append(r[: 64 << 10])
        held += len(sample[-1])
    try:
        return zstd.train_dictionary(dict_bytes, sample, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(sample)[:dict_bytes] or VERSION + b"\r\n"


def encode_file(records: list[bytes], level: int = 3) -> bytes:
    d = build_dictionary(records)
    packer = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(d), write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(d)) + d + b"".join(map(packer.compress, records))


def decode_file(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary frame")
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + n]))
    source = io.BufferedReader(unpacker.stream_reader(io.BytesIO(memoryview(data)[8 + n :]), read_across_frames=True), 1 << 20)
    while line := source.readline():
        if line.rstrip(b"\r\n") != VERSION:
            raise ValueError("a record doesn't start with its version")
        head = {}
        while (line := source.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b": ")
            head[name.decode().lower()] = value.decode()
        block = source.read(int(head["content-length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, block


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _id(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, salts: int = 16, max_broadcast_rows: int = 500_000) -> DataFrame:
    """Every page with its digest, whether it is a revisit, and of which page; html only of responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("sha1"))
    copies = p.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = cut(copies, "payload-copies").withColumn("known", F.lit(True))
    if copies.count() <= max_broadcast_rows:  # pages stay where they are
        p = p.join(F.broadcast(copies), ["sha1", "n"], "left")
    else:  # rows of a partition come in any order, on which the files must not depend
        p = salted_left_join(p, copies, ["sha1", "n"], F.coalesce(F.col("page_id"), F.lit(0)), salts).sortWithinPartitions("page_id", "sha1", "url")
    revisit = F.coalesce(F.col("known"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "n", "sha1", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, uri: str, file_bytes: int = FILE_BYTES, level: int = 3, **columns) -> DataFrame:
    """Archive pages under uri; returns the written table of files, their records and bytes."""

    def save(fs: pafs.FileSystem, at: str, records: list[bytes]) -> int:
        data = encode_file(records, level)
        with fs.open_output_stream(f"{at}.part", compression=None) as out:
            out.write(data)
        fs.move(f"{at}.part", at)
        return len(data)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = _filesystem(uri)
        fs.create_dir(top)
        task = TaskContext.get()
        part, tries, files, held, size = task.partitionId(), task.taskAttemptId(), [], [], 0

        def close() -> None:
            nonlocal held, size
            at = f"{top}/part-{part:06d}-{len(files):05d}.warc.zst"
            tmp = f"{at}.{tries}"
            n = save(fs, tmp, held)
            fs.move(tmp, at)
            files.append((at.rpartition("/")[2], len(held), n))
            held, size = [], 0

        for batch in batches:
            c = batch.to_pydict()
            for i, url, html, n, sha1, to, revisit in zip(c["page_id"], c["url"], c["html"], c["n"], c["sha1"], c["refers_to"], c["revisit"], strict=True):
                held.append(record(i, url, html, base64.b32encode(bytes.fromhex(sha1)).decode(), n, to, revisit))
                size += len(held[-1])
                if size >= file_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return cut(plan_records(pages, **columns).mapInArrow(write_part, WRITTEN), "warc-files")


def read(spark: SparkSession, uri: str, files: DataFrame) -> DataFrame:
    """A row for each record of the archives that files (file, ...) names; payloads are checked against their digests."""

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(uri)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as source:
                    data = source.read()
                for head, block in decode_file(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    if not revisit and (base32_sha1(payload) != digest or len(payload) != n):
                        raise ValueError(f"the payload of {head['warc-record-id']} in {name} is damaged")
                    rows.append((_id(head["warc-record-id"]), n, digest, head["warc-type"], _id(head.get("warc-refers-to")), head["warc-target-uri"], name))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], READ.replace(",", "").split()[::2])

    n = max(1, min(files.count(), spark.sparkContext.defaultParallelism * 16))
    return files.select("file").repartition(n).mapInArrow(read_part, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0, **how) -> DataFrame:
    """Archive pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    uri = scratch_path(spark, "warc")
    return read(spark, uri, write(pages, uri, min_bytes=min_bytes, **how))
