"""Dictionary-compressed WARC archives: each record is a Zstandard frame of its own, the dictionary leads in a skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, written

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, kind: str, refers: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    url = "".join((url or "").splitlines())  # a field is one line
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{f'null:{uuid.uuid4()}' if page is None else page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from records dealt evenly over the archive, up to sample_bytes; their raw bytes where there are too few to train."""
    every = max(1, sum(map(len, records)) // sample_bytes)
    some = records[::every]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, some)) // 10)), some)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], size: int = 64 << 10, sample_bytes: int = 2 << 20, level: int = 6) -> bytes:
    d = train(records, size, sample_bytes)
    coder = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(coder.compress, records)])


def frames(data: bytes, at: int) -> Iterator[bytes]:
    """The frames from an offset on, found by their block headers."""
    while at < len(data):
        head = data[at : at + 18]
        end = at + zstandard.frame_header_size(head)
        while True:
            block = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        end += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield data[at:end]
        at = end


def records_of(data: bytes) -> Iterator[bytes]:
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    yield from map(coder.decompress, frames(data, 8 + n))


def parsed(raw: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (None for a revisit) of a record; checks a payload against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    number = lambda f: int(s) if (s := fields.get(f, "")[len("<urn:page:") : -1]) and not s.startswith("null:") else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        length, found = len(payload), digest_of(payload)
        if found != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 8 << 20, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as archives of about archive_bytes of records each; returns their manifest (file, records).

    Of pages with equal payloads of at least min_bytes, the one with the largest page_id is a response and others are
    revisits of it; shorter payloads are all responses. Null html is an empty payload. A page with a null id revisits like
    others; where all ids are null, all are responses; rows that share the largest id all are. An empty table writes nothing; further columns are
    ignored. The date is that of all records, fixed so that reruns write equal records; a record's id is its page's (a new one for a null id).

    A file's name is new in each attempt of a task, and only files in the manifest count: a task that is run again leaves
    no damage. folder is any URI that pyarrow writes, such as file:// or hdfs://.
    """
    bounded_batches(pages.sparkSession)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload")).withColumn("null", F.col("page_id").isNull()).withColumn("page_id", F.coalesce("page_id", F.lit(0)))
    # Which pages revisit which is found on digests. Payloads are moved once, by page, so pages with one payload are no hot key.
    told = page.filter(F.octet_length("payload") >= min_bytes).select("page_id", "null", "digest")
    best = told.groupBy("digest").agg(F.max(F.when(~F.col("null"), F.col("page_id"))).alias("best"), F.count("*").alias("n"))
    best = written(best.filter("n > 1 and best is not null").drop("n"), "best")
    revisits = told.join(best, "digest").filter(F.col("null") | (F.col("page_id") != F.col("best"))).distinct()
    rows = page.join(revisits, ["page_id", "null", "digest"], "left")
    rows = rows.select("page_id", "null", "url", "payload", F.col("best").isNotNull().alias("revisit"), F.coalesce("best", F.lit(0)).alias("best"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[bytes] = []
        size = 0

        def put() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            to, path = fs.FileSystem.from_uri(f"{folder}/{name}")
            to.create_dir(path.rpartition("/")[0], recursive=True)
            with to.open_output_stream(path, compression=None) as f:  # the records are frames already
                f.write(archive(made))
            return pd.DataFrame({"file": [name], "records": [len(made)]})

        for pdf in batches:
            for x in pdf.itertuples():
                made.append(record(None if x.null else x.page_id, x.url, bytes(x.payload), "revisit" if x.revisit else "response", x.best if x.revisit else None, date))
                size += len(made[-1])
                if size >= archive_bytes:
                    yield put()
                    made, size = [], 0
        if made:
            yield put()

    return written(rows.mapInPandas(write, "file string, records long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    files = files.join(manifest.select("file"), "file", "left_semi").select("content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                part, size = [], 0
                for raw in records_of(bytes(data)):
                    part.append(parsed(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield _frame(part)
                        part, size = [], 0
                if part:
                    yield _frame(part)

    return files.mapInPandas(read, schema)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to new archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))
