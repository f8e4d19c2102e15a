"""WARC records in ZIP packages: written per partition, read back by index and range."""

from __future__ import annotations

import base64
import hashlib
import json
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .files import create, new_folder, open_at
from .frames import stored
from .zipfiles import data_offset, members

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a package is closed and the next begun.
PACKAGE_BYTES = 64 << 20
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed on its own. A revisit has the response's HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:  # nothing in a URL can end the line
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Date: {date}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Package:
    """One ZIP file being written: a stored member of records, then a stored index of them."""

    def __init__(self, folder: str):
        self.address, self.file = create(folder, ".wacz")
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        self.member.write(data)
        where = json.dumps({"url": url, "offset": self.size, "length": len(data)})
        self.index.append(f"{'' if page_id is None else page_id} {where}\n")
        self.size += len(data)

    def close(self) -> dict:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(sorted(self.index)).encode())
        self.zip.close()
        self.file.close()
        return {"archive": self.address, "records": len(self.index)}


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = DATE, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write one record per row; returns the stored list of packages (archive, records).

    Of records with equal payloads of `least_bytes` or more, the one with the
    smallest id is the response and the others are revisits of it; all smaller
    ones are responses. A null payload is empty, a null URL has no target, a null
    id is a revisit if any row with an id has its payload and a response
    otherwise; rows that repeat an id and its payload are all responses if that id
    is the smallest. Other columns are ignored. An empty table gives no packages.

    A digest held by very many pages is counted before its shuffle, and the
    join reads plain inputs on both sides, so AQE can split it. A package counts
    once its task is committed in the returned list, so a repeated or
    speculative attempt leaves at most an unread file.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    shared = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    shared = stored(shared.filter("n > 1").drop("n"), "warc-shared")
    joined = rows.join(shared, "sha1", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )
    folder = new_folder(pages.sparkSession, "warc")

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or _Package(folder)
                data = record(page_id, url, payload.encode(), refers_to, refers_to is not None, date)
                package.add(page_id, url, data)
                if package.size >= package_bytes:
                    yield pa.RecordBatch.from_pylist([package.close()])
                    package = None
        if package:
            yield pa.RecordBatch.from_pylist([package.close()])

    return stored(joined.mapInArrow(packages, "archive string, records long"), "warc-packages")


def records_of(address: str) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(WARC headers, payload, payload length by the HTTP head) of one package's records.

    Finds the index through the ZIP directories and reads each record by its range.
    """
    with open_at(address) as file:
        found = members(file)
        index_at, index = data_offset(file, found[INDEX]), found[INDEX]
        base = data_offset(file, found[RECORDS])
        for line in bytes(file.read_at(index.size, index_at)).decode().splitlines():
            where = json.loads(line.partition(" ")[2])
            data = zlib.decompress(file.read_at(where["length"], base + where["offset"]), 31)
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(h.split(": ", 1) for h in head.decode().split("\r\n")[1:])
            http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
            sizes = [h for h in http.decode().split("\r\n") if h.startswith("Content-Length: ")]
            yield headers, payload, int(sizes[0].partition(": ")[2])


def read(packages: DataFrame) -> DataFrame:
    """One row per record of the packages in column `archive`; see READ.

    The payload of a response is read and its digest checked against the header;
    a revisit has its payload's digest and length in its headers. Each package is
    a unit of work of bounded size, so they are dealt out one by one.
    """
    count = max(1, packages.count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in READ.split(",")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for address in (a for batch in batches for a in batch.column("archive").to_pylist()):
            out = []
            for headers, payload, length in records_of(address):
                digest, kind = headers["WARC-Payload-Digest"].partition(":")[2], headers["WARC-Type"]
                if kind == "response" and (base32_sha1(payload), len(payload)) != (digest, length):
                    raise ValueError(f"{address}: {headers['WARC-Record-ID']} does not match its digest")
                target = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((_page(headers["WARC-Record-ID"]), length, digest, kind, target, headers.get("WARC-Target-URI")))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return packages.select("archive").repartition(count).mapInArrow(rows, READ)
