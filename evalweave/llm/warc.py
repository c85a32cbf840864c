"""Deterministic sharded WARC writer.

Records are dealt to ranges of the page id that weigh alike, sorted in each, and written as one gzip
member each into files rolled by compressed size. Headers and digests are made anew from the page, so the
same table gives the same files. Files are written under temporary names of their own attempt; the driver
renames those of the attempts that succeeded and then commits a manifest, itself by a rename.

Null url is empty, null html is an empty payload. Of equal payloads the smallest page id is the response and
the others revisit it; null ids come after all others. Repeated rows: the first is the response, the rest
revisit it. Payloads of any length are one record. An empty table gives an empty manifest. Only page_id,
url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, even_ranges, range_of, shuffle_width, tune

#: A file is closed once it holds so many compressed bytes.
ROLL = 64 << 20
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, written string, bytes long, records long, first_id long, last_id long, sha256 string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}/{copy}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, revisits: bool, refers_to: int | None, copy: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisits:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file under its temporary name."""

    def __init__(self, store: pa.fs.FileSystem, folder: str, name: str):
        self.name, self.written = name, f"{name}.{uuid.uuid4().hex}"
        self.out, self.sha = store.open_output_stream(f"{folder}/.tmp/{self.written}", compression=None), hashlib.sha256()
        self.bytes = self.records = 0
        self.first = self.last = None
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        self._put(info.encode())

    def _put(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self._put(raw)
        self.first = page_id if not self.records else self.first
        self.last = page_id
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "written": self.written, "bytes": self.bytes, "records": self.records, "first_id": self.first, "last_id": self.last, "sha256": self.sha.hexdigest()}


def write(pages: DataFrame, spark: SparkSession, out: str, roll: int = ROLL, least: int = 0) -> list[dict]:
    """Writes the archive into the shared folder `out` (a URI) and returns its manifest, a row for each file."""
    tune(spark)
    sc = Scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    short = sc.write("short", rows.select("id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha"), F.octet_length("html").alias("size")))
    first = short.where(F.col("size") >= least).groupBy("sha").agg(F.min("id").alias("to"), F.count("*").alias("n")).where("n > 1").select("sha", "to")
    # Written: the join below then has plain exchanges on both sides, which AQE splits at a payload with many pages.
    role = short.where(F.col("size") >= least).join(sc.write("first", first), "sha").select("id", "sha", "to").distinct()
    part = range_of(even_ranges(short, "id", F.col("size") + 512, shuffle_width(spark)), "id")
    page = rows.select(part.alias("part"), "id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("binary").alias("sha"), F.lit(None).cast("long").alias("to"))
    mark = role.select(part.alias("part"), "id", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "sha", "to")
    # One shuffle of the pages; what a page's payload refers to comes sorted right before the page.
    dealt = page.unionByName(mark).repartitionById(shuffle_width(spark), F.pmod("part", F.lit(shuffle_width(spark))).cast("int")).sortWithinPartitions("part", "id", "kind", "url", "html")
    store, folder = pa.fs.FileSystem.from_uri(out)
    store.create_dir(f"{folder}/.tmp", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = pa.fs.FileSystem.from_uri(out)
        done, file, at, serial = [], None, None, 0
        roles, seen, of = {}, {}, object()
        for batch in batches:
            for p, i, kind, url, html, sha, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != at:
                    done += [file.close()] if file else []
                    file, at, serial = None, p, 0
                if i != of:
                    roles, seen, of = {}, {}, i
                if not kind:
                    roles[sha] = to
                    continue
                payload = html.encode()
                key = hashlib.sha1(payload).digest()
                copy = seen.get(key, 0)
                seen[key] = copy + 1
                revisits = key in roles and (roles[key] != i or copy > 0)
                file = file or _File(own, folder, f"pages-{p:06d}-{serial:06d}.warc.gz")
                file.add(i, record(i, url, payload, payload_digest(payload), revisits, roles.get(key), copy))
                if file.bytes >= roll:
                    done.append(file.close())
                    file, serial = None, serial + 1
        done += [file.close()] if file else []
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _MANIFEST.split(", "))]))

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(run, _MANIFEST).collect()), key=lambda r: r["name"])
    for r in manifest:
        store.move(f"{folder}/.tmp/{r.pop('written')}", f"{folder}/{r['name']}")
    with store.open_output_stream(f"{folder}/.tmp/manifest.json") as f:
        f.write(json.dumps(manifest, indent=1).encode())
    store.move(f"{folder}/.tmp/manifest.json", f"{folder}/manifest.json")
    store.delete_dir(f"{folder}/.tmp")  # what failed attempts left
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file of one gzip member a record."""
    rest = b""
    while True:
        unpack, raw = zlib.decompressobj(31), b""
        while not unpack.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if raw:
                    raise ValueError("the file ends within a record")
                return
            raw += unpack.decompress(rest)
            rest = unpack.unused_data
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def read(spark: SparkSession, out: str, manifest: list[dict]) -> DataFrame:
    """A row for each page record of the files of a manifest; every digest is checked against its block."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa.fs.FileSystem.from_uri(out)
        kinds = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in schema.split(", "))])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for h, block in records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        whole = h["WARC-Type"] == "revisit" or (payload_digest(payload) == digest and len(payload) == int(h["X-Payload-Length"]))
                        if not whole or payload_digest(block) != h["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} doesn't match its digest")
                        rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("X-Refers-To-Page"))))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    files = spark.createDataFrame([(r["name"],) for r in manifest], "name string")
    return files.repartition(max(1, min(len(manifest), 4 * shuffle_width(spark)))).mapInArrow(run, schema)
