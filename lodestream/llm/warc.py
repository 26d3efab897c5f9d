"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

Tasks write their records as one gzip stream for each archive, as many crawlers do. The normaliser inflates such a
stream once, front to back, and rewrites every record as a gzip member of its own, with a sidecar index of offsets;
the reader then fetches any record by its offset. Archives lie in a folder that all executors share; their names carry
the task attempt, and only archives in the written manifest count, so attempts that are lost or run twice do no harm.

Null payloads count as empty. Of equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a
response and the others revisit it; rows that share page_id and payload are all responses or all revisits. Rows with a
null page_id are responses. Null urls are empty. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import rows, shared_dir

BLOCK = 1 << 20
GZIP = 31
LEVEL = 4
_MANIFEST = "path string, n bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def split_head(data: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """A record's header fields and the length of its header, or None if the header is not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = bytes(data[:end]).decode().split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), end + 4


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time."""
    held = bytearray()
    need = 0
    for piece in stream:
        held += piece
        while len(held) >= need:
            found = split_head(held)
            if found is None:
                break
            need = found[1] + int(found[0]["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """A gzip file's bytes, whether it has one member or many."""
    engine = zlib.decompressobj(GZIP)
    while data := source.read(BLOCK):
        while data:
            yield engine.decompress(data, 4 * BLOCK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data + data, zlib.decompressobj(GZIP)
    yield engine.flush()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    return store, path


def _manifest(found: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["path", "n"])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes monolithic archives of pages (page_id, url, html); returns their manifest."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    keys = pages.where("page_id IS NOT NULL").select("page_id", F.sha1(body).alias("sha"), F.length(body).alias("size")).where(F.col("size") >= min_bytes)
    firsts = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = keys.join(firsts, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    joined = pages.select("page_id", "url", "html", F.sha1(body).alias("sha")).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        path, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
        engine, out = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), None
        for b in rows(batches):
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                out = out or store.open_output_stream(path, compression=None)
                payload = (html or "").encode()
                out.write(engine.compress(record(page_id, url or "", payload, digest(payload), refers_to)))
                n += 1
        if out:
            out.write(engine.flush())
            out.close()
            yield from _manifest([(path, n)])

    joined.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/written")
    return pages.sparkSession.read.parquet(f"{folder}/written")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for each record and a sidecar index; returns the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for b in batches:
            for source in b.column("path").to_pylist():
                path, at, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(source, compression=None) as old, store.open_output_stream(path, compression=None) as new, store.open_output_stream(f"{path}.index") as index:
                    for r in records(inflated(old)):
                        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = engine.compress(r) + engine.flush()
                        new.write(member)
                        index.write(json.dumps({"id": split_head(r)[0]["WARC-Record-ID"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield from _manifest([(path, n)])

    spread(manifest).mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/normalised")
    return manifest.sparkSession.read.parquet(f"{folder}/normalised")


def spread(manifest: DataFrame) -> DataFrame:
    """One file a task: the names are random, so ranges of them part evenly, and few tasks get a second one."""
    return manifest.repartitionByRange(max(1, manifest.count()), "path")


def lines(stream, size: int = BLOCK) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(size):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, by its offset: page_id, url, payload (null for revisits) and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_file(path) as archive, store.open_input_stream(f"{path}.index") as index:
                    out = []
                    for line in lines(index):
                        at = json.loads(line)
                        archive.seek(at["offset"])
                        r = zlib.decompress(archive.read(at["length"]), GZIP)
                        head, start = split_head(r)
                        block = r[start : start + int(head["Content-Length"])]
                        http, body = split_head(block)
                        sha1, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        payload = block[body:] if kind == "response" else None
                        if payload is not None and (digest(payload) != sha1 or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"{path} at {at['offset']}: the payload is not that of the digest")
                        number = lambda k: int(x) if (x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023, E731
                        out.append((number("WARC-Record-ID"), head["WARC-Target-URI"], payload, int(http["Content-Length"]), sha1, kind, number("WARC-Refers-To")))
                        if len(out) == 256:
                            yield _found(out)
                            out = []
                    yield _found(out)

    return spread(manifest).mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _found(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_archives(normalise(write_archives(pages, folder), folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits of the digest make four of its base32 form.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS low FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(s, 5 * (j // 4) + 1, 5))::INT >> (15 - 5 * (j % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to FROM f"""
