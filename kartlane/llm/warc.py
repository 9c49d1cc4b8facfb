"""Operator 4, WARC: write archives, normalise monolithic gzip, read back by a sidecar index.

``write`` packs one record per row into gzip files that are a single stream
each. ``normalise`` inflates such a file once, front to back, rewrites every
record as a gzip member of its own, and writes a sidecar index of tab-separated
lines (offset, length, type, record id). ``read`` opens members by that index.

Files lie in a folder that all executors share and are opened through
``pyarrow.fs``. Every attempt of a task writes files of its own name; only the
manifests that Spark commits say which files count, so a lost executor or a
speculative task leaves no doubt. Memory: one record at a time.

Defined results: a null payload is empty; a null URL or id has no header and
reads back as null; rows that repeat the id of a response are responses too;
without rows there are no archives and nothing is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

REVISIT_FROM = 1000  # payload bytes; smaller ones are always responses
BROADCAST_ROWS = 200_000  # repeated payloads that may be broadcast (about 16 MB)
PIECE = 1 << 20
MANIFEST = "path string, index string, records bigint"


def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: the row whose payload a row repeats (null: it is a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    seen = (rows.where(F.octet_length("html") >= least).groupBy("digest")
            .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"))
    seen = materialize(seen)
    few = seen.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(seen) if few else seen, "digest", "left")
    return out.select("page_id", "url", "html", "digest",
                      F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to, name: str) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            "WARC-Date: 2000-01-01T00:00:00Z",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if url is not None:
        head.append("WARC-Target-URI: " + _line(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def split_records(pieces):
    """The records of an inflated WARC stream, whatever the pieces it comes in; ``(headers, bytes)`` each."""
    buf, need, head = bytearray(), None, None
    for piece in pieces:
        buf += piece
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(buf[:end]).decode("utf-8", "replace").split("\r\n")
                head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
                need = end + 4 + int(head["Content-Length"]) + 4
            if len(buf) < need:
                break
            yield head, bytes(buf[:need])
            del buf[:need]
            need = None
    if buf.strip():
        raise ValueError("the archive ends inside a record")


def inflate(f):
    """The inflated pieces of an open gzip file of one or more members, in one pass."""
    z, fed = zlib.decompressobj(31), False
    while data := f.read(PIECE):
        while data:
            out = z.decompress(data, PIECE)
            fed = True
            if out:
                yield out
            if z.eof:
                data, z, fed = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if fed:
        if rest := z.flush():
            yield rest
        if not z.eof:
            raise ValueError("the archive is cut off")


def _open(path: str):
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(path)
    return store, at


def write(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Archives of ``rows(page_id, url, html, digest, refers_to)``; returns the manifest, committed once."""
    def run(batches):
        import pyarrow as pa
        made, out, z, n, size = [], None, None, 0, 0

        def close():
            out.write(z.flush())
            out.close()
            made[-1][1] = n

        for b in batches:
            for r in b.to_pylist():
                if out is None or size >= archive_bytes:
                    if out is not None:
                        close()
                    made.append([f"{folder}/{uuid.uuid4().hex}.warc.gz", 0])
                    store, at = _open(made[-1][0])
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out, z, n, size = store.open_output_stream(at, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], str(uuid.uuid4()))
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in made], pa.string()), pa.nulls(len(made), pa.string()),
             pa.array([x[1] for x in made], pa.int64())], ["path", "index", "records"])
    return materialize(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, MANIFEST))


def normalise(manifest: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index; returns the new manifest."""
    def run(batches):
        import pyarrow as pa
        done = []
        for b in batches:
            for path in b.column(0).to_pylist():
                target = f"{path.rsplit('/', 1)[0]}/{uuid.uuid4().hex}"
                store, at = _open(path)
                to = _open(target)[1]
                lines, offset = [], 0
                with store.open_input_stream(at, compression=None) as f, \
                        store.open_output_stream(to + ".warc.gz", compression=None) as out:
                    for head, raw in split_records(inflate(f)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{head['WARC-Type']}\t{head['WARC-Record-ID']}\n")
                        offset += len(member)
                with store.open_output_stream(to + ".idx", compression=None) as out:
                    out.write("".join(lines).encode())
                done.append((target + ".warc.gz", target + ".idx", len(lines)))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                          pa.array(cols[2], pa.int64())], ["path", "index", "records"])
    return materialize(_spread(manifest).mapInArrow(run, MANIFEST))


def _spread(manifest: DataFrame) -> DataFrame:
    """Archives dealt evenly over tasks."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism + n // 16)), "path")


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the normalised archives, opened member by member through the index.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` and, if asked for, ``payload``
    (null for revisits, whose bytes and digest are those of the payload they repeat).
    """
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = _open(path)
                with store.open_input_stream(_open(index)[1], compression=None) as f:
                    entries = [x.split("\t") for x in f.read().decode().splitlines()]
                rows = []
                with store.open_input_file(at) as f:
                    for k, (offset, length, kind, _) in enumerate(entries):
                        (head, raw), = split_records([zlib.decompress(f.read_at(int(length), int(offset)), 31)])
                        body = raw[raw.index(b"\r\n\r\n") + 4:-4]
                        http, _, content = body.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(content), hashlib.sha1(content).hexdigest()
                        else:
                            size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                            digest, content = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(), None
                        rows.append((head.get("X-Page-Id"), head.get("WARC-Target-URI"), kind, size, digest,
                                     head.get("X-Refers-To-Page"), content if payload else None))
                        if len(rows) == 1000 or k + 1 == len(entries):
                            yield _batch(rows, payload)
                            rows = []

    def _batch(rows, payload):
        import pyarrow as pa
        c = list(zip(*rows))
        number = lambda x: pa.array([None if v is None else int(v) for v in x], pa.int64())
        cols = [number(c[0]), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), number(c[3]), pa.array(c[4], pa.string()),
                number(c[5])] + ([pa.array(c[6], pa.binary())] if payload else [])
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
              + ", payload binary" * payload)
    return _spread(manifest).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back every page; payloads stay in the archives."""
    folder = shared_dir(pages.sparkSession)
    return read(normalise(write(with_revisits(pages), folder)), payload=False)
