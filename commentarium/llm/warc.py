"""WARC archives: a deterministic sharded writer and a reader.

Records are dealt to ranges of page ids of about equal size and sorted; each range is
written as gzip members, one per record, to files that roll over at a compressed
size. Headers and digests are made anew from the payload and the page's id, so
equal input gives equal bytes. A task writes under a temporary name of its own
attempt and reports its files; only what the finished job reports is renamed and
listed in the manifest, so lost or repeated tasks leave nothing in the archive.

Files are opened through ``pyarrow.fs``, so the folder may be in any store that it
knows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.llm.common import bounded_batches, plain, runs, written
from commentarium.operators.joins import join_on_content
from commentarium.operators.storage import scratch_path

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20  # compressed size at which a file ends
SHARD_BYTES = 256 << 20  # payload of a shard, about
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture date; a fixed one keeps bytes equal
_BINS = 4096
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CRLF = b"\r\n"


def prepare(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to): one row per page.

    A null payload is empty. Of equal payloads of at least 100 bytes the smallest
    page_id is the response and the others refer to it; rows that repeat that id
    with the same payload are responses too. A page without an id is a response,
    and nothing refers to it.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    given = plain(pages, page_id=id_column, url=url_column, payload=payload_column)
    rows = given.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = (F.octet_length("payload") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()
    known = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
    repeated = written(known.where("copies > 1"), "repeated-payloads")
    joined = join_on_content(rows, repeated, "digest", "copies", spread_by="page_id")
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(large & (F.col("first_page") < F.col("page_id")), F.col("first_page")).alias("refers_to")
    )


def _shards(pages: DataFrame, shard_bytes: int, least: int) -> Column:
    """The number of a row's range of ids, the ranges being about equally heavy.

    Exact sums over equal slices of the span of ids decide, so the ranges are the
    same every time; at most ``_BINS`` of them reach the driver.
    """
    ends = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if ends["low"] is None:
        return F.lit(0)
    width = (ends["high"] - ends["low"]) // _BINS + 1
    bin_of = F.coalesce(F.floor((F.col("page_id") - F.lit(ends["low"])) / F.lit(width)), F.lit(0)).cast("int")
    weights = {r["bin"]: r["w"] for r in pages.groupBy(bin_of.alias("bin")).agg(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + 500).alias("w")).collect()}
    limit = max(1, min(shard_bytes, sum(weights.values()) // least))
    shard, held, starts = 0, 0, []
    for b in sorted(weights):
        if held + weights[b] > limit and held:
            shard, held = shard + 1, 0
            starts.append(b)
        held += weights[b]
    if not starts:
        return F.lit(0)
    numbers, at = [], 0
    for b in range(_BINS):
        while at < len(starts) and starts[at] <= b:
            at += 1
        numbers.append(at)
    return F.element_at(F.lit(numbers), F.least(bin_of, F.lit(_BINS - 1)) + 1)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return _CRLF.join(lines) + _CRLF + _CRLF


def _uri(url: str | None) -> str | None:
    """A URL for a header line: what could end the line is percent-encoded."""
    if url is None:
        return None
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, headers and digests made from its content."""
    revisit = refers_to is not None
    length = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("X-Refers-To-Page", refers_to),
        ("X-Page", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + _CRLF + _CRLF


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return _header(fields) + block + _CRLF + _CRLF


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> DataFrame:
    """Write ``pages`` (see ``prepare``) and return the manifest: folder, path, shard, number, records, bytes, sha256 per file.

    Rows are sorted by (page_id, url, digest), nulls first; the manifest is also
    written to ``folder``/manifest, last of all: an archive without it is not
    complete.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 200)
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    # More shards than slots, so that they even out; a cluster's many slots ask for as many shards.
    narrow = plain(pages, page_id=id_column, payload=payload_column).withColumn("page_id", F.col("page_id").cast("long"))
    shard_of = _shards(narrow, shard_bytes, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = prepare(pages, id_column, url_column, payload_column).withColumn("shard", shard_of).repartition("shard").sortWithinPartitions("shard", "page_id", "url", "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        attempt = f"{base}/_temporary/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        shard, number, out, name, temporary = None, 0, None, "", ""
        records, size, check = 0, 0, hashlib.sha256()
        done: list[dict] = []

        def put(data: bytes) -> None:
            nonlocal size
            packed = gzip.compress(data, 6, mtime=0)
            out.write(packed)
            check.update(packed)
            size += len(packed)

        def close() -> None:
            out.close()
            done.append({"path": f"{base}/{name}", "temporary": temporary, "shard": shard, "number": number,
                         "records": records, "bytes": size, "sha256": check.hexdigest()})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "refers_to")]
            for at, page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                if out is None or at != shard or size >= roll_bytes:
                    if out is not None:
                        close()
                    number = number + 1 if out is not None and at == shard else 0
                    shard, records, size, check = at, 0, 0, hashlib.sha256()
                    name = f"part-{shard:05d}-{number:05d}.warc.gz"
                    temporary = f"{attempt}/{name}"
                    out = store.open_output_stream(temporary, compression=None)
                    put(_info(name))
                put(record(page_id, url, payload, digest, refers_to))
                records += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    reported = written(placed.mapInArrow(write, _manifest_ddl()), "warc-files")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if store.get_file_info(old).type == fs.FileType.File:  # else an earlier attempt has renamed it
                    store.move(old, new)
            yield batch

    committed = written(reported.mapInArrow(commit, _manifest_ddl()).drop("temporary"), "warc-committed")
    committed.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(committed.schema).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


_MANIFEST = pa.schema(
    [("path", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("number", pa.int32()),
     ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)


def _manifest_ddl() -> str:
    return "path string, temporary string, shard int, number int, records bigint, bytes bigint, sha256 string"


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC file's gzip members, streamed."""
    inflate = zlib.decompressobj(31)
    member = bytearray()
    for piece in data:
        while piece:
            member += inflate.decompress(piece)
            piece = b""
            if inflate.eof:
                piece = inflate.unused_data
                inflate = zlib.decompressobj(31)
                head, _, rest = bytes(member).partition(_CRLF + _CRLF)
                lines = head.split(_CRLF)
                if lines[0] != b"WARC/1.1":
                    raise ValueError("not a WARC/1.1 record")
                headers = dict(x.decode().split(": ", 1) for x in lines[1:])
                yield headers, rest[: int(headers["Content-Length"])]
                member = bytearray()
    if member:
        raise ValueError("a WARC file ends within a record")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every response and revisit record of the manifest's files, digests checked.

    Columns: page_id, url, record_type, refers_to, payload_bytes (of the full payload),
    payload_digest, payload (null for revisits). A digest that does not agree fails.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in parse(iter(lambda s=source: s.read(1 << 20), b"")):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        held.append(_row(headers, block, path))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_READ)

    slots = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "path").repartition(slots, "path").mapInArrow(
        read, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    )


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _row(headers: dict[str, str], block: bytes, path: str) -> dict:
    if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"{path}: a block's digest does not agree")
    http, _, payload = block.partition(_CRLF + _CRLF)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{path}: a payload's digest does not agree")
    length = next(int(x.split(b":")[1]) for x in http.split(_CRLF) if x.lower().startswith(b"content-length:"))
    page, refers = headers.get("X-Page"), headers.get("X-Refers-To-Page")
    return {
        "page_id": None if page in (None, "None") else int(page),
        "url": headers.get("WARC-Target-URI"),
        "record_type": headers["WARC-Type"],
        "refers_to": int(refers) if refers is not None else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read the archives back."""
    return read_archives(write_archives(pages, folder))
