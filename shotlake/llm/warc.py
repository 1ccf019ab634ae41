"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards of near equal payload bytes (splitters by histogram sort, so they depend
on the data alone). Each shard's task writes gzip members, one a record, and rolls to a new file once a file's compressed
size reaches the limit. Headers, record ids and digests are made anew from the row, with no clock and no random part, so
the same rows give the same bytes. A task writes under temporary names of its own attempt and reports its files as rows;
the table of those rows, committed by Spark, says which attempts count. Then the files are renamed and the manifest is
written last: an archive without one is not complete, and files that no manifest lists are not read.

Of records with equal payloads of at least REVISIT_BYTES the one of the largest page id is the response; the others are
revisits that refer to it and carry no payload.

Defined results: a null payload counts as empty; a null page id sorts first, has no id header and reads back as null; of
rows equal in page id and payload each gives a record (all are responses if their id is the largest); a url with characters
that no URI has is percent-encoded and decoded again on reading, any other is written as it is; a null or empty url is
replaced by a urn and reads back as null; an empty table gives an archive without files; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, remove, written
from .sharding import range_of, splitters

#: Least payload that is deduplicated.
REVISIT_BYTES = 1000
#: Payload bytes of a shard, and compressed bytes at which a file is full.
SHARD_BYTES, FILE_BYTES = 32_000_000, 8_000_000
#: Most shards. Beyond so many times SHARD_BYTES shards grow: a task streams its shard, so its memory does not.
MAX_SHARDS = 4096
#: Characters of a URI.
_URI = re.compile(r"[A-Za-z0-9%/:?#\[\]@!$&'()*+,;=\-._~]+")
#: The date of all records: pages carry none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes that the reader takes at a time.
_CHUNK = 16_384
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FILES = "shard int, part int, temporary string, name string, records long, bytes long, sha1 string"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def fetched(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))


def referred(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, digest, refers_to (null for responses) of fetched(), without payloads."""
    rows = rows.select("page_id", "payload_bytes", "digest")
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    rows = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "payload_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    plain = bool(url) and _URI.fullmatch(url) is not None
    uri = url if plain else quote(url, safe="/:?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {base32(digest)}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {n}",
    ]
    if not plain:
        head.append(f"X-URL: {'encoded' if url else 'none'}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file of gzip members; both digests are checked."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, data = zlib.decompressobj(31), bytearray()
        while not z.eof:
            if at >= len(view):
                raise ValueError("the file ends within a record")
            data += z.decompress(view[at : at + _CHUNK])
            at = min(at + _CHUNK, len(view)) - len(z.unused_data)
        data = bytes(data)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if base32(hashlib.sha1(block).hexdigest()) != fields["warc-block-digest"] or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("damaged record")
        yield fields, block


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages under path and returns the manifest: shard, part, name, records, bytes, sha1 of each file."""
    from pyarrow import fs

    spark = pages.sparkSession
    rows = fetched(pages, id, url, html)
    lowest = F.lit(-(2**63))
    told = written(referred(rows), "warc-keys")
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + 500
    keys = told.select(F.coalesce("page_id", lowest).alias("h"), F.xxhash64("digest").alias("doc_id"), size.cast("long").alias("size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = min(MAX_SHARDS, max(1, -(-total // shard_bytes)))
    cuts = splitters(keys, n, 0.05)
    # what a page refers to travels to its shard as a row of its own, before the page: payloads are exchanged once
    verdicts = told.where("refers_to IS NOT NULL").distinct().select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "payload_bytes", "digest", "refers_to")
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(verdicts)
    shard = range_of(F.coalesce("page_id", lowest), F.xxhash64("digest"), cuts)
    placed = both.withColumn("shard", shard).repartitionById(n, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, files, out, at, page, target = uuid.uuid4().hex, [], None, None, None, None
        there, folder = fs.FileSystem.from_uri(path)
        there.create_dir(f"{folder}/_tmp", recursive=True)

        def close():
            if out is not None:
                out.close()
                files[-1]["sha1"] = sha.hexdigest()

        for batch in batches:
            for r in batch.to_pylist():
                if r["refers_to"] is not None:
                    page, target = (r["page_id"], r["digest"]), r["refers_to"]
                    continue
                if (r["page_id"], r["digest"]) == page:
                    r |= {"refers_to": target, "payload": None}
                if r["shard"] != at or files[-1]["bytes"] >= file_bytes:
                    close()
                    part = files[-1]["part"] + 1 if r["shard"] == at else 0
                    at, name = r["shard"], f"{r['shard']:06d}-{part:04d}.warc.gz"
                    files.append({"shard": at, "part": part, "temporary": f"_tmp/{attempt}-{name}", "name": name, "records": 0, "bytes": 0, "sha1": ""})
                    out, sha = there.open_output_stream(f"{folder}/{files[-1]['temporary']}", compression=None), hashlib.sha1()
                if r["refers_to"] is None and hashlib.sha1(r["payload"]).hexdigest() != r["digest"]:
                    raise ValueError(f"payload of page {r['page_id']} changed on its way")
                data = member(record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["digest"], r["refers_to"]))
                out.write(data)
                sha.update(data)
                files[-1]["records"] += 1
                files[-1]["bytes"] += len(data)
        close()
        names = ["shard", "part", "temporary", "name", "records", "bytes", "sha1"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], t) for k, t in zip(names, types, strict=True)], names=names)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for f in batch.to_pylist():
                old, new = f"{folder}/{f['temporary']}", f"{folder}/{f['name']}"
                if there.get_file_info(old).type != fs.FileType.NotFound:
                    there.move(old, new)
                elif there.get_file_info(new).size != f["bytes"]:  # an earlier attempt of this task may have renamed it
                    raise FileNotFoundError(old)
            yield batch

    placed.mapInArrow(run, _FILES).write.parquet(f"{path}/_pending")
    pending = spark.read.schema(_FILES).parquet(f"{path}/_pending")
    pending.mapInArrow(commit, _FILES).drop("temporary").write.parquet(f"{path}/manifest")
    remove(spark, f"{path}/_tmp")
    remove(spark, f"{path}/_pending")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{path}/manifest").drop("temporary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the files that the manifest lists; payload is null for revisits. Files are at most a record
    longer than the writer's limit, so a task holds a few of them."""
    listed = read_manifest(spark, path).select("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("name"), "content").join(listed, "name", "left_semi").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_py()):
                    rows.append(_row(fields, block))
                    held += len(block)
                    if held > 4_000_000 or len(rows) >= 10_000:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    return files.mapInArrow(run, _RECORDS)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["x-payload-length"])):
        raise ValueError("payload and its digest differ")
    number = lambda k: int(fields[k]) if k in fields else None
    uri, how = fields["warc-target-uri"], fields.get("x-url")
    url = None if how == "none" else unquote(uri) if how == "encoded" else uri
    return number("x-page-id"), url, kind, number("x-refers-to-page-id"), int(fields["x-payload-length"]), digest, payload


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records of pages after they were written to a fresh folder of the shared one and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id, url, html)
    return read_archives(pages.sparkSession, path)
