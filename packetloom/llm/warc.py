"""WARC archives: a deterministic sharded writer, and a reader.

Writing: a histogram of page ids, weighed by payload bytes and finer where ids are dense, cuts the ids into shards of like size, so that
shards and files depend on the rows alone and not on how Spark happened to partition or sample them. Each shard is one task's, sorted
by id; it appends one gzip member a record and starts a new file when the compressed size would pass `file_bytes`, by default a
sixteenth of a shard's payload, so that a shard rolls through several files.
Headers and SHA-1 digests are made anew. Files are written under temporary names that no two attempts share; the manifest,
a Parquet table that only successful attempts get into, says which of them count; then they are renamed, and at last the
manifest gets its own name. A reader reads what the manifest names, so an archive is there whole or not at all.

Records with equal payloads of at least `revisit_bytes` bytes are written once: the row with the largest page id is the
response, the others are revisits of it that hold no payload. Rows that share that id are responses all.
Null ids come first and count as smallest; null payloads are empty; null URLs are named by their id. Payloads are equal if their SHA-1 digests are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup_join

DATE = "1970-01-01T00:00:00Z"
MANIFEST, TEMPORARY = "_manifest", "_temporary"
#: Slots of the histogram for each shard, and into how many a slot is cut that holds more than half a shard.
SLOTS, FINER = 8, 32


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Of a path as Spark writes it: with a scheme, or local."""
    if m := re.match(r"file:/+(.*)", uri):
        return fs.LocalFileSystem(), "/" + m[1]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _sha1(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without its payload; digest is that of the full payload, in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~') if url else name[1:-1]}",
        f"WARC-Payload-Digest: {_sha1(digest)}", f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).hexdigest())}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name: equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """The open file of a shard."""

    def __init__(self, out: str, shard: int, file_bytes: int, level: int):
        self.where, self.root = open_fs(out)
        self.shard, self.limit, self.level, self.seq, self.file = shard, file_bytes, level, 0, None

    def add(self, data: bytes):
        member = _member(data, self.level)
        if self.file and self.size + len(member) > self.limit:
            yield self.close()
        if not self.file:
            self.temp = f"{TEMPORARY}/{self.shard:06d}-{self.seq:05d}.{uuid.uuid4().hex}"
            self.file = self.where.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            info = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.shard:06d}-{self.seq:05d}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            self._put(_member(info.encode(), self.level))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes):
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> dict:
        self.file.close()
        self.file = None
        row = {"file": f"{self.shard:06d}-{self.seq:05d}.warc.gz", "temp": self.temp, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}
        self.seq += 1
        return row


MANIFEST_SCHEMA = "file string, temp string, records long, bytes long, sha256 string"


def _writer(out: str, file_bytes: int, level: int):
    """Sorted by shard, id, digest, kind: a row of kind 0 says what the pages after it, with its id and digest, refer to."""

    def run(batches):
        roller, refers = None, {}
        done: list[dict] = []

        def flush():
            nonlocal done
            rows, done = done, []
            return pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("temp", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for r in whole.slice(at, 256).to_pylist():
                    if roller is None or r["shard"] != roller.shard:
                        if roller and roller.file:
                            done.append(roller.close())
                        roller, refers = _Roller(out, r["shard"], file_bytes, level), {}
                    if r["kind"] == 0:
                        refers = {(r["page_id"], r["digest"]): r["refers_to"]}
                        continue
                    to = refers.get((r["page_id"], r["digest"]))
                    kind = "response" if to is None else "revisit"
                    done.extend(roller.add(record(kind, r["page_id"], r["url"], r["payload"], r["digest"], to)))
                if done:
                    yield flush()
        if roller and roller.file:
            done.append(roller.close())
        if done:
            yield flush()

    return run


def _rename(out: str):
    """Each temporary file to its name; done again, it does nothing."""

    def run(batches):
        where, root = open_fs(out)
        for batch in batches:
            for r in batch.to_pylist():
                if where.get_file_info(f"{root}/{r['temp']}").type != fs.FileType.NotFound:
                    where.move(f"{root}/{r['temp']}", f"{root}/{r['file']}")
                elif where.get_file_info(f"{root}/{r['file']}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{r['temp']} is gone before it was renamed")
            yield batch

    return run


def _index_in(starts: list[int], spark: SparkSession):
    """A function of a column of ids: the number of the last start at or before each; null ids come first."""
    held = spark.sparkContext.broadcast(np.array(starts, np.int64))

    @F.arrow_udf("int")
    def of(ids: pa.Array) -> pa.Array:
        at = np.asarray(ids.fill_null(int(held.value[0])), np.int64)
        return pa.array(np.maximum(np.searchsorted(held.value, at, side="right") - 1, 0), pa.int32())

    return of


def _starts(known: DataFrame, total, shards: int) -> tuple[list[int], int]:
    """The least id of each shard that has pages, and how many slots were counted at most.

    Slots are of equal width at first, SLOTS for each shard; one that holds more than half a shard is cut again, so an id far from all others
    makes no large shard. No more than 2 * shards slots can be that large at a time, however many pages there are."""
    low, high = int(total.low or 0), int(total.high or 0)
    width = max(1, -(-(high - low + 1) // (SLOTS * shards)))
    slots, most = [(at, width) for at in range(low, high + 1, width)], 0
    while True:
        of = _index_in([at for at, _ in slots], known.sparkSession)
        sums = known.groupBy(of("page_id").alias("slot")).agg(F.sum("size").alias("size"))
        sizes = {slots[r.slot][0]: r["size"] for r in sums.collect()}
        most = max(most, len(slots))
        large = {at for at, n in sizes.items() if 2 * n * shards > total["size"]}
        if not any(at in large and width > 1 for at, width in slots):
            break
        finer = []
        for at, width in slots:
            if at not in sizes:
                continue  # nothing is there
            step = -(-width // FINER) if at in large else width
            finer += [(x, min(step, at + width - x)) for x in range(at, at + width, step)]
        slots = [(low, 1), *finer] if finer[0][0] > low else finer
    starts, before, last = [], 0, -1
    for at in sorted(sizes):
        shard = min(shards - 1, before * shards // max(1, total["size"] or 0))
        if shard != last:
            starts.append(at)
        before, last = before + sizes[at], shard
    return starts or [low], most


def write(
    pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000,
    file_bytes: int | None = None, shard_bytes: int = 32 << 20, max_shards: int = 1 << 16, level: int = 3,
) -> DataFrame:
    """Write pages as records to the folder `out`, which must be new and which all machines share. Returns the manifest.

    A shard has some shard_bytes of payload; where that would make more than max_shards, some dozens of whose slots the driver holds for each, they are as much
    larger. A page is never cut, and pages with the same id stay together. Null ids come first; null payloads are empty; null URLs
    are named by their id; rows that repeat are records that repeat. No pages give an archive of no file. Other columns are not read."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    known = cut(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    shards = max(1, min(max_shards, -(-(total["size"] or 0) // shard_bytes)))
    file_bytes = file_bytes or max(1 << 20, (total["size"] or 0) // shards // 16)
    starts, _ = _starts(known, total, shards)
    shard = _index_in(starts, spark)

    large = known.filter(F.col("size") >= revisit_bytes)
    first = cut(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null"))
    revisits = lookup_join(large.select("page_id", "digest"), first, "digest", "n", total.n).filter("not page_id <=> refers_to").distinct()

    def placed(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumns({"shard": shard("page_id"), "kind": F.lit(kind)})

    told = placed(revisits, 0).select("shard", "page_id", "digest", "kind", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    wide = placed(rows, 1).select("shard", "page_id", "digest", "kind", F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    where, root = open_fs(out)
    where.create_dir(f"{root}/{TEMPORARY}", recursive=True)
    dealt = told.unionByName(wide).repartitionById(len(starts), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = dealt.mapInArrow(_writer(out, file_bytes, level), MANIFEST_SCHEMA)
    manifest.write.parquet(f"{out}/{MANIFEST}.tmp")
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/{MANIFEST}.tmp")
    manifest.mapInArrow(_rename(out), MANIFEST_SCHEMA).write.format("noop").mode("overwrite").save()
    where.move(f"{root}/{MANIFEST}.tmp", f"{root}/{MANIFEST}")
    where.delete_dir(f"{root}/{TEMPORARY}")  # with what lost attempts have left
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/{MANIFEST}")


# --- reading --------------------------------------------------------------------------------------------------


class _Members:
    """The decompressed bytes of a .gz file of many members, as a stream."""

    def __init__(self, raw):
        self.raw, self.z, self.rest = raw, zlib.decompressobj(31), b""

    def read(self) -> bytes:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 18)
            self.rest = b""
            if not data:
                return b""
            if got := self.z.decompress(data):
                return got


def _take(stream: _Members, held: bytearray, n: int) -> bytes:
    while len(held) < n:
        if not (got := stream.read()):
            raise EOFError("a record ends too early")
        held += got
    out = bytes(held[:n])
    del held[:n]
    return out


def records(raw):
    """Header (names in lower case) and block of each record of an open .warc.gz file."""
    stream, held = _Members(raw), bytearray()
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not (got := stream.read()):
                if held.strip():
                    raise EOFError("a header ends too early")
                return
            held += got
        head = _take(stream, held, end + 4).decode()
        lines = head.strip("\r\n").split("\r\n")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = _take(stream, held, int(header["content-length"]))
        _take(stream, held, 4)
        yield header, block


def _page(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records that the manifest of `out` names. payload_bytes and payload_digest are of the full
    payload: of a response's own bytes, of a revisit what its headers say; payload is null for revisits. A null id is read as null, a null URL as the name
    that stands for it, a null payload as no bytes; an archive of no file gives no rows."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def parse(batches):
        where, root = open_fs(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with where.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 18) as raw:
                    for header, block in records(raw):
                        kind = header["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = base64.b32decode(header["warc-payload-digest"].partition(":")[2]).hex()
                        if kind == "response":
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if digest != told:
                                raise OSError(f"{name}: the payload of {header['warc-record-id']} doesn't have its digest")
                        else:
                            n, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), told
                        rows.append({
                            "page_id": _page(header["warc-record-id"]), "url": header.get("warc-target-uri"), "record_type": kind, "payload_bytes": n, "payload_digest": digest,
                            "refers_to": _page(header["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if with_payload and kind == "response" else None,
                        })
                        size += len(block) if with_payload else 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/{MANIFEST}").select("file")
    n = max(1, min(files.count(), 10 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(parse, READ_SCHEMA)


def round_trip(pages: DataFrame, out: str, **options) -> DataFrame:
    """Write pages to `out` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, a row for each of pages. Nulls, ties, repeated rows and no rows
    are as write() says."""
    write(pages, out, **options)
    return read(pages.sparkSession, out, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
