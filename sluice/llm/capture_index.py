"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so any record can be read by a range. Of
records with equal payloads the one with the largest id is a response, the
others are revisits that refer to it and carry no payload.

Index: captures are range-partitioned and sorted by reversed-host URL key and id.
Each partition is a shard: lines in gzip blocks of BLOCK_LINES, and a sparse
directory with the first key and byte range of each block. The list of shards, one
row per partition, is the only part the driver holds. A look-up bisects the list
of shards, then the shard's directory, then the lines of one block, and reads the
record's range.

Files are written by tasks into the shared folder under names of their own per
attempt. Only the rows a successful attempt returns refer to a file, so lost
executors leave unused files at worst.

Defined cases: a null payload is empty; a null or hostless URL has the key of the
empty host and no target URI; control characters and blanks are escaped in keys
and headers; a null id sorts first and never is what others refer to (records of
null ids only are all responses); repeated rows give one record each; empty tables
give an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, new_path, qualified
from .wordbytes import trimmed

BLOCK_LINES = 512
ROLL_BYTES = 256 << 20
BROADCAST_DIGESTS = 500_000
MAX_SHARDS = 50_000
_NO_ID = -(2**63)
CAPTURES = "id long, key string, digest string, record_type string, file string, offset long, length long"
RECORDS = "id long, key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SCHEMA_CAPTURES = pa.schema([("id", pa.int64()), ("key", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str) -> Column:
    """Reversed host, closing bracket, then path and query: example.org/a is org,example)/a."""
    c = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_replace(F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"^www\.|\.+$", "")
    rest = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^#]*)", 1)
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20\x7F]", "%20")


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, response or (with refers_to) revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers in lower case, the HTTP header's content length, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return {"fields": fields, "stated": stated, "payload": payload}


def _number(record_uri: str | None) -> int | None:
    last = (record_uri or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def _gzip(raw: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _archive_writer(path: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(path)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            ids, urls, html = (batch.column(c).to_pylist() for c in ("id", "url", "payload"))
            keys, digests, refers = (batch.column(c).to_pylist() for c in ("key", "sha", "refers_to"))
            for i, url, text, key, sha, to in zip(ids, urls, html, keys, digests, refers, strict=True):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest = _base32(sha)
                member = _gzip(warc_record(i, url, text.encode(), digest, to))
                out.write(member)
                rows.append((i, key, digest, "response" if to is None else "revisit", name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, _SCHEMA_CAPTURES, strict=True)], schema=_SCHEMA_CAPTURES)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every row's record; returns the captures (written once, so files are, too)."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    digest = F.sha1(F.col("payload").cast("binary"))
    equal = rows.where(F.octet_length("payload") >= min_bytes).select("id", digest.alias("sha")).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    equal = cut(equal.where("n > 1 AND last IS NOT NULL").select("sha", "last"), "digests")
    # A counted, small table of repeated digests saves the payloads a shuffle.
    known = F.broadcast(equal) if equal.count() <= BROADCAST_DIGESTS else equal
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("last")), F.col("last"))
    told = rows.withColumn("sha", digest).withColumn("key", url_key("url")).join(known, "sha", "left").withColumn("refers_to", refers)
    return cut(told.select("id", "url", "payload", "key", "sha", "refers_to").mapInArrow(trimmed(_archive_writer(path, roll_bytes)), CAPTURES), "captures")


def _index_writer(path: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(path)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        out, at, lines, directory, first, last, total = None, 0, [], [], None, None, 0

        def flush() -> None:
            nonlocal at, lines
            block = _gzip("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append(f"{first_of_block[0]}\t{first_of_block[1]}\t{at}\t{len(block)}\t{len(lines)}")
            at += len(block)
            lines = []

        first_of_block = ("", 0)
        for batch in batches:
            for key, i, digest, kind, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "sort_id", "digest", "record_type", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                    first = (key, i)
                if not lines:
                    first_of_block = (key, i)
                lines.append(f"{key}\t{i}\t{digest}\t{kind}\t{file}\t{offset}\t{length}")
                last = (key, i)
                total += 1
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
            idx.write("\n".join(directory).encode())
        cols = [[name], [first[0]], [first[1]], [last[0]], [last[1]], [total]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "first_key", "first_id", "last_key", "last_id", "lines"])

    return run


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into shards of compressed blocks with their directories; returns the list of shards."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = captures.withColumn("sort_id", F.coalesce("id", F.lit(_NO_ID)))
    # File and offset only make places distinct, so that equal keys and ids may be dealt to several shards.
    ordered = keyed.repartitionByRange(n, "key", "sort_id", "file", "offset").sortWithinPartitions("key", "sort_id", "file", "offset")
    return cut(ordered.mapInArrow(_index_writer(path, block_lines), "shard string, first_key string, first_id long, last_key string, last_id long, lines long"), "shards")


def _locator(lows: list[tuple[bytes, int]], highs: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, i in zip(batch.column("key").to_pylist(), batch.column("sort_id").to_pylist(), strict=True):
                wanted = (key.encode(), i)
                at = bisect.bisect_left(highs, wanted)
                while at < len(lows) and lows[at] <= wanted:
                    out.append((at, key, i))
                    at += 1
            cols = [[x[j] for x in out] for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["at", "key", "sort_id"])

    return run


class _Shard:
    """A shard's directory, and the lines of its last block read."""

    def __init__(self, fs, base: str, name: str) -> None:
        with fs.open_input_file(f"{base}/{name}.idx") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        self.firsts = [(r[0].encode(), int(r[1])) for r in rows]
        self.ranges = [(int(r[2]), int(r[3])) for r in rows]
        self.file = fs.open_input_file(f"{base}/{name}.cdx.gz")
        self.block, self.lines = -1, []

    def read(self, block: int) -> None:
        if block != self.block:
            offset, length = self.ranges[block]
            raw = zlib.decompress(self.file.read_at(length, offset), 31).decode()
            self.lines = [(x[0].encode(), int(x[1]), *x[2:]) for x in (y.split("\t") for y in raw.split("\n"))]
            self.block = block

    def find(self, key: str, i: int) -> list[tuple]:
        """The lines of a key and id: blocks by bisection of the directory, lines by bisection of the block."""
        wanted, found = (key.encode(), i), []
        block = max(bisect.bisect_left(self.firsts, wanted) - 1, 0)
        while block < len(self.firsts) and self.firsts[block] <= wanted:
            self.read(block)
            at = bisect.bisect_left(self.lines, wanted, key=lambda x: x[:2])
            while at < len(self.lines) and self.lines[at][:2] == wanted:
                found.append(self.lines[at])
                at += 1
            block += 1
        return found


def _reader(names: list[str], index_path: str, archive_path: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(index_path)
        afs, abase = _filesystem(archive_path)
        shard, at = None, -1
        files: dict[str, object] = {}
        for batch in batches:
            lines = []
            for n, key, i in zip(*(batch.column(c).to_pylist() for c in ("at", "key", "sort_id")), strict=True):
                if n != at:
                    shard, at = _Shard(fs, base, names[n]), n
                lines += shard.find(key, i)
            cols: list[list] = [[] for _ in range(7 + with_payload)]
            for key, i, digest, kind, file, offset, length in sorted(lines, key=lambda x: (x[4], int(x[5]))):
                if file not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[file] = afs.open_input_file(f"{abase}/{file}")
                record = parse_record(zlib.decompress(files[file].read_at(int(length), int(offset)), 31))
                fields, payload = record["fields"], record["payload"]
                stated = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated or stated != digest:
                    raise ValueError(f"record {file}:{offset} does not have its digest")
                size = len(payload) if kind == "response" else record["stated"]
                values = [None if i == _NO_ID else i, key.decode(), fields.get("warc-target-uri"), size, stated, fields["warc-type"], _number(fields.get("warc-refers-to"))]
                for c, v in zip(cols, [*values, payload] if with_payload else values, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
            names_out = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names_out)
        for f in files.values():
            f.close()

    return run


def look_up(requests: DataFrame, shards: DataFrame, index_path: str, archive_path: str, with_payload: bool = False) -> DataFrame:
    """The records of the requested (key, id) pairs, each capture once.

    Requests are sorted by shard and key, so each task walks its blocks in order
    and holds one block at a time.
    """
    top = sorted((r["first_key"].encode(), r["first_id"], r["last_key"].encode(), r["last_id"], r["shard"]) for r in shards.limit(MAX_SHARDS + 1).collect())
    if len(top) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards: build the index with fewer partitions")
    lows, highs, names = [x[:2] for x in top], [x[2:4] for x in top], [x[4] for x in top]
    wanted = requests.select("key", F.coalesce("id", F.lit(_NO_ID)).alias("sort_id")).distinct()
    placed = wanted.mapInArrow(_locator(lows, highs), "at int, key string, sort_id long")
    dealt = placed.repartition(max(len(top), 1), "at").sortWithinPartitions("at", "key", "sort_id")
    return dealt.mapInArrow(trimmed(_reader(names, index_path, archive_path, with_payload)), RECORDS + (", payload binary" if with_payload else ""))


def archive_round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write archives and index, then read every page's record back through the index."""
    spark: SparkSession = pages.sparkSession
    path = path or new_path(spark, "warc")
    path = qualified(spark, path)
    captures = write_archives(pages, f"{path}/archive", id, url, payload, min_bytes)
    shards = build_index(captures, f"{path}/index")
    return look_up(pages.select(F.col(id).cast("long").alias("id"), url_key(url).alias("key")), shards, f"{path}/index", f"{path}/archive")
