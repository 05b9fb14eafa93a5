"""WARC archives with a two-level capture index.

Records are written as gzip members into one archive per partition. Of captures with equal payloads of
`LEAST` bytes or more the one with the least id is a response; the others are revisit records without
payload that name it. Smaller payloads are all responses.

The index has one line per capture: reversed-host key, id, archive, offset, length. Lines are range
partitioned and sorted by (key, id); each part is a file of gzip blocks of `LINES` lines, with a sparse
directory beside it that holds the first (key, id) of each block. Parts themselves are found in a list
of one entry each. A lookup thus takes two binary searches, one range read of a block and one range read
of the record. Equal keys are told apart by id, so a hot URL or host costs no more than another.

Archives lie in a folder that pyarrow.fs reaches (file:, s3:, gs:, hdfs:); names are unique to each task
attempt, and the index names the file that the same attempt wrote, so a lost executor leaves no mix.

Defined results: a null payload is empty; a null URL has the empty key; a null id sorts last and its
records have no number. Captures that share an id and a payload of the least id are all responses.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, new_path, small_batches

LEAST, LINES, LEVEL = 100, 1000, 4
DATE = "2024-01-01T00:00:00Z"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def url_key(url: Column) -> Column:
    """Reversed host, port and path: com,example,www)/a?b=c. What is no URL is its own key."""
    host = F.lower(F.regexp_extract(url, _URL + r"([^/:?#]*)", 1))
    port = F.regexp_extract(url, _URL + r"[^/:?#]*(:[0-9]+)", 1)
    rest = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    path = F.when(F.left(rest, F.lit(1)) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path)
    return F.coalesce(F.when(url.rlike(_URL + "[^/?#]"), key).otherwise(url), F.lit(""))


def captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, bytes, first: the id of the response that a revisit refers to, else null."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    known = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.when(~F.col("least").eqNullSafe(F.col("id")), F.col("least"))
    return rows.join(known, "digest", "left").select("id", "url", "payload", "digest", "bytes", first.alias("first"))


def record(id_: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-capture:{'' if id_ is None else id_}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:x-capture:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if first is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def gz(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write_archives(rows: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write captures() as archives into the folder; one index row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"capture-{uuid.uuid4().hex}.warc.gz"
        at = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                offsets, lengths = [], []
                for r in batch.to_pylist():
                    raw = gz(record(r["id"], r["url"], r["payload"].encode(), r["digest"], r["first"], date))
                    out.write(raw)
                    offsets.append(at)
                    lengths.append(len(raw))
                    at += len(raw)
                n = batch.num_rows
                yield pa.record_batch([batch.column(0), batch.column(batch.num_columns - 1), pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["id", "key", "file", "offset", "length"])

    return rows.withColumn("key", url_key(F.col("url"))).mapInArrow(run, "id long, key string, file string, offset long, length long")


def _ordered(rows: DataFrame) -> DataFrame:
    order = [F.col("key"), F.col("id").isNull(), F.col("id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_index(rows: DataFrame, folder: str) -> DataFrame:
    """Sorted compressed blocks and their directories; one row for each part: first and last entry, file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"index-{uuid.uuid4().hex}"
        at, directory, last, lines = 0, [], None, []
        with store.open_output_stream(f"{base}/{name}.cdxj.gz", compression=None) as out:

            def flush() -> None:
                nonlocal at, lines, last
                raw = gz("".join(json.dumps(x) + "\n" for x in lines).encode())
                out.write(raw)
                directory.append([lines[0][:3], at, len(raw)])
                at, last, lines = at + len(raw), lines[-1][:3], []

            for batch in batches:
                for r in batch.to_pylist():
                    lines.append([r["key"], r["id"] is None, r["id"] or 0, r["file"], r["offset"], r["length"]])
                    if len(lines) == LINES:
                        flush()
            if lines:
                flush()
        if directory:
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as out:
                out.write(json.dumps(directory).encode())
            yield pa.record_batch([pa.array([json.dumps(x)], pa.string()) for x in (directory[0][0], last)] + [pa.array([name], pa.string())], ["first", "last", "name"])

    return _ordered(rows).mapInArrow(run, "first string, last string, name string")


class Reader:
    """Finds records of an archive folder; keeps a few directories, blocks and open files."""

    def __init__(self, folder: str, parts: list[tuple[list, list, str]], keep: int = 32) -> None:
        self.store, self.base = pafs.FileSystem.from_uri(folder)
        self.parts = parts
        self.last = [p[1] for p in parts]
        self.keep = keep
        self.cache: OrderedDict = OrderedDict()

    def _kept(self, what: tuple, make) -> object:
        if what in self.cache:
            self.cache.move_to_end(what)
        else:
            self.cache[what] = make()
            if len(self.cache) > self.keep:
                self.cache.popitem(last=False)
        return self.cache[what]

    def _open(self, name: str) -> pa.NativeFile:
        return self._kept(("file", name), lambda: self.store.open_input_file(f"{self.base}/{name}"))

    def _directory(self, name: str) -> list:
        def make() -> list:
            with self.store.open_input_file(f"{self.base}/{name}.dir") as f:
                return json.loads(f.read())

        return self._kept(("dir", name), make)

    def _block(self, name: str, at: int, size: int) -> list:
        def make() -> list:
            raw = zlib.decompress(self._open(f"{name}.cdxj.gz").read_at(size, at), 31)
            return [json.loads(x) for x in raw.split(b"\n") if x]

        return self._kept(("block", name, at), make)

    def lines(self, key: str, id_: int | None) -> Iterator[list]:
        """Index lines of a capture."""
        want = [key, id_ is None, id_ or 0]
        for first, _, name in self.parts[bisect.bisect_left(self.last, want) :]:
            if first > want:
                return
            directory = self._directory(name)
            at = max(0, bisect.bisect_left([d[0] for d in directory], want) - 1)
            for start, offset, size in directory[at:]:
                if start > want:
                    return
                block = self._block(name, offset, size)
                i = bisect.bisect_left(block, want, key=lambda x: x[:3])
                while i < len(block) and block[i][:3] == want:
                    yield block[i]
                    i += 1

    def record(self, line: list) -> bytes:
        return zlib.decompress(self._open(line[3]).read_at(line[5], line[4]), 31)


def lookup(spark: SparkSession, folder: str, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the wanted captures (key, id): id, payload_bytes, payload_digest, record_type, refers_to."""
    # One entry for each part of the index, not for each capture.
    known = spark.sparkContext.broadcast(sorted((json.loads(r["first"]), json.loads(r["last"]), r["name"]) for r in parts.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, known.value)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for line in reader.lines(r["key"], r["id"]):
                    fields, http, payload = parse(reader.record(line))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    refers = int(fields["WARC-Refers-To"].removeprefix("<urn:x-capture:").rstrip(">")) if revisit else None
                    out.append((r["id"], int(http["Content-Length"]) if revisit else len(payload), digest, fields["WARC-Type"], refers))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _ordered(wanted.select("key", "id")).mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write archives and index; returns the folder and the list of index parts."""
    small_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    index = materialize(write_archives(captures(pages, id_col, url_col, payload_col), folder), "captures")
    return folder, materialize(write_index(index, folder), "parts")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive the pages and read each back through the index: one row for each page."""
    folder, parts = archive(pages, id_col, url_col, payload_col)
    wanted = pages.select(url_key(F.col(f"`{url_col}`").cast("string")).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    return lookup(pages.sparkSession, folder, parts, wanted).withColumnRenamed("id", id_col)
