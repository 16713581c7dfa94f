"""WARC archives with a two-level capture index.

Pages become gzip members in archives, one or more for each task. Of equal payloads of at
least ``least`` bytes only the one with the largest id is stored; the others become
revisit records that name it. The index sorts captures by the reversed-host form of
their URL (and id), in ranges; each range is one file of compressed blocks of lines
with a sparse directory of the first key of each block. A lookup finds the range by
its first key, the block by binary search in the directory, reads that block alone,
and then the one record it points to.

Scale: payloads move once, to meet the decision on their digest, in a join that can be
split where one digest holds a third of all rows. Files go to the folder that the
cluster shares, under names of their own for every attempt; only files named in a
written table of results are read, so a lost executor leaves nothing that counts.
Directories are read by the tasks that need them; the driver sees the first key of
each range only (as many as shuffle partitions).

Defined results: a null payload is empty, a null URL has the empty key; rows with equal
ids and payloads are separate records of one answer each; of repeated largest ids
every one is a response; rows with a null id are written and found under the smallest
long; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.shared import locate
from casework.session import cut_lineage, scratch_path

LEAST = 1000  # bytes from which equal payloads are stored once
BLOCK_LINES = 500  # captures in a block of the index
ARCHIVE_BYTES = 256 << 20  # an archive is closed beyond this size
NO_ID = -(1 << 63)


def reversed_host(url: str | None) -> str:
    """Key of a URL: host labels from the right, then path and query, in lower case; no scheme or port."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").strip().lower().replace("\t", " ").replace("\n", " ")
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    key += f"?{parts.query}" if parts.query else ""
    return key.replace("\t", " ").replace("\n", " ").replace("\r", " ") if host or parts.path else ""


def record(page: int, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One gzip member: the WARC header, the HTTP header and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> dict:
    """Type, ids, lengths, digest and payload of one record, as the bytes say."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(http.rsplit(b"Content-Length: ", 1)[1])
    number = lambda name: int(fields[name][len("<urn:page:") : -1]) if name in fields else None
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].split(":", 1)[1]
    if kind == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its header")
    return {
        "page": number("WARC-Record-ID"),
        "type": kind,
        "refers": number("WARC-Refers-To"),
        "bytes": stated,
        "digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST
) -> DataFrame:
    """Writes the records; (key, page, file, offset, length) of each, as a written table."""
    payload = F.coalesce(F.encode(F.col(payload_column).cast("string"), "UTF-8"), F.lit(b""))
    raw = pages.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("page"),
        F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
    )
    raw = raw.withColumn("digest", F.sha1("payload"))
    large = raw.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n"))
    stored = cut_lineage(large.where("n > 1").select("digest", "first"), "warc-stored")
    decided = raw.join(stored, "digest", "left")
    refers = F.when(F.col("first") != F.col("page"), F.col("first")).alias("refers")
    decided = decided.select("page", "url", "payload", "digest", refers)
    names = ["key", "page", "file", "offset", "length"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = locate(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, digest, refers in zip(*batch.columns):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                    out.write(member)
                    rows.append((reversed_host(url.as_py()), page.as_py(), name, at, len(member)))
                    at += len(member)
                yield _batch(rows, kinds, names)
        finally:
            if out is not None:
                out.close()

    written = decided.mapInArrow(run, "key string, page long, file string, offset long, length long")
    return cut_lineage(written, "warc-captures")


def write_index(captures: DataFrame, folder: str, partitions: int) -> DataFrame:
    """Sorted compressed blocks and a sparse directory for each range; one row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = locate(folder)
        name, out, directory, lines, at, first = uuid.uuid4().hex, None, [], [], 0, None

        def flush() -> None:
            nonlocal at, lines
            block = gzip.compress("\n".join(line for _, line in lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(block)
            directory.append([*lines[0][0], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out, first = system.open_output_stream(f"{base}/{name}.blocks", compression=None), (key, page)
                lines.append(((key, page), f"{key}\t{page}\t{file}\t{offset}\t{length}"))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with system.open_output_stream(f"{base}/{name}.directory", compression=None) as stream:
                stream.write(json.dumps(directory).encode())
            yield _batch([(*first, name)], [pa.string(), pa.int64(), pa.string()], ["key", "page", "name"])

    ordered = captures.repartitionByRange(partitions, "key", "page").sortWithinPartitions("key", "page")
    return cut_lineage(ordered.mapInArrow(run, "key string, page long, name string"), "warc-ranges")


class Index:
    """Lookups in one range file: binary search in its directory, then one block."""

    def __init__(self, folder: str, name: str):
        self.system, base = locate(folder)
        self.path = f"{base}/{name}"
        with self.system.open_input_stream(f"{self.path}.directory", compression=None) as stream:
            self.directory = json.loads(stream.read())
        self.firsts = [(key, page) for key, page, _, _ in self.directory]
        self.blocks = self.system.open_input_file(f"{self.path}.blocks")
        self.held: tuple[int, dict] = (-1, {})

    def find(self, key: str, page: int) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the captures of this key and id."""
        last = bisect_right(self.firsts, (key, page)) - 1
        first = last
        while first > 0 and self.firsts[first] == (key, page):  # repeated captures may fill blocks
            first -= 1
        found = []
        for block in range(max(first, 0), last + 1):
            if self.held[0] != block:
                _, _, offset, length = self.directory[block]
                self.blocks.seek(offset)
                lines: dict[tuple[str, int], list] = {}
                for line in zlib.decompress(self.blocks.read(length), 31).decode("utf-8", "surrogatepass").split("\n"):
                    k, p, file, at, size = line.rsplit("\t", 4)
                    lines.setdefault((k, int(p)), []).append((file, int(at), int(size)))
                self.held = (block, lines)
            found += self.held[1].get((key, page), [])
        return found


def lookup(wanted: DataFrame, ranges: DataFrame, folder: str, partitions: int) -> DataFrame:
    """(page, file, offset, length) of the captures of every distinct (url, page) of *wanted*."""
    # one row for each range of the index
    known = sorted((r.key, r.page, r["name"]) for r in ranges.collect())
    starts = [(k, p) for k, p, _ in known]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url in zip(*(c.to_pylist() for c in batch.columns)):
                key = reversed_host(url)
                last = bisect_right(starts, (key, page)) - 1
                if last >= 0:
                    rows.append((page, key, last))
            yield _batch(rows, [pa.int64(), pa.string(), pa.int32()], ["page", "key", "part"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Index | None] = (-1, None)
        for batch in batches:
            rows = []
            for page, key, part in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != part:
                    opened = (part, Index(folder, known[part][2]))
                rows += [(page, *hit) for hit in opened[1].find(key, page)]
            yield _batch(rows, [pa.int64(), pa.string(), pa.int64(), pa.int64()], ["page", "file", "offset", "length"])

    asked = wanted.mapInArrow(place, "page long, key string, part int").distinct()
    # ranges of the wanted keys, not of their part: a part with most of them is read by several tasks
    dealt = asked.repartitionByRange(partitions, "part", "key", "page").sortWithinPartitions("part", "key", "page")
    return dealt.mapInArrow(find, "page long, file string, offset long, length long")


def read_records(hits: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at (file, offset, length), each by one range read."""
    names = ["page", "type", "refers", "bytes", "digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = locate(folder)
        now, source = None, None
        for batch in batches:
            rows = []
            for _, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    now, source = file, system.open_input_file(f"{base}/{file}")
                source.seek(offset)
                found = parse(source.read(length))
                if not with_payload:
                    found["payload"] = None
                rows.append(tuple(found[n] for n in names))
            yield _batch(rows, kinds, names)

    ordered = hits.sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page long, type string, refers long, bytes long, digest string, payload binary")


def archive_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Archives and indexes the pages in the shared folder, then reads every page back by its URL and id."""
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "warc-index")
    ranges = write_index(write_archives(pages, archives, id_column, url_column, payload_column), index, partitions)
    wanted = pages.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("page"), F.col(url_column).cast("string").alias("url")
    )
    read = read_records(lookup(wanted, ranges, index, partitions), archives)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return read.select(
        real("page").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        real("refers").alias("refers_to"),
    )
