"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC/1.1 record, gzip member by member, in archives in the shared folder.
Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest page id is a response
and the others are revisits that refer to it (they keep the HTTP head, with its Content-Length, and no body). Pages are not
shuffled where the payloads that occur again are counted few (``BROADCAST_PAYLOADS``), else only those of that size are.

Index: captures are sorted by reversed-host URL key (and page id), and each range of keys is one index file:
zlib blocks of ``BLOCK`` captures, then a sparse directory with the first key and the place of each block, then
the directory's place. Only the ranges (one row per index file) are held outside the files.

Reading: wanted keys go to the files whose range holds them (binary search in the ranges); there the directory is binary-searched, only
the blocks that can hold a key are read (by range), and the captures found are grouped by archive and
read by range from it. Payload digests of responses are recomputed from what was read.

Files are written under names of their own by each task attempt, through the file system that the shared
folder's URI names; a lost or repeated attempt leaves files that no row names. Null url: an empty key
and no target URI; line breaks in a url are percent-encoded. Null html: an empty payload. A null page id is no number: its record has none, it is
never the largest, and is a revisit only where a page with an id has the same payload. Repeated rows are records of their own
(those that share the response's id are all responses). No pages: no archives, and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_folder, partitions

#: Captures of an index block, and bytes after which a new archive begins.
BLOCK, ARCHIVE_BYTES = 512, 256 << 20
#: Payloads that occur again and are broadcast; beyond that pages meet them by a shuffle.
BROADCAST_PAYLOADS = 100_000
_CAPTURE = "key string, page_id long, archive string, start long, size long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, a closing mark, then path and query: neighbours share a site."""
    host = F.lower(F.regexp_extract(url, r"(?s)^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^#]*)", 1)
    plain = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(url.contains("://"), plain).otherwise(url), F.lit(""))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _record(name: uuid.UUID, kind: str, page: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    line = lambda u: u.replace("\r", "%0D").replace("\n", "%0A")  # noqa: E731  a head line can hold no line breaks
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + line(url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + line(refers_url))
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """page_id, url, record_type, payload_bytes, payload_digest and refers_to of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind != "revisit" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of record {fields['warc-record-id']} does not match its digest")
    number = lambda name: None if name not in fields else int(fields[name])
    return number("warc-page-id"), fields.get("warc-target-uri"), kind, stated, digest, number("warc-refers-to-page-id")


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out, name, own, at = None, None, None, 0
        for batch in batches:
            rows = []
            for key, page, url, html, kind, digest, to, to_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    system.create_dir(root, recursive=True)
                    own = uuid.uuid4()
                    name, at = f"{root}/{own.hex}.warc.gz", 0
                    out = system.open_output_stream(name, compression=None)
                data = gzip.compress(_record(uuid.uuid5(own, str(at)), kind, page, url, date, (html or "").encode(), digest, to, to_url), 6, mtime=0)
                out.write(data)
                rows.append((key, page, name, at, len(data)))
                at += len(data)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "page_id", "archive", "start", "size"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the records; returns the captures (key, page_id, archive, start, size), already materialised."""
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    known = lambda df: df.withColumn("same", F.unhex(F.sha2("payload", 256))).drop("payload")
    # groups of one need no decision: only payloads that occur again are joined back
    groups = known(rows.where(large)).groupBy("same").agg(F.max("page_id").alias("best"), F.count("*").alias("times"), F.max_by("url", "page_id").alias("best_url"))
    again = materialise(groups.where("times > 1 and best is not null").select("same", "best", "best_url"), "payloads")
    made = lambda df, kind, to, to_url: df.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", kind.alias("kind"), "digest", to.alias("refers_to"), to_url.alias("refers_url"))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    decided = lambda df: made(df, F.when(revisit, "revisit").otherwise("response"), F.when(revisit, F.col("best")), F.when(revisit, F.col("best_url")))
    if again.count() <= BROADCAST_PAYLOADS:
        written = decided(known(rows.withColumn("payload", F.when(large, F.col("payload")))).join(F.broadcast(again), "same", "left"))
    else:
        small = made(rows.where(~large), F.lit("response"), F.lit(None).cast("long"), F.lit(None).cast("string"))
        written = decided(known(rows.where(large)).join(again, "same", "left")).unionByName(small)
    return materialise(written.mapInArrow(_writer(f"{folder}/archives", date), _CAPTURE), "captures")


def _index_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name, out, at, held, directory, last, n = None, None, 0, [], [], None, 0

        def close_block():
            nonlocal at
            data = zlib.compress("\n".join(map(json.dumps, held)).encode())
            directory.append((held[0][0], held[0][1], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.idx"
                    out = system.open_output_stream(name, compression=None)
                held.append(row)
                last, n = row[0], n + 1
                if len(held) == BLOCK:
                    close_block()
        if out is not None:
            if held:
                close_block()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data)
            out.write(struct.pack("<QQ", at, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([n], pa.int64())], names=["file", "first_key", "last_key", "n"]
            )

    return run


def write_index(captures: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Sort the captures into index files; returns their ranges (file, first_key, last_key, n)."""
    n = files or partitions(captures.sparkSession)
    # the page id splits a key of very many captures over several files
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").select("key", "page_id", "archive", "start", "size")
    return materialise(ordered.mapInArrow(_index_writer(f"{folder}/index"), "file string, first_key string, last_key string, n long"), "ranges")


def _range(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def search(file, keys: list[str]) -> Iterator[tuple]:
    """The captures of the sorted distinct ``keys`` in one open index file, by its directory."""
    place = file.size() - 16
    start, size = struct.unpack("<QQ", _range(file, place, 16))
    directory = json.loads(zlib.decompress(_range(file, start, size)))
    firsts = [d[0] for d in directory]
    loaded, rows, names = -1, [], []
    for key in keys:
        # a block that begins with the key may follow one that ends with it
        block = max(0, bisect.bisect_left(firsts, key) - 1)
        while block < len(directory) and firsts[block] <= key:
            if block != loaded:
                rows = [json.loads(x) for x in zlib.decompress(_range(file, *directory[block][2:])).split(b"\n")]
                names, loaded = [r[0] for r in rows], block
            yield from rows[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
            block += 1


def _searcher(folder: str):
    def run(wanted: pa.Table) -> pa.Table:
        system, _ = _open(folder)
        names = sorted(set(wanted.column("key").to_pylist()))
        with system.open_input_file(wanted.column("file")[0].as_py()) as file:
            rows = list(search(file, names))
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        name, file = None, None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for archive, start, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "size"))):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, system.open_input_file(archive)
                out.append(parse(gzip.decompress(_range(file, start, size))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _RECORD.split(", ")])
        if file is not None:
            file.close()

    return run


def _router(ranges):
    """The index files that may hold each key; files are in the order of their ranges, which meet in one key at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, firsts, lasts = ranges.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(names[i], key) for key in keys for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["file", "key"])

    return run


def lookup(keys: DataFrame, ranges: DataFrame, folder: str) -> DataFrame:
    """The captures of the keys (column key). ranges: as :func:`write_index` returns them; a row per index file is all that the driver holds."""
    held = sorted((r["first_key"], r["last_key"], r["file"]) for r in ranges.collect())
    firsts, lasts, names = zip(*held) if held else ((), (), ())
    table = keys.sparkSession.sparkContext.broadcast((names, firsts, lasts))
    wanted = keys.select("key").distinct().mapInArrow(_router(table), "file string, key string")
    return wanted.groupBy("file").applyInArrow(_searcher(folder), _CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read the captured records: page_id, url, record_type, payload_bytes, payload_digest, refers_to."""
    # neighbouring ranges of one archive are read by one task, in the order of their places
    dealt = captures.repartition("archive", F.expr(f"start div {16 << 20}")).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(_reader(folder), _RECORD)


def round_trip(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages, index them, look every page's key up and read the records back."""
    spark: SparkSession = pages.sparkSession
    folder = new_folder(spark, "warc")
    captures = write_archives(pages, folder, revisit_bytes)
    ranges = write_index(captures, folder)
    found = lookup(pages.select(url_key(F.col("url").cast(T.StringType())).alias("key")), ranges, folder)
    return read_records(found, folder)
