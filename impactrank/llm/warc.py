"""WARC archives with a two-level capture index.

Archives hold one gzip member per record.  The index sorts captures by reversed-host
URL key into compressed blocks; a sparse directory keeps each block's first and last
key and its byte range.  A look-up finds the block in the directory, reads that
range alone, and bisects in it for the record's range in its archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import prepare, shared_dir, write_table

#: Index lines in a block, and bytes of an archive that one reading task takes.
BLOCK_LINES, READ_BYTES = 512, 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then port, path and query; scheme, user and fragment dropped."""
    if not url:
        return ")"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower().rstrip("."), u.port
    except ValueError:
        return ")" + url.strip()
    usual = {"http": 80, "https": 443}.get(u.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "") + ")" + (u.path or "/")
    return key + (f"?{u.query}" if u.query else "")


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id + (1 << 63))}>"


def page_of(record: str) -> int:
    return uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int - (1 << 63)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, with the payload's length, and no payload."""
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    block = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    page_id: int
    kind: str
    url: str
    digest: str
    payload_bytes: int
    refers_to: int | None
    payload: bytes | None


def parse(raw: bytes) -> Record:
    """Read one record back; a payload that does not match its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    other = fields.get("WARC-Refers-To")
    return Record(page_of(fields["WARC-Record-ID"]), kind, fields["WARC-Target-URI"], digest, size, page_of(other) if other else None, payload if kind == "response" else None)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, on whatever store it is."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record; returns the captures (key, page, file, at, size).

    Of pages with equal payloads of ``min_bytes`` at least, that of the largest id is a
    response and the others revisit it; smaller payloads are all responses.  Of rows
    that repeat the largest id, the first by URL is the response.  Each
    task writes files of its own name; the captures are written once, so files of
    a task that was lost are not referred to.
    """
    spark = prepare(pages.sparkSession)
    html, size = F.coalesce(html_col, F.lit("")), F.octet_length(F.coalesce(html_col, F.lit("")))
    p = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    # Equal payloads are found among (page, sha) alone; payloads move by page and sha, so a payload that many pages have is dealt out.
    brief = pages.where(F.col(id_col).isNotNull() & (size >= min_bytes)).select(F.col(id_col).cast("long").alias("page"), F.sha1(html.cast("binary")).alias("sha"))
    brief = write_table(brief.groupBy("page", "sha").agg(F.count("*").alias("rows")), folder, "payloads")
    kept = brief.groupBy("sha").agg(F.max("page").alias("keeper"), F.sum("rows").alias("n")).where("n > 1").select("sha", "keeper")
    pairs = brief.join(kept, "sha")
    others = pairs.where("page <> keeper").select("page", "sha", F.col("keeper").alias("other"))
    linked = p.join(others, ["page", "sha"], "left").select("page", "url", "html", "other")
    doubled = pairs.where("page = keeper AND rows > 1").select("page", "sha")
    if not doubled.isEmpty():  # rows that repeat the response: the first by URL stays one, the rest revisit it
        place = F.row_number().over(Window.partitionBy("page", "sha").orderBy("url"))
        again = p.join(doubled, ["page", "sha"], "left_semi").select("page", "url", "html", F.when(place > 1, F.col("page")).alias("other"))
        linked = p.join(doubled, ["page", "sha"], "left_anti").join(others, ["page", "sha"], "left").select("page", "url", "html", "other").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(f"{root}/archives", recursive=True)
        name, out, at = f"archives/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page, url, html, other in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), other, date), 3, mtime=0)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "page", "file", "at", "size"])
        if out:
            out.close()

    return write_table(linked.mapInArrow(run, "key string, page long, file string, at long, size long"), folder, "captures")


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key into compressed blocks; returns the directory (first, last, file, at, size, lines).

    Keys are dealt by range together with the page, so one host or one URL with many
    captures is cut like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(f"{root}/index", recursive=True)
        name, out, at, held = f"index/{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def block(rows: list[tuple]) -> tuple:
            nonlocal out, at
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            raw = gzip.compress("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode(), 6, mtime=0)
            out.write(raw)
            at += len(raw)
            return rows[0][0], rows[-1][0], name, at - len(raw), len(raw), len(rows)

        def emit(blocks: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks)], ["first", "last", "file", "at", "size", "lines"])

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(5)))
            blocks = []
            while len(held) >= lines:
                blocks.append(block(held[:lines]))
                held = held[lines:]
            if blocks:
                yield emit(blocks)
        if held:
            yield emit([block(held)])
        if out:
            out.close()

    dealt = captures.select("key", "page", "file", "at", "size").repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    return write_table(dealt.mapInArrow(run, "first string, last string, file string, at long, size long, lines long"), folder, "directory")


def _read(fs: pafs.FileSystem, path: str, at: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def _lines(raw: bytes) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(raw).decode().split("\n")[:-1]]


def lookup(spark: SparkSession, folder: str, url: str) -> list[Record]:
    """All captures of a URL's key, in order of page.

    The directory is filtered by key (its files hold key ranges, so Parquet skips the
    others), the blocks left are read by range and bisected.
    """
    key, out = url_key(url), []
    fs, root = _open(folder)
    found = spark.read.parquet(f"{folder}/directory").where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first", "last")
    for b in found.toLocalIterator():
        rows = _lines(_read(fs, f"{root}/{b['file']}", b["at"], b["size"]))
        keys = [r[0] for r in rows]
        for _, page, file, at, size in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
            out.append((page, parse(gzip.decompress(_read(fs, f"{root}/{file}", at, size)))))
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def read_archives(directory: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Read all records through the index: blocks by range, then records by range in archive order.

    Tasks are as many as the archives have READ_BYTES.
    """
    total = directory.sparkSession.read.parquet(f"{folder}/captures").agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // READ_BYTES))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                rows = _lines(_read(fs, f"{root}/{file}", at, size))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[r[2:] for r in rows])], ["file", "at", "size"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, held = None, None
        for batch in batches:
            got = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                if file != name:
                    if held:
                        held.close()
                    name, held = file, fs.open_input_file(f"{root}/{file}")
                held.seek(at)
                got.append(parse(gzip.decompress(held.read(size))))
            if got:
                columns = [pa.array([r.page_id for r in got], pa.int64()), pa.array([r.payload_bytes for r in got], pa.int64()), pa.array([r.digest for r in got]), pa.array([r.kind for r in got]), pa.array([r.refers_to for r in got], pa.int64()), pa.array([r.url for r in got])]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
                if payload:
                    columns.append(pa.array([r.payload for r in got], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names)
        if held:
            held.close()

    # Salted by place, so that the few rows of a directory spread over all tasks.
    blocks = directory.select("file", "at", "size").repartition(max(1, min(tasks, directory.count())), "file", "at")
    where = blocks.mapInArrow(entries, "file string, at long, size long")
    dealt = where.repartition(tasks, "file", F.expr(f"at div {READ_BYTES}")).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + ", payload binary" * payload)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, payload: bool = True, **columns: str) -> DataFrame:
    """Write pages to archives with an index in a new shared folder, then read every record back.

    One row per input row: page_id, payload_bytes and payload_digest (of the full
    payload), record_type, refers_to (null for responses), target_uri, payload (null
    for revisits).  Null html is an empty payload, a null URL is about:blank.  Of repeated
    rows with the largest id one is the response and the others revisit it; rows without an id are left out.  An empty table gives an empty result.
    """
    folder = shared_dir(prepare(pages.sparkSession))
    return read_archives(write_index(write_archives(pages, folder, min_bytes, **columns), folder), folder, payload)
