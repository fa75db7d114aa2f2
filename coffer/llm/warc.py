"""WARC archives in Zstandard frames with a shared dictionary (operator 4).

``write_archives`` turns a table of pages into ``.warc.zst`` files: a skippable frame that holds the dictionary
(itself Zstandard-compressed), then one frame per record, compressed with that dictionary. Pages whose payload another
page has too become revisit records of the one with the smallest ``page_id`` (payloads of fewer than
``min_payload`` bytes stay responses). ``read_archives`` loads the dictionary from the leading frame, decodes one
frame per record, and checks version, mandatory headers, block and payload lengths and digests; anything else raises
``ArchiveError``, so a damaged archive never gives part of its rows.

Files are written by the tasks through ``pyarrow.fs`` into a fresh folder of ``spark.checkpoint.dir``, at most
``ARCHIVE_BYTES`` of payload each, under names that no other attempt of a task uses; the list of files is a written
table of what finished tasks returned, so files of lost attempts are never read. A task holds one page at a time.

Payloads meet by SHA-1 with map-side minima, so a payload that a third of all pages share is one row a task. The html
is shuffled once, by page.

Edge cases: null html is an empty payload; a null page_id sorts last and is written as such; of rows equal in page_id and payload
the first is the response and the others revisit it; null urls give records without a target; control characters in urls are
percent-encoded; an empty table writes no file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.session import scratch_path

from .common import load, materialize, ship_package

#: Frame magic of the dictionary (a skippable frame) and of a Zstandard frame, little-endian.
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on the pages with the smallest hashes: this many, and this many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 32 << 10
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample of pages; empty if there is too little to learn from."""
    some = pages.filter(F.length("html") > 0).withColumn("h", F.xxhash64("page_id", "html"))
    # only hashes are sorted; then the pages at or below the last of them are read
    last = some.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    sample = some.filter(F.col("h") <= last).select(F.substring("html", 1, SAMPLE_BYTES).alias("html"), "h").distinct().sort("h", "html").collect()
    parts = [r["html"].encode()[:SAMPLE_BYTES] for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple | None, copy: int) -> bytes:
    """A WARC record; the length of the whole payload stands in the HTTP header of responses and revisits alike."""
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{copy}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_b32(block)}"]
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{'null' if refers[0] is None else refers[0]}:0>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; returns their list (``path, records``), a written table."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "warc")
    dictionary = train_dictionary(pages)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    ids = rows.select("page_id", "sha", F.octet_length("html").alias("n")).distinct()
    # null ids sort last
    first = (ids.filter(F.col("n") >= min_payload).groupBy("sha")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"))).alias("first"))
             .select("sha", F.col("first.page_id").alias("first_id")))
    i, f = ids.alias("i"), first.alias("f")
    decided = i.join(f, "sha", "left").select("i.page_id", F.col("sha").alias("key"), "first_id", (F.col("n") >= min_payload).alias("shared"))
    r, d = rows.alias("r"), decided.hint("merge").alias("d")
    ready = (r.join(d, F.expr("r.page_id <=> d.page_id AND r.sha = d.key")).select("r.page_id", "url", "html", "sha", "first_id", "shared")
             .sortWithinPartitions("page_id", "sha"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        lead = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
        out, path, size, count, done = None, "", 0, 0, []
        before, copy = None, 0
        for b in batches:
            for page_id, url, text, sha, first_id, shared in zip(*(c.to_pylist() for c in b.columns)):
                copy = copy + 1 if (page_id, sha) == before else 0
                before = (page_id, sha)
                payload = text.encode()
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((path, count))
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(path)
                    out.write(SKIPPABLE.to_bytes(4, "little") + len(lead).to_bytes(4, "little") + lead)
                response = not shared or (page_id == first_id and not copy)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.write(packer.compress(_record(page_id, url, payload, digest, None if response else (first_id,), copy)))
                size += len(payload)
                count += 1
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    listed = materialize(ready.mapInArrow(write, "path string, records long"), "warc-list")
    return listed.withColumn("folder", F.lit(folder))


class _Source:
    """Bytes of an archive, read on in pieces."""

    def __init__(self, stream, path: str):
        self.stream, self.path, self.held = stream, path, b""

    def need(self, n: int, what: str) -> bytes:
        while len(self.held) < n:
            more = self.stream.read(1 << 20)
            if not more:
                raise ArchiveError(f"{self.path}: cut off in {what}")
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def ended(self) -> bool:
        if not self.held:
            self.held = self.stream.read(1 << 20)
        return not self.held

    def frame(self, unpack: zstandard.ZstdDecompressor) -> bytes:
        """The content of the next frame, which must be whole."""
        if int.from_bytes(self.need(4, "a frame header"), "little") != ZSTD:
            raise ArchiveError(f"{self.path}: no Zstandard frame where a record begins")
        self.held = ZSTD.to_bytes(4, "little") + self.held
        one, out = unpack.decompressobj(), []
        try:
            while not one.eof:
                if self.ended():
                    raise ArchiveError(f"{self.path}: cut off in a record")
                out.append(one.decompress(self.held))
                self.held = one.unused_data if one.eof else b""
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{self.path}: {e}") from None
        return b"".join(out)


def parse_record(raw: bytes, path: str = "") -> dict:
    """Headers and payload facts of one record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"{path}: no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in fields:
            raise ArchiveError(f"{path}: bad header line {line!r}")
        fields[name] = value.strip()
    if missing := [m for m in MANDATORY if m not in fields]:
        raise ArchiveError(f"{path}: no {', '.join(missing)}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{path}: the block doesn't have its stated length")
    block = rest[:-4]
    if fields.get("WARC-Block-Digest", "sha1:" + _b32(block)) != "sha1:" + _b32(block):
        raise ArchiveError(f"{path}: block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    stated = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not gap or len(stated) != 1 or not stated[0].isdigit():
        raise ArchiveError(f"{path}: no HTTP header with a length")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != int(stated[0]) or _b32(payload) != digest:
            raise ArchiveError(f"{path}: payload length or digest")
    elif kind != "revisit" or payload or "WARC-Refers-To" not in fields:
        raise ArchiveError(f"{path}: a record of type {kind!r}")
    return {"fields": fields, "kind": kind, "payload": payload, "bytes": int(stated[0]), "digest": digest}


def records(stream, path: str = "") -> Iterator[dict]:
    """The records of an open archive."""
    src = _Source(stream, path)
    if int.from_bytes(src.need(4, "the dictionary frame"), "little") != SKIPPABLE:
        raise ArchiveError(f"{path}: no leading dictionary frame")
    lead = src.need(int.from_bytes(src.need(4, "the dictionary frame"), "little"), "the dictionary")
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(lead)) if lead else None
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    while not src.ended():
        yield parse_record(src.frame(unpack), path)


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").rpartition(":")[0]
    return None if name == "null" else int(name)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def read_archives(listed: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record of the archives in ``listed`` (``folder, path, records``); ``html`` is null for revisits and,
    without ``payloads``, throughout. Archives are dealt to tasks by path."""
    ship_package(listed.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, expected, folder in zip(*(c.to_pylist() for c in b.columns)):
                store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                rows, held, n = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for r in records(stream, path):
                        f = r["fields"]
                        html = r["payload"].decode() if payloads and r["kind"] == "response" else None
                        rows.append((_page(f["WARC-Record-ID"]), r["bytes"], r["digest"], r["kind"],
                                     _page(f["WARC-Refers-To"]) if r["kind"] == "revisit" else None, f.get("WARC-Target-URI"), html))
                        n += 1
                        held += len(r["payload"]) if payloads else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if n != expected:
                    raise ArchiveError(f"{path}: {n} records where {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # one archive is one unit of work; the number is given, so that adaptive execution doesn't merge these small partitions
    todo = listed.select("path", "records", "folder")
    return todo.repartition(max(1, todo.count()), "path").mapInArrow(read, RECORD)


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from its archive record."""
    listed = write_archives(load(spark, sf_dir, "pages"))
    return read_archives(listed, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
