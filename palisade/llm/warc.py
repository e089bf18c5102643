"""WARC archives in Zstandard with a shared dictionary: one frame a record, the dictionary in a leading skippable frame.

A dictionary is trained on a bounded sample of payloads. Each write task rolls archives of bounded size, under names of
its own, so a task that runs twice leaves only files that no manifest names. The reader takes the dictionary from the
leading skippable frame, decodes one frame at a time, and checks each record's version line, headers, block length and
digests before it gives the record out.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the least page_id is a response and the others
are revisits, which carry the digest and length of the payload but not the payload.

An empty table gives archives of no records; extra columns, whatever their names, aren't looked at. Archives that a lost
attempt left behind are in no manifest; the folder, named by a fresh id, can go when the result has been written.

Nulls: a null html is an empty payload; a null url gives a record without target; a null page_id counts in no minimum
(equal payloads of null ids alone are all responses). Rows of the least page_id itself, repeated, are all responses.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, file_system, join_skewed, pieces, shared_path, to_arrow

MIN_REVISIT = 100
#: Fixed values of the formats: the skippable frame that holds a dictionary, the magic numbers of frames and dictionaries.
DICT_FRAME, ZSTD_FRAME, ZSTD_DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 200, 20_000, 64 << 10
ARCHIVE_BYTES, READ_BYTES, MAX_RECORD = 64 << 20, 32 << 10, 1 << 30


class BadRecord(ValueError):
    """An archive or record that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples; of too few samples, one of raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def sample_payloads(pages: DataFrame) -> list[bytes]:
    """At most SAMPLE_PAGES payloads, cut to SAMPLE_CHARS; only compression depends on them."""
    return [r[0].encode() for r in pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).where("h <> ''").limit(SAMPLE_PAGES).collect()]


def build_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode())
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names) and payload of one record; BadRecord if anything doesn't hold."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("Content-Length is not the block's length")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise BadRecord("block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    declared = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(declared) != 1 or not declared[0].isdigit():
        raise BadRecord("HTTP headers")
    headers["payload-length"] = int(declared[0])
    if headers["warc-type"] == "response":
        if len(payload) != headers["payload-length"] or headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise BadRecord("payload length or digest")
    elif headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise BadRecord("revisit record")
    else:
        raise BadRecord(f"record type {headers['warc-type'][:40]!r}")
    return headers | {"payload": payload}


class ArchiveWriter:
    """Appends records to one archive."""

    def __init__(self, stream, dictionary: bytes):
        import zstandard

        self.stream, self.written = stream, 0
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        self._put(struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))


def read_records(stream) -> Iterator[dict]:
    """Records of an archive, one frame at a time."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise BadRecord("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_FRAME:
        raise BadRecord("the archive doesn't start with a dictionary frame")
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise BadRecord("the dictionary frame is cut short")
    if size >= 4 and struct.unpack("<I", dictionary[:4])[0] == ZSTD_FRAME:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=64 << 20)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = stream.read(READ_BYTES)
    while data:
        frame, parts, total = decompressor.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise BadRecord(f"frame: {e}") from e
            total += len(parts[-1])
            if total > MAX_RECORD:
                raise BadRecord("record is too long")
            if frame.eof:
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise BadRecord("the last frame is cut short")
        data = frame.unused_data or stream.read(READ_BYTES)
        yield parse_record(b"".join(parts))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: null for responses."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sized = sized.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256)))
    firsts = cut(sized.select("page_id", "digest").groupBy("digest").agg(F.count("*").alias("n_rows"), F.min("page_id").alias("first")))
    firsts = firsts.withColumn("first", F.when(F.col("digest").isNotNull(), F.col("first")))
    found = join_skewed(sized, firsts, ["digest"])
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return found.select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes a record a row of mark_revisits(); returns the manifest (path, n_records), which is checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        stream = writer = None
        name, n = "", 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for part in pieces(batch, "html"):
                for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if writer is None:
                        name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                        stream = fs.open_output_stream(f"{base}/{name}")
                        writer = ArchiveWriter(stream, dictionary)
                    writer.add(build_record(page_id, url, html.encode(), refers_to))
                    n += 1
                    if writer.written >= ARCHIVE_BYTES:
                        yield closed()
                        writer = None
        if writer is not None:
            yield closed()

    return cut(marked.mapInArrow(run, "path string, n_records long"))


#: Columns of the records read back, with their types. payload is null for revisits.
RECORD = {"page_id": "string", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "string", "payload": "binary"}


def read_archives(manifest: DataFrame, id_type: str = "bigint", columns: list[str] | None = None) -> DataFrame:
    """The named columns (default: all of RECORD) of every record. Every record is checked in full; only these columns go to the JVM."""
    columns = columns or list(RECORD)
    schema = ", ".join(f"{c} {RECORD[c]}" for c in columns)
    kinds = [to_arrow(f.dataType) for f in T.StructType.fromDDL(schema)]
    with_payload = "payload" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True)], names=columns)

        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, at = file_system(path)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(at) as stream:
                    for r in read_records(stream):
                        seen += 1
                        page, refers = r["warc-record-id"][10:-1], r.get("warc-refers-to")
                        row = {"page_id": page or None, "url": r.get("warc-target-uri"), "payload_bytes": r["payload-length"], "payload_digest": r["warc-payload-digest"].removeprefix("sha256:"), "record_type": r["warc-type"], "refers_to": refers and refers[10:-1]}
                        if with_payload:
                            row["payload"] = r["payload"] if r["warc-type"] == "response" else None
                            held += len(r["payload"])
                        rows.append(row)
                        if held >= 4 << 20 or len(rows) >= 2000:
                            yield flush(rows)
                            rows, held = [], 0
                if seen != n:
                    raise BadRecord(f"{path} has {seen} records; {n} were written")
                if rows:
                    yield flush(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.repartition(n).mapInArrow(run, schema)
    return found.select(*(F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in columns))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives of pages to the shared folder and returns the digest columns read back from them."""
    dictionary = train_dictionary(sample_payloads(pages))
    manifest = write_archives(mark_revisits(pages), shared_path(spark, "warc"), dictionary)
    return read_archives(manifest, pages.schema["page_id"].dataType.simpleString(), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
