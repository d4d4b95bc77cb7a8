"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.tables import sample_by_hash, small
from corrobora.session import cut_lineage

#: Magic number of the skippable frame that holds the dictionary, and of a dictionary and a frame themselves.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
ARCHIVE_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = (
    "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """Control characters are percent-encoded, so no value can break a header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that keeps the HTTP header and names what it repeats."""
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises ValueError when headers, lengths or the digest are not as they should be."""
    head, found, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    length = int(headers["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    http, found, payload = body[:length].partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError("the payload does not have the stated length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit" and payload):
        raise ValueError("a record of another kind")
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v[len("<urn:page:") : -1] else None
    return {
        "page_id": number(headers["warc-record-id"]), "uri": headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": stated,
        "payload_digest": digest, "refers_to": number(headers.get("warc-refers-to")), "payload": payload if kind == "response" else None, "error": None,
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample payloads; with too few or too short ones their joined bytes serve as a raw one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _frames(content: bytes, at: int, dictionary: zstandard.ZstdCompressionDict | None, step: int = 1 << 14) -> Iterator[bytes]:
    """The decoded frames from ``at`` on, one at a time; a record never spans frames."""
    decoder, view = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor(), memoryview(content)
    while at < len(content):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive. A broken record or archive gives a row with ``error``; what follows a broken frame is lost."""
    blank = dict.fromkeys(("page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"))
    try:
        at, dictionary = 0, None
        if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
            size = struct.unpack_from("<I", content, 4)[0]
            raw = content[8 : 8 + size]
            if len(raw) != size:
                raise ValueError("the dictionary is cut off")
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            at, dictionary = 8 + size, zstandard.ZstdCompressionDict(raw) if raw else None
        for data in _frames(content, at, dictionary):
            try:
                yield parse_record(data)
            except ValueError as wrong:
                yield blank | {"error": str(wrong)}
    except (ValueError, zstandard.ZstdError) as wrong:
        yield blank | {"error": str(wrong)}


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, owner): of every payload of at least ``least_bytes`` that several records share, the largest page_id."""
    digests = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    shared = digests.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("owner"))
    return shared.where("n > 1 and owner is not null").select("digest", "owner")


def write_archives(
    pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 4 << 20, dictionary_bytes: int = 1 << 15, sample: int = 400,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """(archive, content): archives of about ``archive_bytes`` uncompressed bytes with a record per row of ``pages(page_id, url, html)``.

    The dictionary is trained on ``sample`` payloads, the first by hash, and leads every archive in a skippable frame.
    Of equal payloads the one with the largest page_id is the response, the others are revisits of it. Owners are
    joined by digest: broadcast when a count proves them few, else by a shuffle that AQE splits where a digest is hot.

    Edge cases: null html is an empty payload; a null url leaves its header out; a null page_id is never an owner and
    has an empty record id; rows that repeat the owner's id and payload are responses too; no pages give no archive.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    sampled = sample_by_hash(base.select(F.substring("payload", 1, 1 << 16).alias("p")), "p", sample).collect()
    lead = train_dictionary(sorted(bytes(r.p) for r in sampled), dictionary_bytes)
    owners = small(cut_lineage(roles(base, least_bytes)))
    rows = base.withColumn("digest", F.sha1("payload")).join(owners, "digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(lead) if lead else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        parts, size, first = [], 0, None

        def archive() -> pa.RecordBatch:
            content = dictionary_frame(lead) + b"".join(parts)
            name = f"pages-{first}-{hashlib.sha1(content).hexdigest()[:16]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                data = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                first = page_id.as_py() if not parts else first
                parts.append(encoder.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    return rows.mapInArrow(run, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives(content)``: from ``write_archives``, or files read with the binaryFile source.

    Every frame is decoded with the archive's own dictionary, and headers, lengths and digests are checked; ``error``
    tells what is wrong with a record, or is null. Rows of the result: page_id, uri, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for revisits, or always with ``payloads=False``), error.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for content in batch.column(0):
                records = list(read_archive(content.as_py() or b""))
                if not payloads:
                    records = [r | {"payload": None} for r in records]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], types.get(n, pa.string())) for n in names], names=names)

    return archives.select("content").mapInArrow(run, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its archived record."""
    written = cut_lineage(write_archives(pages, least_bytes))
    return read_archives(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
