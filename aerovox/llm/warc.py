"""WARC archives of Zstandard frames with a shared dictionary: written by Spark, read back checked.

An archive is one file: a skippable frame with the dictionary, then one frame per record. Spark's
text writer writes them, so archives land where any Spark output does and a lost task leaves none
behind. It puts a separator after each row; here that is an empty skippable frame, which every
decoder passes over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import sample_rows, small_batches
from aerovox.session import scratch_path, store

# Fixed values of the formats: magic numbers of frames, versions and line ends.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # the magic 0x184D2A50 and a length of 0
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
#: Pages the dictionary is trained on, bytes of each, and bytes of the dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 14, 1 << 16
LEVEL = 3


class BadArchive(ValueError):
    """An archive that is cut off, has wrong lengths or digests, or lacks headers."""


# --- one record ---------------------------------------------------------------------------


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block; ``BadArchive`` unless all lengths fit."""
    if not data.startswith(VERSION):
        raise BadArchive("no WARC version line")
    head, found, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    if not found:
        raise BadArchive("headers do not end")
    fields = {}
    for line in head.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"no header: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise BadArchive("content-length is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"content-length is {n}, the block has {len(rest) - 4} bytes")
    return fields, rest[:n]


def http_response(payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        raise BadArchive("the block is no HTTP response")
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length" and int(value) != len(body):
            raise BadArchive("the payload has another length than its HTTP header says")
    return body


# --- one archive --------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each the content of one frame."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) - at < 8:
            raise BadArchive("cut off in a frame's header")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic == DICTIONARY_MAGIC or magic in SKIPPABLE:
            if len(archive) - at - 8 < size:
                raise BadArchive("cut off in a skippable frame")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise BadArchive("a dictionary that is not in front")
                data = archive[8 : 8 + size]
                if data[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise BadArchive(f"no frame begins at byte {at}")
        one = decoder.decompressobj()
        rest = memoryview(archive)[at:]
        out, step = [], 1 << 16
        for low in range(0, len(rest), step):
            out.append(one.decompress(bytes(rest[low : low + step])))
            if one.eof:
                at += min(low + step, len(rest)) - len(one.unused_data)
                break
        else:
            raise BadArchive("cut off in a frame")
        yield b"".join(out)


# --- tables -------------------------------------------------------------------------------


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most ``SAMPLE_ROWS`` pages, chosen by a hash. It changes
    the size of the archives, never what is in them. Empty if the pages are too few or too short."""
    chosen = sample_rows(pages.where(F.col("html") != ""), SAMPLE_ROWS)
    sample = [r.t.encode() for r in chosen.select(F.substring("html", 1, SAMPLE_BYTES).alias("t")).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``: the smallest page_id among the pages of an equal
    payload of at least ``LEAST_SHARED`` bytes, null for that page itself and for all others.

    Only digests are compared and shuffled; the page goes to where its page_id is.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.withColumn("digest", F.sha2(body, 256))
    long = marked.where(F.octet_length(body) >= LEAST_SHARED)
    shared = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = store(shared.select("digest", "first"), "shared-payloads")
    later = long.select("page_id", "digest").join(shared, "digest").where("page_id <> first")
    later = store(later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    return marked.join(later, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) to archives below ``path``.

    A null html is an empty payload, a null url is left out. Repeated rows give repeated records;
    of rows that share page_id and payload none refers to another. An empty table gives archives
    without records.
    """
    small_batches(pages.sparkSession)
    rows = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    dictionary = train_dictionary(pages)
    # A fixed date and ids made from the page's, so that a task that runs twice writes the same.
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    space = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        yield pa.RecordBatch.from_pydict({"frame": pa.array([dictionary_frame(dictionary)] if dictionary else [], pa.binary())})
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            out = [coder.compress(_page_record(*row, date, space)) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    lines = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "frame binary")
    lines.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _page_record(ident, url, html, digest, refers_to, date, space) -> bytes:  # noqa: ANN001
    payload = (html or "").encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(space, f'{ident} {digest}')}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if ident is not None:
        fields["WARC-Page-ID"] = str(ident)
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    fields["Content-Type"] = "application/http; msgtype=response"
    if refers_to is None:
        block = http_response(payload)
    else:
        block = http_response(b"").replace(b"Content-Length: 0\r\n", b"")  # the payload is elsewhere
        fields["WARC-Profile"] = REVISIT_PROFILE
        fields["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(space, f'{refers_to} {digest}')}>"
        fields["WARC-Refers-To-Page-ID"] = str(refers_to)
    fields["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return record(fields, block)


READ = (
    "page_id long, url string, record_id string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to_record string, refers_to long, payload binary"
)


def read_archives(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The records of all archives below ``path``; columns ``READ``, ``payload`` null for revisits.

    Every record is checked: headers, lengths, digest of the block and, if there is one, of the
    payload. Anything wrong ends the query with ``BadArchive``.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                out, held = [], 0
                for data in frames(archive.as_py()):
                    out.append(_read_record(data))
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, READ)


def _read_record(data: bytes) -> dict:
    fields, block = parse_record(data)
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadArchive("the block has another digest than its header says")
    kind, payload = fields["warc-type"], None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        payload = http_payload(block)
        if digest != hashlib.sha256(payload).hexdigest() or fields.get("warc-payload-length") != str(len(payload)):
            raise BadArchive("the payload is not what its headers say")
    elif kind != "revisit" or "warc-refers-to" not in fields:
        raise BadArchive(f"a record of type {kind} without what it refers to")
    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
    return {
        "page_id": page and int(page),
        "url": fields.get("warc-target-uri"),
        "record_id": fields["warc-record-id"],
        "record_type": kind,
        "payload_bytes": int(fields["warc-payload-length"]),
        "payload_digest": digest,
        "refers_to_record": fields.get("warc-refers-to"),
        "refers_to": refers and int(refers),
        "payload": payload,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what is read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
