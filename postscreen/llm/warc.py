"""WARC archives in Zstandard: one frame per record behind a dictionary in a leading skippable frame.

``write_archives`` makes one archive per partition of its input, ``read_archives`` reads any such
archive. An archive is a sequence of Zstandard frames:

* a skippable frame of the dictionary type, whose content is the dictionary;
* then one frame per record, each with its content size and checksum. Our own writer puts an
  empty skippable frame behind each, which other readers pass over.

Defined results: a null payload is empty; a null address is written as ``urn:null``; control
characters of an address are percent-encoded; repeated rows are records of their own; an empty
table gives no archive and no rows. A record that breaks a rule of the format comes back with
its ``problem`` said and its other columns as far as they could be read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscreen.session import materialise

# Fixed values of the Zstandard and WARC formats.
FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
TRAINED_DICTIONARY = 0xEC30A437
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An empty skippable frame (type 0x184D2A50, length 0); it is ASCII and so can be Spark's line end.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
BOILERPLATE = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n"
SAMPLE_BYTES = 256 << 10
MIN_REVISIT_BYTES = 100

RECORDS = pa.schema([("frame", pa.binary())])
READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("address", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("problem", pa.string()),
    ]
)
READ_DDL = (
    "record_id string, record_type string, address string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


# --- writing -----------------------------------------------------------------------------------


def mark_revisits(
    df: DataFrame, key: str, payload: Column, min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """Adds payload, its size and digest, ``refers_to`` and ``record_type``.

    Of the rows with equal payloads of ``min_bytes`` or more, those with the smallest key are
    responses and the others revisit it; rows without a key revisit it too, but are responses
    where no row of the group has a key. Only repeated digests are joined back: as long as they
    are few, Spark broadcasts them and payloads are not shuffled.
    """
    rows = df.withColumn("payload", F.coalesce(payload, F.lit(b"")))
    rows = rows.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.sha2("payload", 256),
        }
    )
    firsts = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.unhex("payload_digest").alias("digest"))
        .agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_key is not null")
        .select("digest", "first_key")
    )
    joined = rows.join(
        materialise(firsts, "firsts"), F.unhex("payload_digest") == F.col("digest"), "left"
    )
    again = F.col("first_key").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_key"))
    return joined.withColumns(
        {
            "refers_to": F.when(again, F.col("first_key")),
            "record_type": F.when(again, "revisit").otherwise("response"),
        }
    ).drop("digest", "first_key")


def train_dictionary(
    df: DataFrame, key: str, payload: Column, sample: int = 200, size: int = 65536
) -> bytes:
    """A dictionary fitted to a bounded sample: ``sample`` distinct payloads, the first by the hash of a key that has them.

    Payloads over ``SAMPLE_BYTES`` are none of the sample, which is thereby bounded in bytes too.
    """
    rows = df.select(F.col(key).alias("key"), payload.alias("payload")).filter(F.col("key").isNotNull())
    rows = rows.filter(F.octet_length("payload").between(1, SAMPLE_BYTES)).withColumn("digest", F.md5("payload"))
    order = rows.groupBy("digest").agg(F.min(F.xxhash64("key")).alias("first")).orderBy("first", "digest").limit(sample)
    digests = [r["digest"] for r in order.collect()]
    # One payload for each digest leaves a task.
    texts = rows.filter(F.col("digest").isin(digests)).groupBy("digest").agg(F.any_value("payload").alias("payload"))
    samples = [bytes(r["payload"]) for r in texts.orderBy("digest").collect()] if digests else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the texts themselves are the dictionary
        return (b"".join(sorted(samples)) + BOILERPLATE)[-size:]


def _address(text: str | None) -> bytes:
    raw = ("urn:null" if text is None else text).encode()
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], raw)


def _record(
    record_id: str, refers_to: str | None, address: str | None, payload: bytes, size: int,
    digest: str, date: str,
) -> bytes:
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block += b"" if revisit else payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <{record_id}>".encode(),
        f"WARC-Date: {date}".encode(),
        b"WARC-Target-URI: " + _address(address),
        f"WARC-Payload-Digest: sha256:{digest}".encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}".encode(),
            f"WARC-Refers-To: <{refers_to}>".encode(),
        ]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, path: str, dictionary: bytes, date: str = "1970-01-01T00:00:00Z",
    level: int = 6,
) -> None:
    """One archive per partition, written by Spark's own committer to any store it can reach.

    ``records`` has record_id, refers_to (null for responses), address, payload, payload_bytes
    and payload_digest. An archive is as large as the compressed partition, so the size of an
    archive is bounded by ``spark.sql.files.maxPartitionBytes`` of the scan.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary),
            write_checksum=True, write_content_size=True, write_dict_id=True,
        )
        head = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                out = [
                    compressor.compress(
                        _record(
                            r["record_id"], r["refers_to"], r["address"], r["payload"] or b"",
                            r["payload_bytes"], r["payload_digest"], date,
                        )
                    )
                    for r in rows
                ]
                yield pa.RecordBatch.from_arrays([pa.array(head + out, pa.binary())], schema=RECORDS)
                head = []

    needed = records.select(
        "record_id", "refers_to", "address", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )
    lines = needed.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string"))
    lines.write.option("lineSep", EMPTY_FRAME).text(path)


# --- reading -----------------------------------------------------------------------------------


def frame_end(data: memoryview, start: int) -> int:
    """Where the frame that starts at ``start`` ends, by its block headers."""
    at = start + zstandard.frame_header_size(data[start : start + 18])
    checksum = bool(data[start + 4] & 4)
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if at > len(data):
            raise ValueError("the archive ends within a frame")
        if head & 1:
            return at + 4 * checksum


def parse_record(raw: bytes) -> dict:
    """The record's fields; ``problem`` says which rule it breaks first, else it is None."""
    out = dict.fromkeys(READ.names)
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in VERSIONS:
        return out | {"problem": "no WARC header"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"problem": "a header line without a colon"}
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode(
            "utf-8", "replace"
        )
    kind = fields.get("warc-type")
    out["record_type"], out["address"] = kind, fields.get("warc-target-uri")
    out["record_id"] = fields.get("warc-record-id", "").strip("<>") or None
    out["refers_to"] = fields.get("warc-refers-to", "").strip("<>") or None
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            return out | {"problem": f"no {name}"}
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", fields["warc-date"]):
        return out | {"problem": "a malformed date"}
    if not fields["content-length"].isdecimal():
        return out | {"problem": "a malformed length"}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        return out | {"problem": "the block is not as long as its header says"}
    block = rest[:size]
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": size}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    http, found, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^content-length:[ \t]*(\d+)\r?$", http)
    if not found or not said or not re.fullmatch("[0-9a-f]{64}", digest):
        return out | {"problem": "no HTTP head, length or payload digest"}
    out |= {"payload_bytes": int(said[1]), "payload_digest": digest}
    if kind == "revisit":
        return out if out["refers_to"] else out | {"problem": "a revisit that refers to nothing"}
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        return out | {"problem": "the payload is not as long as its header says"}
    if hashlib.sha256(payload).hexdigest() != digest:
        return out | {"problem": "the payload differs from its digest"}
    return out


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, decoded frame by frame."""
    data, at, first = memoryview(content), 0, True
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            yield dict.fromkeys(READ.names) | {"problem": "bytes behind the last frame"}
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if first and magic == DICTIONARY_FRAME:
                raw = bytes(data[at + 8 : at + 8 + size])
                if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at, first = at + 8 + size, False
            continue
        first = False
        try:
            if magic != FRAME:
                raise ValueError("no frame where one should begin")
            end = frame_end(data, at)
            record = parse_record(decoder.decompressobj().decompress(bytes(data[at:end])))
        except (ValueError, zstandard.ZstdError) as e:
            yield dict.fromkeys(READ.names) | {"problem": f"byte {at}: {e}"}
            return
        yield record
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, one task per archive; see ``READ_DDL``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in read_archive(content.as_py()):
                    held += len(record["payload"] or b"")
                    rows.append(record if payloads else record | {"payload": None})
                    if len(rows) >= 4096 or (payloads and held >= 1 << 24):
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=READ)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, READ_DDL)


def valid(records: DataFrame) -> DataFrame:
    """The records, or an error if one of them breaks a rule of the format."""
    broken = F.raise_error(F.concat(F.lit("WARC: "), "problem")).cast("boolean")
    return records.filter(F.when(F.col("problem").isNull(), True).otherwise(broken)).drop("problem")
