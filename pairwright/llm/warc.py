"""Pages as WARC records in Zstandard archives, and a reader that checks what it reads.

An archive is a file of Zstandard frames. The first is a skippable frame that holds the dictionary
(itself a frame, or plain); every record is one further frame, compressed with that dictionary, so
records can be decoded one by one and a damaged one spoils no other. Other skippable frames are
passed over, as the format demands.

Writing: Spark's text writer puts out the frames as they are, through any file system and its
commit protocol; its line separator is an empty skippable frame. Each partition becomes one
archive. Payloads move only where their copies are too many to broadcast (``revisits``).

Reading: an archive is read by one task, like any compressed file, and its frames are decoded one
after the other; what is held is the archive and one record. Archives are at most 2 GB
each, the limit of Spark's reader of binary files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.shared import stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: A skippable frame of no bytes: what stands between two records.
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Copied payloads up to which their table is broadcast: a digest, a check and an id each.
BROADCAST_ROWS = 100_000
SALTS = 16
RECORD_SCHEMA = (
    "archive string, position long, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, error string"
)


@dataclass(frozen=True)
class WarcSettings:
    #: Payloads of fewer bytes are never revisits.
    least_bytes: int = 1000
    level: int = 3
    dictionary_bytes: int = 32 << 10
    #: The dictionary is trained on so many pages at most, of at most so many bytes each.
    sample_pages: int = 300
    sample_bytes: int = 32 << 10
    date: str = "1970-01-01T00:00:00Z"


class RecordError(ValueError):
    """A frame or a record that is not as the formats demand."""


def _line(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {value}\r\n"


def _uri(text: str | None) -> str | None:
    """What may stand in a header: other bytes than printable ASCII are escaped."""
    return None if text is None else quote(text, safe="!#$%&'()*+,/:;=?@[]~")


def record_bytes(
    key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str
) -> bytes:
    """A response with its payload, or a revisit that leaves the payload out but tells its length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = (
        "WARC/1.1\r\n"
        + _line("WARC-Type", "response" if refers_to is None else "revisit")
        + _line("WARC-Record-ID", _urn(key))
        + _line("WARC-Date", date)
        + _line("WARC-Target-URI", _uri(url))
        + _line("WARC-Payload-Digest", f"sha1:{digest}")
        + (_line("WARC-Profile", IDENTICAL) + _line("WARC-Refers-To", _urn(refers_to)) if refers_to is not None else "")
        + _line("Content-Type", "application/http;msgtype=response")
        + _line("Content-Length", str(len(block)))
        + "\r\n"
    )
    return head.encode("ascii") + block + b"\r\n\r\n"


def _urn(key: str | None) -> str:
    return "<urn:page>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def key_of_urn(urn: str | None) -> str | None:
    """The id in a name made by this module; null for others."""
    if not urn or not urn.startswith("<urn:page:") or not urn.endswith(">"):
        return None
    return unquote(urn[10:-1])


# Frames


def _number(data: memoryview, at: int, size: int) -> int:
    if at + size > len(data):
        raise RecordError("the archive ends inside a frame")
    return int.from_bytes(data[at : at + size], "little")


def frame_end(data: memoryview, start: int) -> int:
    """Where the frame that begins at ``start`` ends, found by its block headers alone."""
    magic = _number(data, start, 4)
    if magic in SKIPPABLE_MAGICS:
        end = start + 8 + _number(data, start + 4, 4)
    elif magic == FRAME_MAGIC:
        try:
            at = start + zstandard.frame_header_size(bytes(data[start : start + 18]))
            checksum = zstandard.get_frame_parameters(bytes(data[start : start + 18])).has_checksum
        except zstandard.ZstdError as e:
            raise RecordError(f"no frame header: {e}") from e
        last = False
        while not last:
            block = _number(data, at, 3)
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise RecordError("a reserved block type")
            at += 3 + (1 if kind == 1 else size)
        end = at + (4 if checksum else 0)
    else:
        raise RecordError(f"no frame begins with {magic:#010x}")
    if end > len(data):
        raise RecordError("the archive ends inside a frame")
    return end


def dictionary_of(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary in a leading skippable frame, compressed or plain."""
    if content[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return zstandard.ZstdCompressionDict(content)


def decode_frames(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, record, error) of every frame that is not skippable.

    The dictionary is that of a first frame with its magic. A frame that cannot be decoded is
    reported and passed over; where no frame begins, the rest is reported as one error.
    """
    data = memoryview(content)
    decoder, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        try:
            end = frame_end(data, at)
        except RecordError as e:
            yield at, None, str(e)
            return
        magic = _number(data, at, 4)
        try:
            if magic == DICTIONARY_MAGIC and at == 0:
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary_of(bytes(data[8:end])))
            elif magic == FRAME_MAGIC:
                yield at, decoder.decompressobj().decompress(data[at:end]), None
        except zstandard.ZstdError as e:
            yield at, None, f"a frame that cannot be decoded: {e}"
        at = end


# Records


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise RecordError("a header line without a name")
        found[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def _length(fields: dict[str, str]) -> int | None:
    text = fields.get("content-length")
    if text is None:
        return None
    if not (text.isascii() and text.isdigit()):
        raise RecordError("a length that is no number")
    return int(text)


def parse_record(record: bytes) -> dict:
    """Type, names, digest and payload of a record, or ``RecordError``.

    Checked are the version, the required headers, the length of the block and the two line breaks
    behind it; of HTTP responses also their own length and the SHA-1 digest of the payload, in
    hexadecimal or base 32.
    """
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in VERSIONS:
        raise RecordError("no WARC header")
    fields = _fields(lines)
    if missing := [name for name in REQUIRED if not fields.get(name)]:
        raise RecordError(f"missing header {missing[0]}")
    size = _length(fields)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise RecordError(f"the block has {len(rest) - 4} bytes where its header says {size}")
    kind, told = fields["warc-type"], fields.get("warc-payload-digest")
    digest, payload, length = None, None, None
    if told:
        algorithm, _, digest = told.rpartition(":")
        if algorithm.lower() in ("", "sha1") and len(digest) == 32:
            digest = base64.b32decode(digest.upper()).hex()
        digest = digest.lower()
    if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http"):
        http, gap, body = rest[:size].partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise RecordError("no HTTP header")
        length = _length(_fields(http.split(b"\r\n")[1:]))
        if kind == "response":
            if length is not None and length != len(body):
                raise RecordError(f"the payload has {len(body)} bytes where its header says {length}")
            payload, length, own = body, len(body), hashlib.sha1(body).hexdigest()
            if told and algorithm.lower() in ("", "sha1") and digest != own:
                raise RecordError("the payload has another digest than its header says")
            digest = own
    return {
        "record_type": kind,
        "record_id": fields["warc-record-id"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload,
    }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, keep_errors: bool = False) -> DataFrame:
    """A row for each record of the archives at ``path``: see ``RECORD_SCHEMA``.

    ``position`` is the frame's offset in its archive. A damaged frame or record ends the job,
    or with ``keep_errors`` is a row of ``archive``, ``position`` and ``error``. Empty
    archives give no rows. Payloads are null for revisits, and for all without ``with_payload``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema(
        [(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in map(str.split, RECORD_SCHEMA.split(", "))]
    )

    def rows_of(archive: str, content: bytes) -> Iterator[dict]:
        for position, record, error in decode_frames(content):
            row = {"archive": archive, "position": position}
            if error is None:
                try:
                    row |= parse_record(record)
                except (RecordError, ValueError) as e:
                    error = str(e)
            if error is not None:
                if not keep_errors:
                    raise RecordError(f"{archive} at {position}: {error}")
                row["error"] = error
            if not with_payload:
                row["payload"] = None
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                for row in rows_of(archive.as_py(), content.as_buffer()):
                    held.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(run, RECORD_SCHEMA)


# Writing


def _payloads(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "utf-8")
    named = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), body.alias("payload"))
    return named.withColumns(
        {"bytes": F.octet_length("payload"), "digest": F.sha1("payload"), "check": F.xxhash64("payload")}
    )


def revisits(payloads: DataFrame, least_bytes: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``payloads`` with ``refers_to``: the largest id of an equal payload, null where it is the row's own.

    Equal are payloads of one length, SHA-1 digest and second hash. Rows that repeat the largest id
    are all responses; rows without an id revisit any that has one. Digests alone are shuffled,
    counted in tasks before. The table of copied digests is broadcast up to
    ``broadcast_rows``; beyond, the ids of the copies are found by a salted join of ids and
    digests, and joined to the payloads by id, of which no value is frequent.
    """
    equal = ["bytes", "digest", "check"]
    narrow = payloads.select("id", *equal).where(F.col("bytes") >= least_bytes)
    last = narrow.groupBy(*equal).agg(F.max("id").alias("last"), F.count("*").alias("n"))
    last = stored(last.where((F.col("n") > 1) & F.col("last").isNotNull()).drop("n"), "copied-payloads")
    later = F.col("id").isNull() | (F.col("id") < F.col("last"))
    if last.count() <= broadcast_rows:
        held = payloads.join(F.broadcast(last), equal, "left")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        spread = last.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        copies = narrow.withColumn("salt", salt).join(spread, [*equal, "salt"]).where(later).select("id", *equal, "last").distinct()
        copies = copies.select(F.col("id").alias("copy"), F.col("digest").alias("copied"), F.col("check").alias("checked"), "last")
        same = F.col("id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("copied")) & (F.col("check") == F.col("checked"))
        held = payloads.join(copies, same, "left")
    return held.select(*payloads.columns, F.when(later, F.col("last")).alias("refers_to"))


def train_dictionary(payloads: DataFrame, settings: WarcSettings) -> bytes:
    """A dictionary for records like these, or nothing if there are too few to train one.

    The sample is bounded: pages by a hash, as many as are expected to make up the set number and
    twice that at most, of those that are not too long.
    """
    draw = F.pmod(F.xxhash64("check", F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    usable = payloads.where(F.col("bytes").between(1, settings.sample_bytes))
    usable = usable.where(draw < settings.sample_pages / max(1, payloads.count()))
    sample = usable.select("payload", "digest", F.col("id").cast("string").alias("id")).limit(2 * settings.sample_pages)
    records = [record_bytes(r["id"], None, bytes(r["payload"]), r["digest"], None, settings.date) for r in sample.collect()]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, sorted(records)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    settings: WarcSettings = WarcSettings(),
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Write a record for each page to archives in the folder ``path``, one archive for each partition.

    A null payload is empty, a null url gives no header, a null id a record without one. Of
    equal payloads of ``least_bytes`` and more, that of the largest id is the response and
    the others are revisits of it. Other columns are left out, whatever their names.
    An empty table gives archives without records.
    """
    payloads = _payloads(pages, id_column, url_column, payload_column)
    trained = train_dictionary(payloads, settings)
    records = revisits(payloads, settings.least_bytes, broadcast_rows).select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to")
    )
    date, level = settings.date, settings.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(trained) if trained else None
        coder = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        open_ = _skippable(DICTIONARY_MAGIC, zstandard.ZstdCompressor().compress(trained)) if trained else None
        for batch in batches:
            held = [open_] if open_ else []
            open_ = None
            columns = (batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to"))
            for key, url, payload, digest, refers_to in zip(*columns):
                record = record_bytes(key.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                held.append(coder.compress(record))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    frames = records.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.options(lineSep=SEPARATOR.decode("ascii"), compression="none", maxRecordsPerFile=0).text(path)
