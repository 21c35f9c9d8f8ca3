r"""Zstandard web archives (.warc.zst): written by Spark's own file writer, read record by record.

An archive is a dictionary in a leading skippable frame and then one frame a record, so a reader needs no more than the dictionary and a frame
to have a record. `read` walks the frames' block headers, decodes one frame at a time, and checks of each record its version line, required headers,
block and payload length, and digests; what is wrong with a record is in ``problem``, the others of its archive are still returned.

`write` decides which records are revisits: of equal payloads of at least ``LEAST_BYTES`` the one with the smallest id is a response, the others name it
and hold the response's headers without the payload. Digests are grouped with map-side minima, and the groups of several records go back to
the rows with a salt, so a payload that a third of the rows share is dealt to many tasks; payloads themselves are not grouped. Tasks fill archives of
up to ``ARCHIVE_BYTES``; each is one value, written through Spark's text source to a file of its own (any store, with Spark's commit of
tasks, so lost executors leave no half archive). That source ends a file with a line feed, which is the content of a last skippable frame.

The dictionary is trained on the ``SAMPLE_ROWS`` payloads with the smallest hashes, ``SAMPLE_BYTES`` of each; where too few can be had, archives have
none, and the reader takes both. It takes dictionaries that are compressed themselves, too. An archive is read whole by one task, so it must be below 2 GB.

Defined cases: a null payload is an empty one, a null url is no target. Rows without an id are responses if no row with an id has their payload, else
revisits; ids that are not unique: every row with the smallest id of its payload is a response. Control characters in urls and ids are written percent-encoded, and ``%`` in ids.
An empty table makes no archive. Very long payloads make an archive of their own. Only the id, url and payload columns are read, so other
columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 100
SALTS = 16
ARCHIVE_BYTES = 1 << 24
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 13, 1 << 16
BATCH_BYTES = 1 << 23
#: Fixed values of the formats.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x50\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
EMPTY_END = SKIPPABLE_MAGIC + struct.pack("<I", 1)  # a skippable frame of one byte, the line feed that follows
SHAPE = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, problem string"
HEADER_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
CONTROL = re.compile(r"[\x00-\x20\x7f]")


# ---- writing -----------------------------------------------------------------------------------


def decided(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = LEAST_BYTES, salts: int = SALTS) -> DataFrame:
    """id, url, payload (binary), digest, refers_to (null: a response)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("shared", F.octet_length("payload") >= least_bytes)
    groups = rows.where("shared").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    spread = groups.select(F.col("digest").alias("of"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")
    met = rows.withColumn("salt", salt).join(spread, F.col("shared") & (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))
    return met.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def train(df: DataFrame, payload_col: str, rows: int = SAMPLE_ROWS, cut: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample, which depends on the payloads alone; empty where it cannot be trained."""
    start = F.substring(F.col(payload_col).cast("binary"), 1, cut)
    hashed = df.where(F.length(payload_col) > 0).select(start.alias("start")).withColumn("hash", F.xxhash64("start"))
    # hashes first, so that no task sends more than its part of the sample to the driver
    least = [r["hash"] for r in hashed.select("hash").distinct().orderBy("hash").limit(rows).collect()]
    some = hashed.where(F.col("hash").isin(least)).groupBy("hash").agg(F.min("start").alias("start")).orderBy("hash") if least else hashed.limit(0)
    try:
        return zstandard.train_dictionary(size, [bytes(r["start"]) for r in some.collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_uri(scheme: str, id_: object) -> str:
    return f"<urn:{scheme}:{quote(str(id_), safe='')}>"


def record(id_: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str, scheme: str) -> bytes:
    """One record: WARC headers, the response's headers, and the payload unless it refers to another."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    own = record_uri(scheme, id_) if id_ is not None else f"<urn:sha256:{hashlib.sha256(block + (url or '').encode()).hexdigest()}>"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": own,
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else CONTROL.sub(lambda c: quote(c[0]), url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Refers-To": record_uri(scheme, refers_to) if revisit else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archives(batches: Iterator[pa.RecordBatch], dictionary: bytes, date: str, scheme: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Whole archives as values, each with its dictionary in front."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compress = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True).compress
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    head = DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed if dictionary else b""

    def closed(frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *frames, EMPTY_END])], pa.binary())], ["archive"])

    frames: list[bytes] = []
    size = 0
    for batch in batches:
        for columns in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
            frame = compress(record(*(c.as_py() for c in columns), date, scheme))
            if frames and size + len(frame) > archive_bytes:
                yield closed(frames)
                frames, size = [], 0
            frames.append(frame)
            size += len(frame)
    if frames:
        yield closed(frames)


def write(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", scheme: str = "page", date: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES, salts: int = SALTS,
) -> None:
    """Writes a record a row to archives under ``path``."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    task = partial(_archives, dictionary=train(df, payload_col), date=date, scheme=scheme, archive_bytes=archive_bytes)
    archives = decided(df, id_col, url_col, payload_col, least_bytes, salts).mapInArrow(task, "archive binary")
    # one value a file; the text source writes the bytes of a string as they are
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# ---- reading -----------------------------------------------------------------------------------


class Broken(ValueError):
    """What is wrong with an archive or a record."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its header and the headers of its blocks."""
    try:
        if data[at + 1 : at + 4] == SKIPPABLE_MAGIC[1:] and data[at] >> 4 == 5:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            if data[at : at + 4] != FRAME_MAGIC:
                raise Broken("no frame")
            head = bytes(data[at : at + 18])
            end, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise Broken("frame is cut off")
                last, kind = bool(block & 1), block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)  # a run of one byte has only that byte
            end += 4 * checksum
    except (struct.error, IndexError, zstandard.ZstdError) as e:
        raise Broken("no frame") from e
    if end > len(data):
        raise Broken("frame is cut off")
    return end


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and where its records start."""
    if data[:4] != DICTIONARY_MAGIC:
        return None, 0
    end = frame_end(data, 0)
    content = bytes(data[8:end])
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return zstandard.ZstdCompressionDict(content), end


def parsed_headers(lines: list[bytes], strict: bool = True) -> dict[str, str]:
    """Names in lower case; a line that starts with a blank continues the one before it. Not ``strict``: malformed lines are passed over."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif colon and HEADER_NAME.fullmatch(name):
            last = name.decode().lower()
            out[last] = value.strip().decode("utf-8", "replace")
        elif strict:
            raise Broken("malformed header")
    return out


def plain_id(uri: str | None) -> str | None:
    """What stands behind the scheme of <urn:scheme:id>."""
    return None if uri is None else unquote(uri.strip("<>").split(":", 2)[-1])


def parsed(raw: bytes) -> tuple[dict, bytes | None]:
    """The columns of a record and its payload (None of a revisit)."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/[0-9]+\.[0-9]+", version):
        raise Broken("no version line")
    headers = parsed_headers(lines)
    missing = [h for h in REQUIRED if not headers.get(h)]
    if missing:
        raise Broken(f"no {missing[0]}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4:
        raise Broken("block length differs")
    block, end = rest[:-4], rest[-4:]
    if end != b"\r\n\r\n":
        raise Broken("no end of record")
    wanted = headers.get("warc-block-digest")
    if wanted and wanted.startswith("sha256:") and wanted[7:] != hashlib.sha256(block).hexdigest():
        raise Broken("block digest differs")
    kind, payload, size = headers["warc-type"], block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Broken("no end of response headers")
        told = parsed_headers(http.split(b"\r\n")[1:], strict=False).get("content-length")
        size = int(told) if told is not None and told.isdecimal() else len(payload)
        if kind != "revisit" and size != len(payload):
            raise Broken("payload length differs")
    digest = headers.get("warc-payload-digest", "")
    if kind == "revisit":
        if not headers.get("warc-refers-to"):
            raise Broken("revisit of nothing")
        payload = None
    elif digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        raise Broken("payload digest differs")
    elif not digest.startswith("sha256:"):
        digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    row = {
        "record_id": plain_id(headers["warc-record-id"]), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "refers_to": plain_id(headers.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest.removeprefix("sha256:") or None, "problem": None,
    }
    return row, payload


def records(data: bytes) -> Iterator[tuple[int, dict, bytes | None]]:
    """offset, columns and payload of each record; a frame that cannot be delimited ends the archive with one problem."""
    view = memoryview(data)
    blank = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "problem"))
    at = 0
    try:
        dictionary, at = leading_dictionary(view)
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (Broken, zstandard.ZstdError) as e:
        yield at, blank | {"problem": f"dictionary: {e}"}, None
        return
    while at < len(view):
        try:
            end = frame_end(view, at)
        except Broken as e:
            yield at, blank | {"problem": str(e)}, None
            return
        if view[at : at + 4] == FRAME_MAGIC:
            try:
                row, payload = parsed(decoder.decompressobj().decompress(view[at:end]))
            except Broken as e:
                row, payload = blank | {"problem": str(e)}, None
            except zstandard.ZstdError:
                row, payload = blank | {"problem": "frame cannot be decoded"}, None
            yield at, row, payload
        at = end


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows: list[dict] = []
            size = 0
            for offset, row, payload in records(content.as_py()):
                rows.append({"archive": name.as_py(), "offset": offset, **row, "payload": payload})
                size += 500 + (len(payload or b"") if "payload" in schema.names else 0)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """archive, offset, record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest (of the full payload, also of a revisit), problem, and payload."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = SHAPE + (", payload binary" if payloads else "")
    schema = to_arrow_schema(StructType.fromDDL(shape))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_read, schema=schema), shape)


def resolved(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` of `read` with the payload of its response in the place of a revisit's; ``problem`` names a reference that leads to none or to another payload."""
    from_ = rows.where("record_type <> 'revisit' and problem is null").select(F.col("record_id").alias("to"), F.col("payload").alias("found"), F.col("payload_digest").alias("found_digest"))
    wanted = rows.where("record_type = 'revisit' and problem is null").select(F.col("refers_to").alias("to")).distinct()
    spread = from_.join(wanted, "to", "left_semi").dropDuplicates(["to"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    revisits = rows.where("record_type = 'revisit' and problem is null").withColumn("salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(salts)).cast("int"))
    met = revisits.join(spread, (F.col("refers_to") == F.col("to")) & (revisits["salt"] == spread["salt"]), "left")
    wrong = F.when(F.col("found_digest").isNull(), "reference leads to no response").when(F.col("found_digest") != F.col("payload_digest"), "response has another payload")
    filled = met.withColumn("problem", wrong).withColumn("payload", F.when(F.col("problem").isNull(), F.col("found")))
    return rows.where("not (record_type <=> 'revisit') or problem is not null").unionByName(filled.select(*rows.columns))
