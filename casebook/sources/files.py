"""Files in and tables out: raw payloads with their hashes, and date-partitioned event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from casebook.errors import PayloadTooLargeError, ValidationError
from casebook.functions.hashing import sha256

MAX_BODY_BYTES = 1_048_576
MAX_HEADER_BYTES = 256
# Content types by file ending.
CONTENT_TYPES = {"json": "application/json", "ndjson": "application/json", "csv": "text/csv", "log": "text/syslog", "syslog": "text/syslog"}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one payload: path, content (binary), payload (text), content_type by its ending."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("*", F.decode("content", "UTF-8").alias("payload"), content_type(F.col("path")).alias("content_type"))


def content_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ending), F.lit("application/octet-stream"))


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Each line of text files as one payload, for line-oriented sources too large to hold as one."""
    return spark.read.text(path).select(F.col("value").alias("payload"), F.lit(kind).alias("content_type"))


def raw_events(payloads: DataFrame, received_at: Column, source_id: str = "api", source_type: str = "direct", source_name: str | None = None, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """The raw table: content with hash, size, source and time. The id follows from content and source."""
    if any(len((v or "").encode()) > MAX_HEADER_BYTES for v in (source_id, source_type, source_name)):
        raise ValidationError(f"source fields have at most {MAX_HEADER_BYTES} bytes")
    content = F.coalesce(F.col("content"), F.encode("payload", "UTF-8")) if "content" in payloads.columns else F.encode("payload", "UTF-8")
    named = payloads.withColumns(
        {
            "content": content, "source_id": F.lit(source_id), "source_type": F.lit(source_type), "source_name": F.lit(source_name).cast("string"),
            "received_at": received_at.cast("timestamp_ntz"),
        }
    )
    return named.withColumns({"content_hash": sha256(F.col("content")), "byte_size": F.octet_length("content").cast("int"), "raw_event_id": F.abs(F.xxhash64("content", "source_id"))})


def require_sizes(raw: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> None:
    if raw.where(F.col("byte_size") > max_bytes).select("byte_size").first() is not None:
        raise PayloadTooLargeError(f"a payload has more than {max_bytes} bytes")


def bloomed(writer: DataFrameWriter, *columns: str) -> DataFrameWriter:
    """Parquet with a Bloom filter of some columns for each row group, by which a lookup of one value passes over the groups without it, although ids and hashes are in no order."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as a row group's values need


def write_raw(raw: DataFrame, path: str) -> None:
    rows = raw.withColumn("received_date", F.to_date("received_at"))
    bloomed(rows.write.mode("append").partitionBy("received_date"), "raw_event_id", "content_hash").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends by date; ranges of (date, time) make the tasks, so a full day has many, and rows are in time order so that statistics prune."""
    from casebook.operators.normalize import stored

    rows = stored(events)
    ordered = rows.repartitionByRange("occurred_date", "occurred_at", "event_id").sortWithinPartitions("occurred_date", "occurred_at", "event_id")
    bloomed(ordered.write.mode("append").partitionBy("occurred_date"), "event_id").parquet(path)


def raw_by_id(raw: DataFrame, raw_event_id: object) -> DataFrame:
    return raw.where(F.col("raw_event_id") == raw_event_id)


def raw_by_hash(raw: DataFrame, content_hash: str) -> DataFrame:
    return raw.where(F.col("content_hash") == content_hash).orderBy("raw_event_id").limit(1)


def repeated_payloads(raw: DataFrame) -> DataFrame:
    """content_hash, n_payloads, first_id of contents that came more than once."""
    return raw.groupBy("content_hash").agg(F.count("*").alias("n_payloads"), F.min("raw_event_id").alias("first_id")).where("n_payloads > 1")
