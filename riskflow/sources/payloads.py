"""Payload sources (S5, S6): the messages of a topic as rows (topic, message_key, value, sent_at).

A topic is the folder ``<root>/<topic>``; its files come in one of three formats:

* ``records``  Parquet rows (key binary, value binary, sent_at timestamp), as a log connector dumps them;
* ``lines``    text files, one payload a line; blank lines are no payload;
* ``files``    every file is one payload, its name the key.

``value`` is bytes in all of them, so that text which is not UTF-8 reaches the
parser, and the dead letter, as it came.  A missing key is null.  The frame has
the shape of a log connector's, whose ``key``, ``value``, ``topic`` and ``timestamp``
columns take its place where one is deployed.

A stream starts at the earliest message, at a time, or at the moment of its
first start ("latest").  That moment is kept beside the checkpoint, so a restart
does not skip what arrived while the stream was down.  ``records`` are judged
by their own ``sent_at`` (a filter that reaches the Parquet scan), the other formats by the
time their file was written (a filter that prunes whole files).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ["records", "lines", "files"]
RECORDS = "key binary, value binary, sent_at timestamp"
EARLIEST, LATEST = "earliest", "latest"


@dataclass(frozen=True)
class SourceOptions:
    """Format, start position and poll size of a payload source; at most one of the poll sizes."""

    format: str = "records"
    starting: str = EARLIEST
    max_files: int | None = None
    max_bytes: int | None = None

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}: {self.format}")
        if self.starting not in (EARLIEST, LATEST):
            dt.datetime.fromisoformat(self.starting)  # raises on any other text
        for name in ("max_files", "max_bytes"):
            v = getattr(self, name)
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be > 0")
        if self.max_files is not None and self.max_bytes is not None:
            raise ValueError("give max_files or max_bytes, not both")

    @staticmethod
    def from_env(e: Mapping[str, str]) -> "SourceOptions":
        return SourceOptions(
            e.get("PAYLOAD_FORMAT", "records"),
            e.get("STARTING_POSITION", EARLIEST),
            int(e["MAX_FILES_PER_POLL"]) if "MAX_FILES_PER_POLL" in e else None,
            int(e["MAX_BYTES_PER_POLL"]) if "MAX_BYTES_PER_POLL" in e else None,
        )


def topic_folder(spark: SparkSession, root: str, topic: str) -> str:
    """The folder of a topic; a topic that nobody wrote to is an empty one."""
    folder = f"{root.rstrip('/')}/{topic}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def start_time(spark: SparkSession, options: SourceOptions, location: str) -> dt.datetime | None:
    """The time that a stream starts from (None: all messages), the same one at every restart."""
    if options.starting == EARLIEST:
        return None
    if options.starting != LATEST:
        at = dt.datetime.fromisoformat(options.starting)
        return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    path = f"{location.rstrip('/')}/start"
    now = spark.range(1).select(F.current_timestamp().alias("at"))
    now.coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("at timestamp").parquet(path).select(F.unix_micros("at")).first()[0]


def payloads(spark: SparkSession, root: str, topic: str, options: SourceOptions = SourceOptions(), location: str | None = None,
             streaming: bool = True) -> DataFrame:
    """The messages of a topic, as a stream or (``streaming=False``) as a table; ``location`` keeps the start of a "latest" stream."""
    folder = topic_folder(spark, root, topic)
    if options.starting == LATEST and location is None:
        raise ValueError("a stream from the latest message needs a location to keep its start")
    reader = spark.readStream if streaming else spark.read
    if streaming and options.max_files is not None:
        reader = reader.option("maxFilesPerTrigger", options.max_files)
    if streaming and options.max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", options.max_bytes)
    written = F.col("_metadata.file_modification_time")
    if options.format == "records":
        rows, key, value, sent = reader.schema(RECORDS).parquet(folder), F.col("key").cast("string"), F.col("value"), F.col("sent_at")
    elif options.format == "lines":
        rows = reader.format("text").load(folder).where(F.trim("value") != "")
        key, value, sent = F.lit(None).cast("string"), F.col("value").cast("binary"), written
    else:
        schema = "path string, modificationTime timestamp, length long, content binary"
        rows = reader.format("binaryFile").schema(schema).load(folder)
        key, value, sent = F.element_at(F.split("path", "/"), -1), F.col("content"), F.col("modificationTime")
    start = start_time(spark, options, location or "")
    if start is not None:
        rows = rows.where(sent >= (F.timestamp_micros(F.lit(start)) if isinstance(start, int) else F.lit(start)))
    return rows.select(F.lit(topic).alias("topic_read"), key.alias("message_key"), value.alias("value"), sent.alias("sent_at"))


def publish_records(df: DataFrame, root: str, topic: str) -> None:
    """Append (key, value, sent_at) rows to a topic in the ``records`` format."""
    df.selectExpr("CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value", "CAST(sent_at AS TIMESTAMP) AS sent_at") \
        .write.mode("append").parquet(topic_folder(df.sparkSession, root, topic))
