"""Connectors to systems outside: one interface for reading and writing, batch or streaming."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.plans.metrics import with_metrics


class ConnectorError(Exception):
    """What went wrong with a system outside."""


class ConnectionFailed(ConnectorError):
    pass


class AuthenticationFailed(ConnectorError):
    pass


class InvalidConfiguration(ConnectorError):
    pass


class SerializationError(ConnectorError):
    pass


class Unsupported(ConnectorError):
    pass


class ConnectorTimeout(ConnectorError):
    pass


class ResourceExhausted(ConnectorError):
    pass


class InputOutput(ConnectorError):
    pass


class NotFound(ConnectorError):
    pass


class PermissionDenied(ConnectorError):
    pass


class ConnectorSpecific(ConnectorError):
    pass


class Multiple(ConnectorError):
    """Several errors at once."""

    def __init__(self, errors: Sequence[ConnectorError]):
        super().__init__("; ".join(map(str, errors)))
        self.errors = list(errors)


def connector_error(error: BaseException) -> ConnectorError:
    """The kind of ConnectorError that an error of Python or of the file system is."""
    if isinstance(error, ConnectorError):
        return error
    if isinstance(error, BaseExceptionGroup):
        return Multiple([connector_error(e) for e in error.exceptions])
    kinds = {
        FileNotFoundError: NotFound, PermissionError: PermissionDenied, TimeoutError: ConnectorTimeout, ConnectionError: ConnectionFailed,
        MemoryError: ResourceExhausted, OSError: InputOutput, NotImplementedError: Unsupported, UnicodeError: SerializationError, ValueError: InvalidConfiguration,
    }
    kind = next((k for e, k in kinds.items() if isinstance(error, e)), ConnectorSpecific)
    return kind(str(error))


@dataclass(frozen=True)
class CommonConfig:
    batch_size: int = 100
    timeout_ms: int = 30_000
    retries: int = 3
    compression: bool = False


class StreamConnector(ABC):
    """A system that rows come from and go to."""

    name = "connector"

    @abstractmethod
    def read(self, spark: SparkSession, streaming: bool = False) -> DataFrame: ...

    @abstractmethod
    def write(self, df: DataFrame) -> dict[str, Any]: ...

    def health_check(self) -> bool:
        return True

    def metadata(self) -> dict[str, Any]:
        return {"name": self.name}


class BidirectionalConnector(StreamConnector):
    """A system whose answers to what is written can be read."""

    @abstractmethod
    def exchange(self, df: DataFrame) -> DataFrame:
        """Write df and read what comes back."""


class MemoryConnector(StreamConnector):
    """Rows in a driver-side list, for tests."""

    name = "memory"

    def __init__(self, schema: str, rows: list[tuple] | None = None):
        self.schema, self.rows = schema, list(rows or [])

    def read(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        if streaming:
            raise Unsupported("memory is read at once")
        return spark.createDataFrame(self.rows, self.schema)

    def write(self, df: DataFrame) -> dict[str, Any]:
        new = [tuple(r) for r in df.collect()]
        self.rows += new
        return {"produced": len(new)}


class FileConnector(StreamConnector):
    """Files of a format Spark reads: parquet, orc, json, csv, text. Streams need a schema."""

    name = "file"
    FORMATS = ("parquet", "orc", "json", "csv", "text")

    def __init__(self, path: str, fmt: str = "parquet", schema: str | None = None, options: dict[str, str] | None = None):
        if fmt not in self.FORMATS:
            raise InvalidConfiguration(f"unknown format {fmt}")
        self.path, self.fmt, self.schema, self.options = path, fmt, schema, options or {}

    def read(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        if streaming and self.schema is None and self.fmt != "text":
            raise InvalidConfiguration("a stream of files needs a schema")
        reader = (spark.readStream if streaming else spark.read).format(self.fmt).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)

    def write(self, df: DataFrame, mode: str = "append") -> dict[str, Any]:
        df.write.format(self.fmt).options(**self.options).mode(mode).save(self.path)
        return {"path": self.path}


class JdbcConnector(StreamConnector):
    """A database table, read in parallel over a numeric column if bounds are given."""

    name = "jdbc"

    def __init__(self, url: str, table: str, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 1):
        if not url.startswith("jdbc:") or not table:
            raise InvalidConfiguration("a JDBC connector needs a jdbc: address and a table")
        self.options = {"url": url, "dbtable": table}
        if column is not None and lower is not None and upper is not None:
            self.options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}

    def read(self, spark: SparkSession, streaming: bool = False) -> DataFrame:
        if streaming:
            raise Unsupported("a table is read at once")
        return spark.read.format("jdbc").options(**self.options).load()

    def write(self, df: DataFrame) -> dict[str, Any]:
        df.write.format("jdbc").options(**self.options).mode("append").save()
        return {"table": self.options["dbtable"]}


@dataclass(frozen=True)
class KafkaConfig:
    """Options of a topic. Reading needs the Kafka package of Spark on the class path."""

    servers: str
    topic: str
    group_id: str | None = None
    from_beginning: bool = False
    partition: int | None = None
    offsets_per_trigger: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def checked(self) -> KafkaConfig:
        if not self.servers or not self.topic:
            raise InvalidConfiguration("Kafka needs servers and a topic")
        return self

    def read_options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.servers, "startingOffsets": "earliest" if self.from_beginning else "latest", "failOnDataLoss": "false"}
        if self.partition is None:
            out["subscribe"] = self.topic
        else:
            out["assign"] = f'{{"{self.topic}":[{self.partition}]}}'
        if self.group_id:
            out["kafka.group.id"] = self.group_id
        if self.offsets_per_trigger is not None:
            out["maxOffsetsPerTrigger"] = str(self.offsets_per_trigger)
        return out | self.extra

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic} | self.extra


def decoded(df: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON in value; those that can't be read as the schema are left out."""
    parsed = df.select(F.from_json(F.col("value").cast("string"), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("v"))
    return parsed.where("v IS NOT NULL AND v._bad IS NULL").select("v.*").drop("_bad")


def encoded(df: DataFrame) -> DataFrame:
    """Rows as key and JSON value; the key is what stands before the first '-' of the first string column, if any."""
    text = next((n for n, t in df.dtypes if t == "string"), None)
    key = F.split(F.col(f"`{text}`"), "-")[0] if text else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))


class KafkaConnector(StreamConnector):
    name = "kafka"

    def __init__(self, config: KafkaConfig, schema: str):
        self.config, self.schema = config.checked(), schema

    def read(self, spark: SparkSession, streaming: bool = True) -> DataFrame:
        reader = (spark.readStream if streaming else spark.read).format("kafka").options(**self.config.read_options())
        return decoded(reader.load(), self.schema)

    def write(self, df: DataFrame) -> dict[str, Any]:
        """Write and report rows produced, bytes of their values, and rows a second."""
        observed, seen = with_metrics(encoded(df), f"kafka-{self.config.topic}", F.octet_length("value"))
        began = time.monotonic()
        observed.write.format("kafka").options(**self.config.write_options()).save()
        got = seen.get
        return {"topic": self.config.topic, "produced": got["items"], "bytes": got["bytes"], "per_second": got["items"] / max(1e-9, time.monotonic() - began)}

    def metadata(self) -> dict[str, Any]:
        return {"name": self.name, "topic": self.config.topic, "servers": self.config.servers}
