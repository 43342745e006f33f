"""Named transports and formats: files, Kafka, HTTP, as configured sources and sinks.

A connector is a transport plus a format, looked up in two registries that are
open for extension.  Kafka needs Spark's Kafka package on the class path; its
options are checked and mapped here without it.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources import csv_format
from tidewheel.zset import W, data_columns, weighted

Config = dict[str, Any]


def kafka_options(config: Config, reading: bool) -> dict[str, str]:
    """Options of Spark's Kafka source or sink from a client configuration.

    Reading needs ``topics``, writing ``topic``.  Offsets belong to the query's
    checkpoint, so automatic commits must be off.
    """
    if str(config.get("enable.auto.commit", "false")).lower() == "true":
        raise ValueError("enable.auto.commit must be off: offsets are kept in the checkpoint")
    own = {"topics", "topic", "enable.auto.commit", "max_inflight_messages", "group_join_timeout_secs"}
    out = {f"kafka.{k}": str(v) for k, v in config.items() if k not in own}
    if "bootstrap.servers" not in config:
        raise ValueError("bootstrap.servers is missing")
    if reading:
        topics = config.get("topics") or []
        if not topics:
            raise ValueError("topics is missing")
        return out | {"subscribe": ",".join(topics)}
    if not config.get("topic"):
        raise ValueError("topic is missing")
    return out | {"topic": config["topic"], "kafka.max.in.flight.requests.per.connection": str(config.get("max_inflight_messages", 1000))}


def _read_file(spark: SparkSession, config: Config, schema: str, format: str = "csv") -> DataFrame:
    if format != "csv":
        reader = spark.readStream if config.get("follow") else spark.read
        return FORMATS[format][0](reader.text(config["path"]), "value", schema)
    if config.get("follow"):
        return weighted(spark.readStream.schema(schema).option("header", "false").csv(config["path"]))
    return csv_format.read_csv(spark, config["path"], schema)


def _read_kafka(spark: SparkSession, config: Config, schema: str, format: str = "csv") -> DataFrame:
    lines = spark.readStream.format("kafka").options(**kafka_options(config, True)).load().select(F.col("value").cast("string"))
    return FORMATS[format][0](lines, "value", schema)


def _write_file(df: DataFrame, config: Config, format: str = "csv") -> None:
    if format != "csv":
        FORMATS[format][1](df).write.mode(config.get("mode", "append")).text(config["path"])
        return
    csv_format.write_csv(df, config["path"], config.get("mode", "append"))


def _write_kafka(df: DataFrame, config: Config, format: str = "csv") -> None:
    FORMATS[format][1](df).write.format("kafka").options(**kafka_options(config, False)).save()


class HttpInbox:
    """A small HTTP front end: POST /input/<name> with CSV lines, GET /output/<name> for the last change, a JSON line per row.

    Lines wait in memory (at most ``limit``; beyond it the client gets 429 and
    must send again) until ``drain`` turns them into the next tick's rows.
    """

    def __init__(self, port: int = 0, limit: int = 1_000_000):
        self.lines: dict[str, list[str]] = {}
        self.results: dict[str, DataFrame] = {}
        self.limit, self.lock = limit, threading.Lock()
        inbox = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:  # noqa: N802
                name = self.path.rpartition("/")[2]
                body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
                new = [x for x in body.split("\n") if x]
                with inbox.lock:
                    held = inbox.lines.setdefault(name, [])
                    full = len(held) + len(new) > inbox.limit
                    if not full:
                        held += new
                self.send_response(429 if full else 200)
                self.end_headers()

            def do_GET(self) -> None:  # noqa: N802
                rows = inbox.results.get(self.path.rpartition("/")[2])
                self.send_response(200)
                self.end_headers()
                # partition by partition, so neither side holds the whole
                for r in rows.toLocalIterator() if rows is not None else ():
                    self.wfile.write((json.dumps(r.asDict(), default=str) + "\n").encode())

            def log_message(self, *_: Any) -> None:
                return

        self.server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def drain(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        with self.lock:
            lines = self.lines.pop(name, [])
        return csv_format.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value", schema)

    def publish(self, name: str, delta: DataFrame) -> None:
        """Offers a change, all its rows with their weights, to clients until the next one."""
        self.results[name] = delta.select(*data_columns(delta), W)

    def close(self) -> None:
        self.server.shutdown()


READERS: dict[str, Callable[..., DataFrame]] = {"file": _read_file, "kafka": _read_kafka}
WRITERS: dict[str, Callable[..., None]] = {"file": _write_file, "kafka": _write_kafka}
# Formats: how lines become rows, and rows lines.  Open for extension.
FORMATS: dict[str, tuple[Callable[[DataFrame, str, str], DataFrame], Callable[[DataFrame], DataFrame]]] = {"csv": (csv_format.parse_lines, csv_format.encode)}


def register_format(name: str, parse: Callable[[DataFrame, str, str], DataFrame], encode: Callable[[DataFrame], DataFrame]) -> None:
    """A format by name: ``parse(lines, column, schema)`` gives weighted rows, ``encode(rows)`` one column of lines."""
    FORMATS[name] = (parse, encode)


def register_transport(name: str, read: Callable[..., DataFrame] | None = None, write: Callable[..., None] | None = None) -> None:
    """A transport by name: ``read(spark, config, schema, format)`` and ``write(df, config, format)``."""
    if read:
        READERS[name] = read
    if write:
        WRITERS[name] = write



def open_source(spark: SparkSession, transport: str, config: Config, schema: str, format: str = "csv") -> DataFrame:
    """The rows of a configured endpoint, with weights."""
    if format not in FORMATS:
        raise KeyError(f"unknown format {format!r}; known: {sorted(FORMATS)}")
    return READERS[transport](spark, config, schema, format)


def write_sink(df: DataFrame, transport: str, config: Config, format: str = "csv") -> None:
    """Writes a change with its weights to a configured endpoint."""
    if format not in FORMATS:
        raise KeyError(f"unknown format {format!r}; known: {sorted(FORMATS)}")
    WRITERS[transport](df, config, format)
