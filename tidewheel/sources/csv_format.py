"""CSV without header: positional parser and encoder, and typed columns with defaults.

Three doors: ``read_csv`` (inserts, weight 1), ``read_csv_typed`` (all text first,
then typed with per-column formats and defaults), and ``encode`` (rows with their
weight as last field).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.operators.joins import default_of
from tidewheel.zset import W, data_columns, weighted


def read_csv(spark: SparkSession, path: str | list[str], schema: str, **options: str) -> DataFrame:
    """Positional records with the given schema, each with weight 1."""
    return weighted(spark.read.options(header="false", **options).schema(schema).csv(path))


@dataclass(frozen=True)
class TypedColumn:
    """A target column: position in the file, type, nullability and date format."""

    name: str
    position: int
    kind: str
    nullable: bool = False
    format: str | None = None

    def parse(self, v: Column) -> Column:
        if self.kind == "string":
            return v if self.nullable else F.coalesce(v, F.lit(""))
        text = F.when(F.lower(F.trim(v)) != "null", F.trim(v))
        if self.kind == "boolean":
            got = F.lower(text).try_cast("boolean")
        elif self.kind == "date" and self.format:
            got = F.to_date(F.try_to_timestamp(text, F.lit(self.format)))
        elif self.kind.startswith("timestamp") and self.format:
            got = F.try_to_timestamp(text, F.lit(self.format)).cast(self.kind)
        else:
            got = text.try_cast(self.kind)
        return got if self.nullable else F.coalesce(got, default_of(self.kind))


def read_csv_typed(spark: SparkSession, path: str, columns: Sequence[TypedColumn], **options: str) -> DataFrame:
    """Text cells cast to their types: a bad value or ``null`` becomes null, or the type's default where nulls are not allowed."""
    width = max(c.position for c in columns) + 1
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    df = spark.read.options(header="false", **options).schema(raw).csv(path)
    return weighted(df.select(*[c.parse(F.col(f"c{c.position}")).alias(c.name) for c in columns]))


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records from a column of CSV text (a stream's payload, say), weight 1."""
    return weighted(lines.select(F.from_csv(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*"))


def encode(df: DataFrame, alias: str = "value") -> DataFrame:
    """One text per record: its fields and, last, its weight."""
    return df.select(F.to_csv(F.struct(*data_columns(df), W)).alias(alias))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records and weights as CSV files without header."""
    df.select(*data_columns(df), W).write.mode(mode).option("header", "false").csv(path)
