"""Sources: files in several formats with fallbacks, archives, JSON series, a REST source, and schema normalisation."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from io import BytesIO, TextIOWrapper

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from chronoloom.functions.scalar import number
from chronoloom.operators.resample import keep_last


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, JSON, CSV or zipped CSV by the path's ending; ``archive.zip::member`` names one member, ``archive.zip::*`` all."""
    if ".zip" in path:
        archive, _, member = path.partition("::")
        return read_zip(spark, archive, schema, member or None)
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path) if schema else reader.options(header=True, inferSchema=True).csv(path)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def first_existing(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """The first candidate that can be read."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return read_table(spark, path, schema)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    raise FileNotFoundError(f"none of {list(paths)}")


def read_zip(spark: SparkSession, archives: str, schema: StructType | str | None, member: str | None = None) -> DataFrame:
    """CSV members of zip archives as string columns cast to a schema; each archive is unpacked line by line in one task.

    Without a member's name the first CSV that is no metadata is taken, with ``*`` all of them one after the other.
    """
    if schema is None:
        raise ValueError("zipped CSV needs a schema")
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = target.names

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(BytesIO(content)) as z:
                    usable = [n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX")]
                    chosen = usable if member == "*" else [member or (usable or z.namelist())[0]]
                    for name in chosen:
                        with z.open(name) as f:
                            rows: list[list[str | None]] = []
                            for row in csv.DictReader(TextIOWrapper(f, "utf-8", newline="")):
                                rows.append([row.get(n) or None for n in names])
                                if len(rows) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                                    rows = []
                            if rows:
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    text = spark.read.format("binaryFile").load(archives).select("content").mapInArrow(unpack, ", ".join(f"`{n}` string" for n in names))
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target.fields])


def series_from_json(raw: DataFrame, value: str = "v", fields: Mapping[str, str] | None = None, name: str = "value", time_field: str = "t") -> DataFrame:
    """API rows {t: epoch seconds, v: number or struct} as (ts, one column per value): numbers coerced, last row per time kept."""
    ts = F.timestamp_seconds(F.col(time_field).cast("long")).cast("timestamp_ntz").alias("ts")
    kind = dict(raw.dtypes)[value]
    if kind.startswith("struct"):
        columns = [number(F.col(f"{value}.{k}")).alias(v) for k, v in (fields or {n: n for n in raw.schema[value].dataType.names}).items()]
    else:
        columns = [number(value).alias(name)]
    out = raw.select(ts, *columns).where(F.col("ts").isNotNull())
    return keep_last(out, ["ts"], [c for c in out.columns if c != "ts"])


def with_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Renames columns to their canonical names where those are not there yet."""
    return df.withColumnsRenamed({a: c for a, c in aliases.items() if a in df.columns and c not in df.columns})


def typed_series(df: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = (), sequence: Column | None = None) -> DataFrame:
    """Times parsed, numbers coerced, rows without a time dropped, of repeated times the last by ``sequence`` kept."""
    parsed = df.withColumn(ts, F.col(ts).try_cast("timestamp_ntz")).withColumns({v: number(v) for v in values})
    parsed = parsed.where(F.col(ts).isNotNull()).withColumn("_seq", sequence if sequence is not None else F.lit(0))
    return keep_last(parsed, [*keys, ts], ["_seq"]).drop("_seq")


class RestSource(DataSource):
    """JSON series over HTTP: ``spark.read.format("rest_series")`` with url, params (JSON), schema, rpm and timeout.

    Rows are yielded as they come; requests of one read are spaced to keep to the rate limit.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_series"

    def schema(self) -> str:
        return self.options.get("schema", "t long, v string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(schema, dict(self.options))


class RestReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.names, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in json.loads(self.options.get("params", "[{}]"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = urllib.parse.urlencode(partition.value)
        request = urllib.request.Request(self.options["url"] + (f"?{query}" if query else ""), headers={"Accept": "application/json"})
        started = time.monotonic()
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 45))) as response:
            rows = json.load(response)
        if not isinstance(rows, list):
            raise ValueError("the answer is no list")
        for row in rows:
            yield tuple(json.dumps(row[n]) if isinstance(row.get(n), dict) else row.get(n) for n in self.names)
        # partitions may all run at once, so each keeps to its share of the rate
        share = float(self.options.get("rpm", 60)) / len(self.partitions())
        time.sleep(max(0.0, 60 / share - (time.monotonic() - started)))
