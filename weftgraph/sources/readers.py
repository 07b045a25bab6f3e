"""Files in and out: CSV, Parquet, Arrow IPC; streams of JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = ("true", "1", "t", "yes"), ("false", "0", "f", "no")


def _ending(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read(spark: SparkSession, path: str, schema: T.StructType, options: dict | None = None) -> DataFrame:
    """Rows of a file for a table of ``schema``: columns go by position, missing ones at the end are NULL."""
    if path.startswith("kafka://"):
        return kafka_rows(spark, path, schema)
    kind = _ending(path)
    if kind == "parquet":
        return _placed(spark.read.parquet(path), schema)
    if kind in ("arrow", "ipc"):
        return _placed(arrow_ipc(spark, path), schema)
    return csv(spark, path, schema, options or {})


def _placed(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = df.columns
    return df.select(*[(F.col(f"`{have[i]}`") if i < len(have) else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def _boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def csv(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """Comma-separated with a header line; an empty field and columns missing at the end are NULL; a field that doesn't fit its type is an error."""
    header, sep = bool(options.get("header", True)), str(options.get("delim", options.get("sep", ",")))
    have = len(spark.read.csv(path, header=header, sep=sep).columns)
    asked = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BooleanType) else f.dataType) for f in schema.fields[:have]])
    df = spark.read.csv(
        path, schema=asked, header=header, sep=sep, nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=True, quote='"', escape='"'
    )
    value = lambda i, f: F.lit(None).cast(f.dataType) if i >= have else _boolean(F.col(f.name)) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
    return df.select(*[value(i, f).alias(f.name) for i, f in enumerate(schema.fields)])


def arrow_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (file or stream format): Spark lists and loads them, each is decoded in a task."""
    import io

    import pyarrow as pa

    def tables(blob: bytes):
        try:
            return pa.ipc.open_file(io.BytesIO(blob))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(io.BytesIO(blob))

    files = spark.read.format("binaryFile").load(path)
    first = files.limit(1).collect()
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(tables(bytes(first[0]["content"])).schema)

    def decode(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield from tables(blob).read_all().to_batches() if hasattr(tables(blob), "read_all") else tables(blob)

    return files.select("content").mapInArrow(decode, schema)


def json_stream(stream: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Rows of a stream of JSON objects keyed by column; NULL messages are skipped, missing keys are NULL."""
    return stream.filter(F.col(value).isNotNull()).select(F.from_json(F.col(value).cast("string"), schema).alias("r")).select("r.*")


def kafka_options(url: str) -> dict[str, str]:
    """Spark's options for ``kafka://brokers/topic?group_id=g``."""
    from urllib.parse import parse_qs, urlparse

    u = urlparse(url)
    options = {"kafka.bootstrap.servers": u.netloc, "subscribe": u.path.strip("/"), "startingOffsets": "earliest"}
    if group := parse_qs(u.query).get("group_id"):
        options["kafka.group.id"] = group[0]
    return options


def kafka(spark: SparkSession, url: str) -> DataFrame:
    """A topic as a stream (needs Spark's connector on the class path)."""
    return spark.readStream.format("kafka").options(**kafka_options(url)).load()


#: Messages that one COPY from a topic takes; a stream takes all.
KAFKA_MESSAGES = 10_000


def kafka_rows(spark: SparkSession, url: str, schema: T.StructType) -> DataFrame:
    """The first ``KAFKA_MESSAGES`` messages that a topic holds now, as rows; does not wait for more."""
    return json_stream(spark.read.format("kafka").options(**kafka_options(url), endingOffsets="latest").load().limit(KAFKA_MESSAGES), schema)


def write(df: DataFrame, path: str, options: dict | None = None) -> None:
    """Parquet, or CSV with a header, by the path's ending."""
    if _ending(path) in ("csv", "tsv"):
        df.write.mode("overwrite").csv(path, header=True, sep=str((options or {}).get("delim", ",")))
    else:
        df.write.mode("overwrite").parquet(path)
