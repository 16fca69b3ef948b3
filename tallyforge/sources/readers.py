"""Other sources and sinks: files of the common formats, syslog lines, sockets, message queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import QueryError

FORMATS = ("parquet", "orc", "json", "csv", "text")
# fixed values: severities of the syslog protocol, by number
SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
_OLD = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
_NEW = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|\[.*?\]) ?(.*)$"


def read_files(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files of a format; text formats without a schema are read once more to find it."""
    if kind not in FORMATS:
        raise QueryError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**({"header": "true", "inferSchema": str(schema is None).lower()} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_files(df: DataFrame, path: str, kind: str, *by: str, mode: str = "errorifexists", **options: str) -> None:
    """Write in a format, in folders of the columns named."""
    if kind not in FORMATS:
        raise QueryError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    df.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options).partitionBy(*by).save(path)


def parse_syslog(lines: DataFrame, column: str = "line") -> DataFrame:
    """facility, severity, host, app, pid, message of syslog lines, old style or new; other lines only have raw."""
    new = F.col(column).rlike(_NEW)
    part = lambda i, j: F.when(new, F.regexp_extract(column, _NEW, i)).otherwise(F.regexp_extract(column, _OLD, j))
    some = lambda c: F.nullif(F.nullif(c, F.lit("")), F.lit("-"))
    priority = part(1, 1).try_cast("int")
    return lines.select(
        F.floor(priority / 8).cast("int").alias("facility"),
        F.when(priority.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(F.pmod(priority, F.lit(8)), F.lit(0)) + 1)).alias("severity"),
        some(part(3, 3)).alias("host"), some(part(4, 4)).alias("app"), some(part(5, 5)).try_cast("int").alias("pid"),
        F.when(priority.isNotNull(), part(7, 6)).alias("message"), F.col(column).alias("raw"),
    )


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines that come in over TCP; for trials, as a socket cannot be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "line")


def queue_records(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """A stream of JSON records from a message queue; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "timestamp").select("r.*", F.col("timestamp").alias("ingest_ts"))


def discover_json(spark: SparkSession, path: str) -> T.StructType:
    """The schema that all JSON records of a path share: fields are merged, clashing kinds become text."""
    return spark.read.json(path).schema
