"""Raw text logs: reading, parsing, and made-up ones for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle

# made-up values of ordinary lines
IPS = ["192.168.1.10", "10.0.0.5", "172.16.0.3", "192.168.1.22", "10.1.1.7"]
METHODS = ["GET", "POST"]
PATHS = ["/index.html", "/login", "/api/data", "/images/logo.png", "/about"]
# fixed values: weights of the statuses, and what suspicious lines hold
STATUSES = ["200", "200", "200", "301", "404", "500"]
ODD_IPS = ["13.37.13.37", "6.6.6.6"]
ODD_PATHS = ["/admin", "/.env", "/wp-login.php", "/shell.php"]
ODD_EVERY = 5000
#: Indicators of compromise that a scan looks for.
INDICATORS = ["13.37.13.37", "/admin", "/.env"]

# fields hold no blank, so nothing is ever given back: possessive
LINE = r"^\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\] \S++ \S++ \S++ \d{3}\s*$"


def read_lines(spark: SparkSession, *paths: str, encoding: str | None = None, with_file: bool = True) -> DataFrame:
    """One row per line, with the file it came from (the reader adds it to every line, so leave it out where it is not
    needed); a line ends at LF, CR or both, which Spark's reader takes off.
    Files are split among tasks, also those of another encoding that has one byte for a line end; others (UTF-16)
    are read whole, so they must be under 2 GB each."""
    if encoding:
        if len("\n".encode(encoding)) > 1:
            wide = _wide_lines(spark, paths, encoding)
            return wide if with_file else wide.drop("file")
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding else F.col("value")
    file = [F.col("_metadata.file_path").alias("file")] if with_file else []
    return spark.read.text(list(paths)).select(text.alias("line"), *file)


def _wide_lines(spark: SparkSession, paths: tuple[str, ...], encoding: str) -> DataFrame:
    """Lines of files whose code units have two bytes: such a file is one task, as a line end's bytes may also stand
    across two units.  The byte order mark is not part of the first line."""
    text = F.regexp_replace(F.regexp_replace(F.decode("content", encoding), "^\ufeff", ""), "\r?\n$", "")
    return spark.read.format("binaryFile").load(list(paths)).select(F.explode(F.split(text, "\r?\n")).alias("line"), F.col("path").alias("file"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """line_no (from 0 in its file), line, file.  Files are read in ranges; a prefix sum over the ranges' line counts
    gives where each one starts, so a large file is many tasks."""
    raw = spark.read.text(list(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    kept = settle(raw, "lines")  # ids follow a range's lines, and are fixed once written
    ranges = kept.groupBy("file", "__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.select("file", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = kept.join(starts, ["file", "__at"])
    return joined.select((F.col("__before") + F.col("__id") - F.col("__first")).alias("line_no"), "line", "file")


def write_lines(df: DataFrame, path: str, column: str = "line", *, encoding: str = "UTF-8", line_end: str = "\n") -> None:
    """Text files of one column in an encoding, each line with its end."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).select(F.encode("value", encoding).cast("string").alias("value")).write.option("lineSep", line_end.encode(encoding).decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any store that Spark reaches."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            found.append(p)
    return found


def parse_weblog(lines: DataFrame, column: str = "line") -> DataFrame:
    """ts, ip, method, path, status, raw; a line of another shape has only its raw text.

    The shape is tested once a line; fields are then cut at blanks, once as well.
    """
    fields = F.when(F.col(column).rlike(LINE), F.split(F.rtrim(column), " "))
    part = lambda i: F.get(F.col("__fields"), F.lit(i))
    cut = lines.select(F.col(column).alias("raw"), fields.alias("__fields"))
    moment = F.when(F.col("__fields").isNotNull(), F.substring("raw", 2, 19))  # its place is part of the shape
    return cut.select(moment.try_cast("timestamp").alias("ts"), part(2).alias("ip"), part(3).alias("method"), part(4).alias("path"), part(5).try_cast("int").alias("status"), "raw")


def made_records(spark: SparkSession, n: int, start: int = 0, message: str = "system log entry") -> DataFrame:
    """n records, a second apart; the number is a hash below 1000, the same every time."""
    return spark.range(n).select((F.lit(start) + F.col("id")).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("value"), F.lit(message).alias("message"))


def made_weblog(spark: SparkSession, n: int, at: str = "2024-01-01 00:00:00") -> DataFrame:
    """n lines of a web log; each 5,000th, from the first, is suspicious."""
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    odd = F.col("id") % ODD_EVERY == 0
    return spark.range(n).select(
        F.concat(
            F.lit(f"[{at}] "), F.when(odd, pick(ODD_IPS, 1)).otherwise(pick(IPS, 2)), F.lit(" "), pick(METHODS, 3), F.lit(" "),
            F.when(odd, pick(ODD_PATHS, 4)).otherwise(pick(PATHS, 5)), F.lit(" "), F.when(odd, F.lit("404")).otherwise(pick(STATUSES, 6)),
        ).alias("line")
    )
