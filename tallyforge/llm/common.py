"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from py4j.protocol import Py4JError, Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 512
#: And bytes, whatever the number of rows.
BATCH_BYTES = 8 << 20
_shipped: dict[str, str] = {}
#: Copies of a small side, one for each salt, in joins whose other side may have most rows under one key.
SALTS = 8
#: Words of 64 bits in a bitmap that is sent to all tasks.
BITMAP_WORDS = 1 << 16


class _Kept(NamedTuple):
    """What is held (a table) or stashed (its folder; the table only as long as somebody else refers to it)."""

    number: int
    spark: SparkSession
    held: DataFrame | None
    stashed: weakref.ref[DataFrame] | None = None
    folder: str | None = None

    def table(self) -> DataFrame | None:
        return self.stashed() if self.stashed else self.held


#: What is held or stashed and not given back yet, oldest first.  Tables would keep their plans in the driver.
_kept: list[_Kept] = []
_numbers = itertools.count()


def ready(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on the executors: they get this package, and few whole texts at once (limits are
    lowered, never raised)."""
    _ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(key)).rstrip("bB"))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application: they need no path to it."""
    sc = spark.sparkContext
    if _shipped.get("to") == sc.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="tallyforge-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(at))
    _shipped["to"] = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs in
    one process (tests): on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[[^,]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="tallyforge-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def drop(df: DataFrame) -> None:
    """Delete what :func:`stash` wrote, once nothing reads it any more."""
    _kept[:] = [x for x in _kept if x.table() is not df]
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; partitions keep their rows and order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again: like :func:`cut`, but columnar and compressed."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    _kept.append(_Kept(next(_numbers), df.sparkSession, None, weakref.ref(out), at))
    trim(df.sparkSession)
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keep a narrow table on the executors' disks, for several readers; what a lost executor held is made again
    from the lineage, which stays.  Writes no files to the shared folder."""
    _kept[:] = [x for x in _kept if x.held is None or x.held.storageLevel.useDisk]  # the caller may have cleared the cache
    out = df.persist(StorageLevel.DISK_ONLY)
    _kept.append(_Kept(next(_numbers), df.sparkSession, out))
    return out


def mark() -> int:
    """A place in what is kept, for :func:`give_back`."""
    return next(_numbers)


def give_back(since: int, *but: DataFrame) -> None:
    """Gives back what has been held or stashed since a :func:`mark`, once results that need it are written.

    An operator returns before its result is computed, so what it keeps is its caller's to give back.
    """
    for x in [x for x in _kept if x.number >= since]:
        if any(x.table() is b for b in but):
            continue
        _kept[:] = [y for y in _kept if y is not x]
        if x.held is not None:
            x.held.unpersist()
        else:
            _delete(x.spark, x.folder)


def join_salted(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``unique``, which has one row for a key, however many rows have the same key."""
    hashed = [f"`{f.name}`" for f in rows.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)))
    copies = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``rows`` as a bitmap of bounded size: (word, bits), at most ``BITMAP_WORDS`` rows."""
    word, bit = _places(key)
    return rows.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits"))


def in_bitmap(rows: DataFrame, bits: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose key may be among those of a :func:`bitmap`; with left_anti the others, which surely are not."""
    word, bit = _places(key)
    placed = rows.withColumn("__at", word).withColumn("__bit", bit)
    return placed.join(F.broadcast(bits), F.expr("__at = __word and getbit(__bits, __bit) = 1"), how).drop("__at", "__bit")


def _places(key: str) -> tuple:
    h = F.xxhash64(F.col(f"`{key}`"))
    return F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more; the driver gives back memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """The driver's JVM gives back what its native code has freed: after some hundred jobs on hundreds of threads glibc
    holds 200 MB of it.  False, and nothing else, where the JVM has no such command."""
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is not exported
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0], arguments[1] = name, "systemTrimNativeHeap"
        invoke.invoke(server, arguments)
    except (Py4JError, Py4JJavaError):
        return False
    return True


def need(df: DataFrame, *names: str) -> None:
    """Fail early, by name, where a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
