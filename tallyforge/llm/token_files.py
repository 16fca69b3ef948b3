"""Counting documents and tokens in flat token files that have no index.

A flat file is ids of a fixed width, one document after another, each ended by the end-of-document id.  Files of any
size are read in byte ranges, as Spark splits them.  A block of a range is searched for the identifier with vector
comparisons, at every byte; what one block cannot know (where in the file it lies, so which places are whole ids, and
how long ago the last document ended) comes from a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, need, ready, shared_dir, stash, texts
from .packing import byte_bpe

#: The end-of-document id of the byte-level vocabulary, bytes of an id, and bytes in a block.
END_OF_DOCUMENT, WIDTH, BLOCK_BYTES = 50256, 2, 1 << 20

_BLOCKS = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("sub", pa.int64()), ("n_bytes", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def write_flat(docs: DataFrame, at: str, text_col: str = "text", *, make=None, end_id: int = END_OF_DOCUMENT, width: int = WIDTH) -> None:
    """Encode every text and write flat files below ``at``, through Spark's own writer, to any store it reaches.

    The identifier is the writer's record separator, so it follows each document.  A null text is an empty one.
    The identifier's name in a text is text: it is encoded as any other characters are, so that each document stays
    one.  An encoder that gives the identifier within a document is an error.
    """
    need(docs, text_col)
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (make or byte_bpe(names_are_text=True))()
        for b in batches:
            out = []
            for t in texts(b.column(0)):
                ids = encode(t)
                if (ids == end_id).any():
                    raise ValueError("a document holds the end-of-document id")
                out.append(ids.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    flat = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    separator = end_id.to_bytes(width, "little").decode("latin-1")
    flat.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(at)


def _cut_byte(end_id: int, width: int) -> int:
    """A byte at which ranges may end: none of the identifier's, so that no range ends within one; a large one, as small
    ones are the upper bytes of many ids, and each costs a row."""
    return next(b for b in range(127, 0, -1) if b not in end_id.to_bytes(width, "little"))


def _scan(end_id: int, width: int, cut: int, block_bytes: int):
    """From the pieces of files between cut bytes, in order: a row per block of a range, with the places at which the
    identifier's bytes start (counted from the block's start), and for each remainder of these by the width how many
    there are and the last one."""
    wanted = np.frombuffer(end_id.to_bytes(width, "little"), dtype=np.uint8)

    def close(key: tuple, sub: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        data = np.concatenate(parts)
        hit = data[: len(data) - width + 1] == wanted[0]
        for k in range(1, width):
            hit &= data[k : len(data) - width + 1 + k] == wanted[k]
        ends = np.flatnonzero(hit) if len(data) >= width else np.zeros(0, dtype=np.int64)
        by = [ends[ends % width == r] for r in range(width)]
        kinds = pa.list_(pa.int64())
        return batch(_BLOCKS, [[key[0]], [key[1]], [sub], [len(data)], [key[2]], pa.array([ends.tolist()], kinds), pa.array([[int(x[-1]) if len(x) else None for x in by]], kinds), pa.array([[len(x) for x in by]], kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sub, parts, held = None, 0, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            rows = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for first, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                now = tuple(keys[first].tolist())
                if now[2] % width:
                    raise ValueError("not whole ids in a file")
                if now != key:
                    if parts:
                        yield close(key, sub, parts)
                    key, sub, parts, held = now, 0, [], 0
                pieces = b.column(0).slice(first, end - first).cast(pa.large_binary())
                offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
                data = np.frombuffer(pieces.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if pieces.buffers()[2] else np.zeros(0, dtype=np.uint8)
                parts.append(np.insert(data, offsets[1:] - offsets[0], cut))
                held += len(parts[-1])
                if held >= block_bytes:  # ends after a cut byte, so within no identifier
                    yield close(key, sub, parts)
                    sub, parts, held = sub + 1, [], 0
        if parts:
            yield close(key, sub, parts)

    return run


def count_tokens(spark: SparkSession, path: str, *, end_id: int = END_OF_DOCUMENT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: path, doc_no (from 0 in its file), start (ids before it), n_tokens (without the
    identifier), complete (false: the file ends without the identifier).

    Two identifiers in a row hold an empty document; an empty file, or what follows the last identifier at the
    very end, none.  A file whose length is no multiple of the width is an error.  Files may be of any size: they
    are read in ranges that end after some byte that the identifier does not hold.
    """
    ready(spark)
    cut = _cut_byte(end_id, width)
    reader = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true")
    file = F.xxhash64("_metadata.file_path").alias("file")
    pieces = reader("text").option("lineSep", chr(cut)).load(path).select(F.col("value").cast("binary").alias("value"), file, F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"))
    shape = "file long, at long, sub long, n_bytes long, size long, ends array<long>, last array<long>, counts array<long>"
    blocks = stash(pieces.mapInArrow(_scan(end_id, width, cut, block_bytes), shape))  # places only
    # the scan sees summaries: a few numbers for each block
    order = Window.partitionBy("file").orderBy("at", "sub")
    before, final = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    placed = blocks.select("file", "at", "sub", "size", "last", "counts", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("base"))
    own = F.pmod(-F.col("base"), F.lit(width)).cast("int")  # the remainder of places that are whole ids
    summed = placed.select("file", "at", "sub", "size", "base", own.alias("own"), (F.col("base") + F.get("last", own)).alias("last"), F.get("counts", own).alias("n"))
    ids = lambda c: F.floor(c / F.lit(width)).cast("long")
    scanned = summed.select(
        "file", "at", "sub", "base", "own",
        F.coalesce(ids(F.last("last", ignorenulls=True).over(before)), F.lit(-1).cast("long")).alias("previous"),
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("docs_before"),
        F.coalesce(ids(F.max("last").over(final)), F.lit(-1).cast("long")).alias("file_end"),
        (F.struct("at", "sub") == F.max(F.struct("at", "sub")).over(final)).alias("is_last"),
        F.sum("n").over(final).alias("docs_in_file"),
        ids(F.col("size")).alias("ids_in_file"),
    )
    met = blocks.select("file", "at", "sub", "ends").join(scanned, ["file", "at", "sub"])
    names = reader("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), file)
    met = met.join(names, "file")
    places = F.transform(F.filter("ends", lambda e: e % width == F.col("own")), lambda e: ids(F.col("base") + e))
    met = met.select("*", places.alias("places"))
    starts = F.transform(F.concat(F.array("previous"), F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0)))), lambda p: p + 1)
    docs = F.transform(F.arrays_zip(starts.alias("s"), F.col("places").alias("e")), lambda x, i: F.struct((F.col("docs_before") + i).alias("doc_no"), x["s"].alias("start"), (x["e"] - x["s"]).alias("n_tokens"), F.lit(True).alias("complete")))
    rest = F.col("is_last") & (F.col("ids_in_file") > F.col("file_end") + 1)
    tail = F.array(F.struct(F.col("docs_in_file").alias("doc_no"), (F.col("file_end") + 1).alias("start"), (F.col("ids_in_file") - F.col("file_end") - 1).alias("n_tokens"), F.lit(False).alias("complete")))
    some = F.when(F.size("places") > 0, docs).otherwise(F.filter(docs, lambda x: F.lit(False)))
    return met.select("path", F.explode(F.when(rest, F.concat(some, tail)).otherwise(some)).alias("d")).select("path", "d.*")


def flat_copy(docs: DataFrame, **how) -> str:
    """Write the documents' ids as flat files in the shared folder; returns where."""
    at = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, at, **how)
    return at
