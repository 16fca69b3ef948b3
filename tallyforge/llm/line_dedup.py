"""Removing lines that many documents share.

Only hashes travel: (128-bit key hash, document, position) records are range-partitioned, sorted by key, then
document (largest first), then position, and streamed.  The first document of a key's run keeps its lines.
Ranges are of the whole sort key, so one key that a third of all documents hold spreads over as many
partitions as its records need; runs that cross partitions are stitched from one small summary per partition.
The result is a compressed bitmap of dropped lines per document; texts are joined with it once, at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, hold, need, ready

#: Code points that a key needs, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 20, 3
#: Stands for a null document id: smaller than every other.
NO_ID = -(1 << 63)
BLANK = b" \t\n\x0b\x0c\r"

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int32())])
_DROPS = pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int32())])


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            keys, docs, bodies, at = [], [], [], []
            for doc, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                before = len(keys)
                for pos, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip(BLANK).lower()  # of bytes: A-Z only
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        keys.append(digest(key))
                        at.append(pos)
                docs += [doc] * (len(keys) - before)
                bodies += [body] * (len(keys) - before)
            h = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield batch(_LINES, [pa.array(h[:, 0]), pa.array(h[:, 1]), docs, bodies, at])

    return run


def _runs(b: pa.RecordBatch):
    """Numpy columns and the starts of runs of one key."""
    h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
    new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
    return h1, h2, doc, np.concatenate([[0], new])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its first and last key, the distinct documents of either, and the first document."""
    first = last = None  # [h1, h2, head, documents, last document]
    only = True
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, starts = _runs(b)
        ends = np.append(starts[1:], len(doc))
        for s, e in ((starts[0], ends[0]), *([(starts[-1], ends[-1])] if len(starts) > 1 else [])):
            part = doc[s:e]
            n = 1 + int(np.count_nonzero(part[1:] != part[:-1]))
            if last is not None and (last[0], last[1]) == (h1[s], h2[s]) and s == 0:
                last[3] += n - (last[4] == part[0])
                last[4] = int(part[-1])
            else:
                if last is not None:
                    only = False
                    first = first or last
                last = [int(h1[s]), int(h2[s]), int(part[0]), n, int(part[-1])]
        if len(starts) > 2:
            only = False
    if last is not None:
        first = last if first is None else first
        yield pa.RecordBatch.from_pylist([{"pid": TaskContext.get().partitionId(), "f": first, "l": last, "only": only}], schema=pa.schema([("pid", pa.int64()), ("f", pa.list_(pa.int64())), ("l", pa.list_(pa.int64())), ("only", pa.bool_())]))


def stitch(rows: list) -> dict[int, tuple[tuple | None, int, tuple | None, int]]:
    """From the partitions' summaries: for a partition's first key the document that keeps it (or None: the
    partition holds its head) and the documents that hold it over all partitions; likewise for its last key."""
    rows = sorted(rows, key=lambda r: r["pid"])
    spans: list[dict] = []  # runs of a key over partitions
    open_span = None
    verdict: dict[int, list] = {}
    for r in rows:
        ends = [("f", r["f"])] if r["only"] else [("f", r["f"]), ("l", r["l"])]
        for side, (h1, h2, head, n, tail) in ends:
            if side == "f" and open_span is not None and open_span["key"] == (h1, h2):
                open_span["n"] += n - (open_span["tail"] == head)
                open_span["tail"] = tail
            else:
                open_span = {"key": (h1, h2), "keep": head, "n": n, "tail": tail}
                spans.append(open_span)
            verdict.setdefault(r["pid"], []).append(open_span)
    return {pid: [(s["key"], s["keep"], s["n"]) for s in v] for pid, v in verdict.items()}


def _drops(verdicts: dict, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {key: (keep, n) for key, keep, n in verdicts.get(TaskContext.get().partitionId(), [])}
        held: list[tuple] = []  # the rows of a run that a batch's end cut
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(5)]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            h1, h2, doc, body, pos = cols
            starts = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1])
            last = starts[-1]
            if (int(h1[-1]), int(h2[-1])) in known:  # its verdict is there already: nothing to wait for
                held, upto = [], len(doc)
            else:
                held, upto = [c[last:] for c in cols], last
            if upto:
                yield _judge(cols, starts[starts < upto], upto, known, min_docs)
        if held:
            yield _judge(held, np.array([0]), len(held[0]), known, min_docs)

    return run


def _judge(cols, starts, upto, known, min_docs) -> pa.RecordBatch:
    h1, h2, doc, body, pos = (c[:upto] for c in cols)
    size = np.diff(np.append(starts, upto))
    fresh = np.ones(upto, dtype=bool)
    fresh[1:] = doc[1:] != doc[:-1]
    fresh[starts] = True
    n = np.add.reduceat(fresh.astype(np.int64), starts)
    keep = doc[starts].copy()
    for i in {0, len(starts) - 1}:
        if found := known.get((int(h1[starts[i]]), int(h2[starts[i]]))):
            keep[i], n[i] = found
    drop = (np.repeat(n, size) >= min_docs) & (doc != np.repeat(keep, size))
    return batch(_DROPS, [pa.array(doc[drop]), pa.array(body[drop]), pa.array(pos[drop].astype(np.int32))])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("dropped", pa.binary())])
    for b in batches:
        made = []
        for positions in b.column(2):
            at = positions.values.to_numpy()
            bits = np.zeros(at.max() + 1, dtype=bool)
            bits[at] = True
            made.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], schema=schema)


def dropped_lines(bitmap: bytes | None) -> np.ndarray:
    """The bitmap of a document as booleans by line; lines beyond its end stay."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little").astype(bool) if bitmap else np.zeros(0, dtype=bool)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("body")]


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, dropped) for each document that loses lines; ``body`` is the text's 64-bit hash.

    A document is its id: rows that share one count once, and each of their texts gets its own bitmap.
    A null id is one document, smaller than every other; a null text is one empty line.
    """
    need(docs, id_col, text_col)
    ready(docs.sparkSession)
    rows = docs.select(*_keyed(docs, id_col, text_col), F.col(text_col).alias("text"))
    lines = hold(rows.mapInArrow(_line_keys(min_chars), "h1 long, h2 long, doc long, body long, pos int"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("body"), F.col("pos")]
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = docs.sparkSession
    ordered = hold(lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    before = spark.conf.get(small)
    spark.conf.set(small, "65536")  # of numbers only
    try:
        summaries = ordered.mapInArrow(_summaries, "pid long, f array<long>, l array<long>, only boolean").collect()  # a row per partition
    finally:
        spark.conf.set(small, before)
    drops = ordered.mapInArrow(_drops(stitch([r.asDict() for r in summaries]), min_docs), "doc long, body long, pos int")
    per_doc = drops.groupBy("doc", "body").agg(F.collect_set("pos").alias("at"))  # at most the lines of one text
    return per_doc.mapInArrow(_bitmaps, "doc long, body long, dropped binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with the kept lines as ``text_col`` and two more columns, n_lines and n_dropped.

    A key is a line without the blanks at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold lose all their lines except in the largest id.
    A null text becomes the empty text (one line).  Repeated rows get the same result each.
    """
    marks = line_bitmaps(docs, id_col, text_col, **rule)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    other = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0).alias("none")]).alias("other")
    left = docs.select(other, F.col(f"`{text_col}`").alias("text"), *_keyed(docs, id_col, text_col))
    joined = left.join(marks, ["doc", "body"], "left").select("other", "text", "dropped")
    out = T.StructType([joined.schema["other"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = joined.mapInArrow(_apply, out)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"other.`{c}`").alias(c) for c in names], "n_lines", "n_dropped")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, mark in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            text = text.as_py()
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            gone = dropped_lines(mark)[: len(lines)]
            stay = [x for i, x in enumerate(lines) if i >= len(gone) or not gone[i]] if mark else lines
            n_dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["other", "text", "n_lines", "n_dropped"])
