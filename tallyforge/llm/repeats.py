"""Removing every long string that occurs more than once, exactly, byte by byte.

A window of 400 bytes is repeated if the same bytes start anywhere else.  Windows are anchored: of the 100-byte
strings inside it, each window names the one with the least hash (the leftmost, if several).  Equal windows
have equal anchors at equal places, so only windows whose anchor occurs twice can repeat.  Consecutive windows
with one anchor form a run; about one byte in 150 starts a run.

Suffixes are sampled at the anchors of runs whose anchor occurs again; a run that occurs many times as a whole
sends two of its occurrences.  They go, batch by batch, into a logarithmic family of suffix arrays
(:class:`SuffixFamily`): a batch is sorted by what follows the anchors, merge-scanned against each existing level,
and becomes a level in the shared folder; levels of like size merge.  A scan has the common prefixes of what
follows the anchors and of what precedes them (read backwards): a window that starts ``b`` bytes before its anchor
occurs again if some other suffix shares ``b`` bytes before it and the rest of the length after it.  All bytes that
go are found so, by comparing bytes.

Where very many different runs share one anchor, their windows are spread by content instead and counted with
partial sums, so that no task holds a passage's every surrounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, drop, hold, need, ready, release, stash
from .line_dedup import NO_ID
from .shingles import mix

#: Bytes of a repeat, bytes of an anchor, bytes that are hashed at once, runs of one anchor from which on they are spread.
LENGTH, ANCHOR, PIECE, HOT_RUNS = 400, 100, 1 << 20, 4096
#: Batches in which a table enters the family, and bytes of suffixes that a task holds at a time.
BATCHES, BUCKET_BYTES = 4, 4 << 20
#: Buckets that a task goes through, one after another: few files are written.
BUCKETS_TOGETHER = 4
_POSITION = np.uint64((1 << 22) - 1)


class _Rolling:
    """Hashes of any stretch of bytes from prefix sums, for one random table and odd base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def over(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(max(n, PIECE + LENGTH), base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[: n - 1], out=sums[1:])
        return lambda at, end: mix((sums[end] - sums[at]) * self.down[at])


_ONE = _Rolling(51)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done, step = v, 1
    while 2 * step <= width:
        done = np.minimum(done[:-step], done[step:])
        step *= 2
    return np.minimum(done[: len(v) - width + 1], done[width - step : width - step + len(v) - width + 1])


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int):
    """Runs of windows in a stretch of texts that start at ``bounds`` (the last bound: the end).

    Gives key, content hash, first window (place in ``data``), windows after the first, bytes from there to the anchor,
    place of the text.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return (none,) * 6
    width = length - anchor + 1
    h1 = _ONE.over(data)
    at = np.arange(len(data) - anchor + 1)
    grams = h1(at, at + anchor)
    least = _sliding_min((grams & ~_POSITION) | at.astype(np.uint64), width)
    n = len(data) - length + 1
    place = (least[:n] & _POSITION).astype(np.int64)
    valid = np.zeros(n + 1, dtype=np.int64)  # windows that lie in one text
    lo, hi = bounds[:-1], bounds[1:] - length + 1
    has = hi > lo
    np.add.at(valid, lo[has], 1)
    np.add.at(valid, hi[has], -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    new[lo[has]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return (none,) * 6
    ends = inside.copy()
    ends[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(ends)
    anchors = place[first]
    raw = memoryview(np.ascontiguousarray(data))
    whole = np.array([xxhash.xxh3_64_intdigest(raw[f : e + length], seed=p) for f, e, p in zip(first.tolist(), last.tolist(), (anchors - first).tolist(), strict=True)], dtype=np.uint64)
    text = np.searchsorted(bounds, first, side="right") - 1
    return grams[anchors].view(np.int64), whole.view(np.int64), first, last - first, anchors - first, text


def _stretches(offsets: np.ndarray, length: int):
    """(first text, last text + 1, first byte, end byte): several short texts, or pieces of one long text that overlap."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        a, end = int(offsets[i]), int(offsets[j])
        if end - a <= PIECE:
            yield i, j, a, end
        else:
            while True:
                b = min(end, a + PIECE)
                yield i, j, a, b
                if b == end:
                    break
                a = b - length + 1
        i = j


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


_RUNS = pa.schema([("key", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("lo", pa.int32()), ("more", pa.int32()), ("back", pa.int32())])


def _find_runs(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, bodies = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = _bytes_of(b.column(2))
            for i, j, a, e in _stretches(offsets, length):
                bounds = np.clip(offsets[i : j + 1], a, e) - a
                key, whole, first, more, back, text = runs_of(data[a:e], bounds, length, anchor)
                if len(key):
                    t = text + i
                    yield batch(_RUNS, [pa.array(key), pa.array(whole), pa.array(docs[t]), pa.array(bodies[t]), *(pa.array(x.astype(np.int32)) for x in (first + a - offsets[t], more, back))])

    return run


class SuffixTable:
    """Sampled suffixes in lexicographic order: what follows the anchor, what precedes it (read backwards), and the
    least and greatest distance from the start of a window of the run to the anchor."""

    __slots__ = ("after", "before", "low", "high", "key", "whole")

    def __init__(self, rows: list[tuple]):
        """Rows (after, before, low, high, key, whole) in order."""
        for name, column in zip(self.__slots__, zip(*rows, strict=True) if rows else [()] * 6, strict=True):
            setattr(self, name, list(column))

    def rows(self) -> list[tuple]:
        return list(zip(*(getattr(self, n) for n in self.__slots__), strict=True))


def common_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """How many bytes each string shares with the next one, at most ``width``."""
    sizes = np.array([min(len(x), width) for x in strings])
    out = np.zeros(max(0, len(strings) - 1), dtype=np.int64)
    for a in range(0, len(out), 2048):
        some = strings[a : a + 2049]
        grid = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in some), dtype=np.uint8).reshape(len(some), width)
        same = np.append(grid[1:] == grid[:-1], np.zeros((len(some) - 1, 1), dtype=bool), axis=1)
        out[a : a + 2048] = same.argmin(1)
    return np.minimum(out, np.minimum(sizes[1:], sizes[:-1]))


def scan(table: SuffixTable, length: int, anchor: int) -> np.ndarray:
    """For each suffix and each distance from a window's start to the anchor: whether the window occurs again in the table.

    For a distance ``b``, two windows are equal if their suffixes lie in one stretch of the order whose neighbours share
    the ``length - b`` bytes that follow, and in one stretch of the backward order whose neighbours share ``b`` bytes.
    """
    n, reach = len(table.after), length - anchor + 1
    found = np.zeros((n, reach), dtype=bool)
    prefix = common_prefixes(table.after, length)
    near = np.append(prefix >= anchor, False) | np.append(False, prefix >= anchor)  # what shares no anchor is alone
    some = np.flatnonzero(near)
    if not len(some):
        return found
    # between two of them the least of the prefixes on the way counts
    cuts = np.minimum.reduceat(prefix[: some[-1]], some[:-1])  # at least two are near
    before = [table.before[i] for i in some.tolist()]
    order = np.array(sorted(range(len(some)), key=before.__getitem__))
    suffix = common_prefixes([before[i] for i in order.tolist()], reach)
    low, high = np.array(table.low)[some], np.array(table.high)[some]
    back = np.empty(len(some), dtype=np.int64)
    for b in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= b) & (b <= high))
        if len(own) < 2:
            continue
        ahead = np.append(0, np.cumsum(cuts < length - b))
        back[order] = np.append(0, np.cumsum(suffix < b))
        pair = (ahead * len(some) + back)[own]
        at = np.argsort(pair)
        same = pair[at[1:]] == pair[at[:-1]]
        twice = np.append(same, False) | np.append(False, same)
        found[some[own[at[twice]]], b] = True
    return found


def merged(a: SuffixTable, b: SuffixTable) -> tuple[SuffixTable, np.ndarray]:
    """Both tables as one, and which of its suffixes come from ``b``.  The sort meets two ordered runs and merges them."""
    rows = [(*r, 0) for r in a.rows()] + [(*r, 1) for r in b.rows()]
    rows.sort()
    return SuffixTable([r[:6] for r in rows]), np.array([r[6] for r in rows], dtype=bool)


def distinct(table: SuffixTable) -> SuffixTable:
    """One of each: equal suffixes have met, and either stands for both."""
    rows = table.rows()
    return SuffixTable([r for i, r in enumerate(rows) if not i or r[:4] != rows[i - 1][:4]])


_STEP = pa.schema([("kind", pa.int8()), ("bucket", pa.int64()), ("rank", pa.int64()), ("after", pa.binary()), ("before", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.int64()), ("whole", pa.int64())])
_STEP_SQL = "kind byte, bucket long, rank long, after binary, before binary, low int, high int, key long, whole long"


def _repeats(table: SuffixTable, found: np.ndarray) -> list[tuple]:
    """Stretches of windows that occur again: key, whole, first window of the run, last one."""
    out = []
    for i in np.flatnonzero(found.any(1)).tolist():
        low, high = table.low[i], table.high[i]
        flags = np.concatenate([[0], found[i, low : high + 1][::-1].astype(np.int8), [0]])
        step = np.diff(flags)
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            out.append((table.key[i], table.whole[i], s, e - 1))
    return out


def _step(merging: frozenset[int], length: int, anchor: int):
    """Rows (side, bucket, rank, ...) by bucket, side and rank; side 0 is the batch, the others are levels.

    Gives the windows that occur again (kind 0; low and high are the first and last window of the run), and the new
    level: the batch merged with the sides in ``merging`` (kind 1, rank in order).
    """

    def bucket_done(bucket: int, sides: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        new = SuffixTable(sorted(sides.pop(0, [])))
        hits = set(_repeats(new, scan(new, length, anchor)))
        level = distinct(new)
        for side in sorted(sides):
            old = SuffixTable(sides[side])
            if new.key:
                both, _ = merged(distinct(new), old)
                hits.update(_repeats(both, scan(both, length, anchor)))
            if side in merging:
                level = distinct(merged(level, old)[0])
        if hits:
            rows = sorted(hits)
            n = len(rows)
            yield batch(_STEP, [np.zeros(n, np.int8), np.full(n, bucket), np.zeros(n, np.int64), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), [r[2] for r in rows], [r[3] for r in rows], [r[0] for r in rows], [r[1] for r in rows]])
        n = len(level.key)
        for a in range(0, n, 4096):
            e = min(n, a + 4096)
            yield batch(_STEP, [np.ones(e - a, np.int8), np.full(e - a, bucket), np.arange(a, e), *(getattr(level, name)[a:e] for name in ("after", "before", "low", "high", "key", "whole"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, {}
        for b in batches:
            for side, bucket, _, *row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if bucket != at:
                    if sides:
                        yield from bucket_done(at, sides)
                    at, sides = bucket, {}
                sides.setdefault(side, []).append(tuple(row))
        if sides:
            yield from bucket_done(at, sides)

    return run


class SuffixFamily:
    """A logarithmic family of suffix arrays in the shared folder, each level less than half as large as the one before.

    Levels are Parquet tables of sampled suffixes, in lexicographic order inside each bucket; a bucket holds whole
    anchors, so equal windows meet in it.
    """

    def __init__(self, spark: SparkSession, *, length: int = LENGTH, anchor: int = ANCHOR, buckets: int = 1):
        self.spark, self.length, self.anchor, self.buckets = spark, length, anchor, buckets
        self.levels: list[tuple[int, DataFrame]] = []  # suffixes, and the level
        self.tables: list[DataFrame] = []  # what has been written: levels, beside what was found on the way

    def add(self, batch_rows: DataFrame) -> DataFrame:
        """Adds rows (key, whole, after, before, low, high); gives (key, whole, first, last): windows of a run that
        occur again in the batch, or in the batch and a level (then of both sides).  Readable until :meth:`close`."""
        n = batch_rows.count()
        size, merging = n, []
        for i in range(len(self.levels) - 1, -1, -1):
            if self.levels[i][0] >= 2 * size:
                break
            merging.append(i)
            size += self.levels[i][0]
        new = batch_rows.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("key"), F.lit(self.buckets)).alias("bucket"), F.lit(0).cast("long").alias("rank"), "after", "before", "low", "high", "key", "whole")
        for i, (_, level) in enumerate(self.levels):
            new = new.unionByName(level.select(F.lit(i + 1).alias("side"), "bucket", "rank", "after", "before", "low", "high", "key", "whole"))
        parts = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.buckets // BUCKETS_TOGETHER))
        ordered = new.repartition(parts, "bucket").sortWithinPartitions("bucket", "side", "rank")
        done = stash(ordered.mapInArrow(_step(frozenset(i + 1 for i in merging), self.length, self.anchor), _STEP_SQL))
        self.tables.append(done)
        for i in sorted(merging, reverse=True):
            self.levels.pop(i)
        level = done.filter("kind = 1")
        self.levels.append((level.count(), level))
        release(self.spark)
        return done.filter("kind = 0").select("key", "whole", F.col("low").alias("first"), F.col("high").alias("last"))

    def close(self) -> None:
        for table in self.tables:
            drop(table)
        self.levels, self.tables = [], []


_CONTEXTS = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), ("after", pa.binary()), ("before", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.int64()), ("whole", pa.int64())])
_CONTEXTS_SQL = "part int, hot boolean, after binary, before binary, low int, high int, key long, whole long"


def _contexts(length: int):
    """Cuts the bytes around the anchors of the wanted runs out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _CONTEXTS]
            for part, text, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                for r in runs:
                    lo, back, more = r["lo"], r["back"], r["more"]
                    at = lo + back
                    row = (part, r["hot"], text[at : lo + more + length], text[lo:at][::-1], back - more, back, r["key"], r["whole"])
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            yield batch(_CONTEXTS, out)

    return run


def _spread(length: int):
    """A row per window of the hot anchors' runs."""
    schema = pa.schema([("window", pa.binary()), ("key", pa.int64()), ("whole", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for after, before, low, high, key, whole in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                raw = memoryview(before[::-1] + after)
                for i in range(high - low + 1):
                    for o, x in zip(out, (xxhash.xxh3_128_digest(raw[i : i + length]), key, whole, i), strict=True):
                        o.append(x)
            if out[0]:
                yield batch(schema, out)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, anchor: int = ANCHOR, hot_runs: int = HOT_RUNS, batches: int = BATCHES) -> DataFrame:
    """(doc, body, lo, hi) byte spans, possibly overlapping, that cover exactly the repeated windows.

    ``doc`` is the id (the smallest long, if null) and ``body`` the text's 64-bit hash.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(*_named(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    runs = hold(rows.mapInArrow(_find_runs(length, anchor), "key long, whole long, doc long, body long, lo int, more int, back int"))
    wholes = runs.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("times"))
    keys = wholes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")).filter(F.col("all") > 1).select("key", "kinds")
    known = wholes.join(keys, "key").select("key", "whole", "kinds")
    met = hold(runs.join(known, ["key", "whole"]))
    # a run that occurs many times sends two of its occurrences: they find each other, and stand for all
    place = F.struct("doc", "body", "lo")
    sent = met.groupBy("key", "whole").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.first("more").alias("more"), F.first("back").alias("back"), F.first("kinds").alias("kinds"))
    each = sent.withColumn("at", F.explode(F.array_distinct(F.array("a", "b"))))
    wanted = each.groupBy("at.doc", "at.body").agg(F.collect_list(F.struct("key", "whole", "at.lo", "more", "back", (F.col("kinds") > hot_runs).alias("hot"))).alias("runs"))
    part = F.pmod(F.xxhash64("doc", "body"), F.lit(batches)).cast("int")
    contexts = stash(rows.join(wanted, ["doc", "body"]).select(part.alias("part"), "text", "runs").mapInArrow(_contexts(length), _CONTEXTS_SQL))
    runs.unpersist()
    release(spark)
    total = contexts.agg(F.coalesce(F.sum(F.length("after") + F.length("before")), F.lit(0))).first()[0]
    family = SuffixFamily(spark, length=length, anchor=anchor, buckets=max(1, -(-total // BUCKET_BYTES)))
    columns = ("after", "before", "low", "high", "key", "whole")
    usual = contexts.filter("not hot")
    found = [family.add(usual.filter(F.col("part") == i).select(*columns)) for i in range(batches)]
    windows = contexts.filter("hot").select(*columns).mapInArrow(_spread(length), "window binary, key long, whole long, first int")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    found.append(windows.join(twice, "window", "left_semi").select("key", "whole", "first", F.col("first").alias("last")))
    again = stash(reduce(DataFrame.unionByName, found).distinct())
    family.close()
    drop(contexts)
    release(spark)
    spans = met.join(again, ["key", "whole"])
    return hold(spans.select("doc", "body", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + length).cast("int").alias("hi")))


def _named(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("body")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, **how) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another; matches never cross documents and are judged on the input.  A null text is the empty text.  A row
    that is repeated repeats its text, which then goes where it is long enough.  Columns of these names are
    replaced; others stay.  An empty table gives no rows.
    """
    spans = repeated_spans(docs, id_col, text_col, length=length, **how)
    per = spans.groupBy("doc", "body").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")]
    other = F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")]).alias("other")
    joined = docs.select(other, F.col(f"`{text_col}`").alias("text"), *_named(id_col, text_col)).join(per, ["doc", "body"], "left").select("other", "text", "spans")
    out = T.StructType([joined.schema["other"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    done = joined.mapInArrow(_apply, out)
    return done.select(*[F.col(f"other.`{c}`").alias(c) for c in names], "n_bytes", "n_removed", "n_spans", "kept")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            stay, at, n = [], 0, 0
            for s in spans or ():
                if s["lo"] > at or n == 0:
                    stay.append(raw[at : s["lo"]])
                    n += 1
                    at = s["hi"]
                else:
                    at = max(at, s["hi"])
            stay.append(raw[at:])
            kept.append(b"".join(stay))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept[-1]))
            n_spans.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=["other", "n_bytes", "n_removed", "n_spans", "kept"])


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return done.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
