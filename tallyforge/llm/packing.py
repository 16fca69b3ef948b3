"""Packing documents into fixed-size token windows: bounded-space best fit, one pass, no shuffle of texts.

Every partition streams its documents through a fixed number of open windows.  A document's ids are cut
into whole windows; what remains goes where it fits best.  When it fits nowhere, the fullest window is
emitted (after a cut of the remainder has filled a gap worth cutting for).  What is still open when the
partition ends is merged with that of neighbouring partitions in a second, small step that sees piece
records only, never ids.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, need, ready, texts

#: Tokens in a window, windows open at once in a partition, and the smallest gap that a document is cut for.
WINDOW, OPEN_WINDOWS, LEAST_CUT = 1024, 64, 32
#: Partitions whose left-over windows are merged in one task.
MERGE_PARTITIONS = 16
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_INNER = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")), ("is_open", pa.bool_())])


class ByteBpe:
    """ids of the byte-level vocabulary, as the tokenizers library gives them.

    The rank form of the same vocabulary encodes several times faster; it is used for texts of Latin,
    Greek and Cyrillic letters and common marks, for which both libraries' splits agree.  Any other text
    (special-token strings, rare scripts, very long blank runs) goes to the tokenizers library itself.
    """

    _plain = re.compile(r"[\n\x20-\x7e\xa1-ɏΆ-ώЀ-џ‐-‧‰-›€]*")
    _blank = re.compile(r"\s{256}")

    def __init__(self, json_path: str, ranks_path: str, pattern: str, names_are_text: bool = False):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = names_are_text  # else their names in a text become special tokens
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if "<|" not in text and self._plain.fullmatch(text) and not self._blank.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_bpe(json_path: str | None = None, ranks_path: str | None = None, *, names_are_text: bool = False) -> Callable[[], ByteBpe]:
    """A maker of the encoder, run once in each worker; the paths default to the installed vocabulary files."""

    def make() -> ByteBpe:
        import public_tokenizers as P

        return ByteBpe(json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken"), P.PATTERN, names_are_text)

    return make


class Packer:
    """Bounded-space best fit.  Windows are ``[id, used, pieces]``; ``free`` lists (gap, id) in order."""

    def __init__(self, window: int, open_windows: int, least_cut: int):
        self.window, self.most, self.least = window, open_windows, least_cut
        self.free: list[tuple[int, int]] = []
        self.open: dict[int, list] = {}
        self.n = 0
        self.done: list[tuple] = []  # (piece, sequence, offset)

    def _new(self) -> int:
        self.n += 1
        return self.n - 1

    def _put(self, seq: int, used: int, pieces: list, piece: tuple) -> None:
        pieces.append((piece, seq, used))
        used += piece[2]
        if used == self.window:
            self.done += pieces
            self.open.pop(seq, None)
        else:
            self.open[seq] = [used, pieces]
            insort(self.free, (self.window - used, seq))

    def document(self, doc_id, ids: np.ndarray) -> None:
        raw, total, at = ids.tobytes(), len(ids), 0
        piece = lambda a, b: (doc_id, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), total)
        while total - at >= self.window:
            self.done.append((piece(at, at + self.window), self._new(), 0))
            at += self.window
        while at < total:
            size = total - at
            k = bisect_left(self.free, (size, -1))
            if k < len(self.free):  # the smallest gap that holds it
                gap, seq = self.free.pop(k)
                used, pieces = self.open[seq]
                self._put(seq, used, pieces, piece(at, total))
                return
            if len(self.free) < self.most:
                self._put(self._new(), 0, [], piece(at, total))
                return
            gap, seq = self.free.pop(0)  # none fits: the fullest goes
            used, pieces = self.open.pop(seq)
            if gap >= self.least:
                pieces.append((piece(at, at + gap), seq, used))
                at += gap
            self.done += pieces


def _pack(make: Callable[[], ByteBpe], window: int, open_windows: int, least_cut: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, encode = TaskContext.get().partitionId(), Packer(window, open_windows, least_cut), make()
        end = np.array([end_id], dtype="<u4")

        def out(found: list, is_open: bool) -> pa.RecordBatch:
            columns = [[x[0][i] for x in found] for i in range(5)] + [[(part << 40) | x[1] for x in found], [x[2] for x in found], [part] * len(found), [is_open] * len(found)]
            return batch(_INNER, columns)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                packer.document(doc, np.concatenate([encode(text), end]))
            if packer.done:
                yield out(packer.done, False)
                packer.done = []
        if left := [p for _, pieces in packer.open.values() for p in pieces]:
            yield out(left, True)

    return run


def _merge(window: int):
    def run(pdf):
        """Left-over pieces, longest first, go where they fit best; ids of the windows that they leave are used again."""
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        old = sorted(set(pdf["sequence_id"]))
        names = chain(old, count(old[0] | (1 << 39)))  # best fit may need a window more; such ids no partition gives
        gaps: list[tuple[int, int]] = []  # (gap, sequence)
        at = []
        for n in pdf["length"]:
            k = bisect_left(gaps, (n, -1))
            gap, seq = gaps.pop(k) if k < len(gaps) else (window, next(names))
            at.append((seq, window - gap))
            if gap > n:
                insort(gaps, (gap - n, seq))
        pdf["sequence_id"] = [s for s, _ in at]
        pdf["offset"] = [o for _, o in at]
        return pdf[[c.split()[0] for c in PIECES.split(", ")]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, make=None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, end_id: int = END_ID, merge_partitions: int = MERGE_PARTITIONS) -> DataFrame:
    """Pack every document's ids (then ``end_id``) into windows; one row per piece (``PIECES``).

    Each id lies in exactly one piece; offsets in a sequence run from 0 without gaps.  A null or empty
    text is the end id alone.  A null ``doc_id`` stays null.  Repeated rows are packed as often as they
    occur.  An empty table gives no rows.  Other columns are ignored.
    """
    need(docs, id_col, text_col)
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    inner = f"{PIECES}, part long, is_open boolean"
    # written once: both the emitted windows and the left-over ones come from it
    pieces = cut(rows.mapInArrow(_pack(make or byte_bpe(), window, open_windows, least_cut, end_id), inner))
    names = [c.split()[0] for c in PIECES.split(", ")]
    left = pieces.filter("is_open").groupBy(F.floor(F.col("part") / merge_partitions).alias("merge_group")).applyInPandas(_merge(window), PIECES)
    return pieces.filter("not is_open").select(*names).unionByName(left)
