"""BPE encoding and decoding with a public vocabulary, exact for texts of any length.

Texts up to ``LEAF_CHARS`` are encoded directly.  A longer text is halved until its leaves are short; leaves
are encoded together (the library spreads a batch over its threads), and neighbours are joined up the tree: a
window around each join is encoded again and grows until its tokens agree with the left side's before the join
and with the right side's after it.  What lies outside the agreement is then what one pass would have given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, ready, texts

#: Longest text that is encoded at once; tokens of the first window around a join; tokens in a row that must agree.
LEAF_CHARS, FIRST_WINDOW, AGREE = 32_768, 32, 8
#: Words that a worker remembers.
MEMO_WORDS = 200_000


class Tokens:
    """ids with their places (code points) in the whole text."""

    __slots__ = ("ids", "start", "end")

    def __init__(self, ids, start, end):
        self.ids, self.start, self.end = ids, start, end

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, a: int, b: int | None = None) -> Tokens:
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b])


def _chain(*parts: Tokens) -> Tokens:
    return Tokens(*(np.concatenate([getattr(p, n) for p in parts]) for n in Tokens.__slots__))


def _clean(t: Tokens, i: int) -> bool:
    """Whether token i starts a code point that the token before it has no byte of."""
    return i == 0 or t.end[i - 1] <= t.start[i]


class TreeEncoder:
    """Encodes as ``tokenizer`` does, long texts by halves."""

    def __init__(self, tokenizer, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW, agree: int = AGREE):
        self.tokenizer, self.leaf, self.first, self.agree = tokenizer, leaf_chars, first_window, agree

    def _some(self, pieces: list[str], at: list[int]) -> list[Tokens]:
        made = []
        for e, base in zip(self.tokenizer.encode_batch(pieces, add_special_tokens=False), at, strict=True):
            places = np.fromiter(chain.from_iterable(e.offsets), dtype=np.int64, count=2 * len(e)).reshape(-1, 2) + base
            made.append(Tokens(np.array(e.ids, dtype="<u4"), places[:, 0], places[:, 1]))
        return made

    def _leaves(self, a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= self.leaf:
            return [(a, b)]
        mid = (a + b) // 2
        return self._leaves(a, mid) + self._leaves(mid, b)

    def encode(self, text: str) -> np.ndarray:
        spans = self._leaves(0, len(text))
        level: list[tuple[int, int, Tokens]] = []
        for k in range(0, len(spans), 16):  # few of the library's large results at a time
            some = spans[k : k + 16]
            level += [(a, b, t) for (a, b), t in zip(some, self._some([text[a:b] for a, b in some], [a for a, _ in some]), strict=True)]
        while len(level) > 1:
            joined = [(x[0], y[1], self._join(text, x, y)) for x, y in zip(level[::2], level[1::2], strict=False)]
            level = joined + ([level[-1]] if len(level) % 2 else [])
        return level[0][2].ids

    def _join(self, text: str, x: tuple, y: tuple) -> Tokens:
        (a, cut, left), (_, b, right) = x, y
        width = self.first
        while True:
            i = max(0, len(left) - width)
            while i > 0 and not _clean(left, i):
                i -= 1
            j = min(len(right), width)
            while j < len(right) and not _clean(right, j):
                j += 1
            lo = int(left.start[i]) if i else a
            hi = int(right.start[j]) if j < len(right) else b
            window = self._some([text[lo:hi]], [lo])[0]
            before = (0, 0) if i == 0 else self._meet(window, left, i, len(left), True)
            after = (len(window), len(right)) if j == len(right) else self._meet(window, right, 0, j, False)
            if before and after and before[0] <= after[0]:
                return _chain(left.part(0, before[1]), window.part(before[0], after[0]), right.part(after[1]))
            width *= 2

    def _meet(self, window: Tokens, side: Tokens, lo: int, hi: int, backwards: bool) -> tuple[int, int] | None:
        """Places (in the window, in the side) inside a run of tokens on which both agree, nearest to the join."""
        at = {int(s): lo + k for k, s in reversed(list(enumerate(side.start[lo:hi].tolist())))}
        starts = window.start.tolist()
        order = range(len(window) - self.agree, -1, -1) if backwards else range(len(window) - self.agree + 1)
        for k in order:
            m = at.get(starts[k])
            if m is None or m + self.agree > hi or (k and starts[k - 1] == starts[k]):
                continue
            n = self.agree
            if all((getattr(window, f)[k : k + n] == getattr(side, f)[m : m + n]).all() for f in Tokens.__slots__):
                for d in range(n // 2, n):  # join well inside the run
                    if _clean(window, k + d) and _clean(side, m + d):
                        return k + d, m + d
        return None


class WordBpe:
    """ids of a word-end vocabulary: lower case, blanks dropped.

    Short texts of plain Latin letters go word by word through a bounded memo that the library fills; the
    library's own split, read from its file, finds the words.  Any other text goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        setup = json.loads(self.tokenizer.to_str())
        steps = (setup.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n["type"] for n in (setup.get("normalizer") or {}).get("normalizers", [])]
        pattern = steps[0].get("pattern", {}).get("Regex")
        known = steps[0].get("type") == "Split" and steps[0].get("invert") and kinds == ["NFC", "Replace", "Lowercase"]
        self.split = regex.compile(pattern).findall if pattern and known else None
        # letters whose composition, case and class no Unicode version has changed
        self.plain = regex.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*").fullmatch
        self.special = [t["content"] for t in setup["added_tokens"]]
        self.tree = TreeEncoder(self.tokenizer)
        self.memo: dict[str, bytes] = {}
        suffix = setup["model"].get("end_of_word_suffix") or None
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])

    def _learn(self, words: list[str]) -> None:
        """Many new words at once: as one text, cut after the tokens that end a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) == len(words) and cuts[-1] == 4 * len(ids):
            raw = ids.tobytes()
            self.memo.update((w, raw[a:b]) for w, a, b in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
        else:
            for w in words:
                self.memo[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, many: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found: list[bytes | None] = [None] * len(many)
        words: dict[int, list[str]] = {}
        whole = []
        for k, text in enumerate(many):
            if len(text) > self.tree.leaf:
                found[k] = self.tree.encode(text).tobytes()
            elif self.split and self.plain(text) and not any(s in text for s in self.special):
                words[k] = self.split(text.lower())
            else:
                whole.append(k)
        for k, e in zip(whole, self.tokenizer.encode_batch([many[k] for k in whole], add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, dtype="<u4").tobytes()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        if new := list({w for ws in words.values() for w in ws if w not in memo}):
            self._learn(new)
        for k, ws in words.items():
            found[k] = b"".join(map(memo.__getitem__, ws))
        return found

    def decoder(self) -> Callable[[np.ndarray], str]:
        if self.tokenizer.decoder is None:  # then tokens are joined by a space
            names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
            return lambda ids: " ".join(map(names.__getitem__, ids.tolist()))
        return lambda ids: self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder, with its memo, for all tasks of a worker."""
    return WordBpe(path)


def word_bpe_path() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def _with(schema: T.StructType, *more: T.StructField) -> T.StructType:
    gone = {f.name for f in more}
    return T.StructType([f for f in schema.fields if f.name not in gone] + list(more))


def encode(df: DataFrame, text_col: str = "text", *, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text instead of the text: ``ids_col`` binary (little-endian unsigned
    32-bit), ``n_tokens`` long.  A null text is the empty text: no ids.  Columns of these names are replaced;
    others stay.  No shuffle: a row is its own unit, repeated rows repeat their result."""
    need(df, text_col)
    ready(df.sparkSession)
    out = _with(T.StructType([f for f in df.schema.fields if f.name != text_col]), T.StructField(ids_col, T.BinaryType()), T.StructField("n_tokens", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path or word_bpe_path())
        for b in batches:
            ids = bpe.encode(texts(b.column(b.schema.get_field_index(text_col))))
            made = {ids_col: pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(b.schema.get_field_index(f.name)) for f in out.fields], names=out.names)

    return df.mapInArrow(run, out)


def decode(df: DataFrame, ids_col: str = "ids", *, path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``, the text that the ids decode to, special tokens kept.  Null ids: the empty text."""
    need(df, ids_col)
    ready(df.sparkSession)
    out = _with(df.schema, T.StructField(text_col, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = word_bpe(path or word_bpe_path()).decoder()
        for b in batches:
            said = pa.array([say(np.frombuffer(x or b"", dtype="<u4")) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([said if f.name == text_col else b.column(b.schema.get_field_index(f.name)) for f in out.fields], names=out.names)

    return df.mapInArrow(run, out)


def digest(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    return df.select(id_col, "n_tokens", F.sha2(F.col(ids_col), 256).alias("ids_sha256"), F.sha2(F.col(text_col).cast("binary"), 256).alias("decoded_sha256"))
