"""Personal data: fixed base rules, and contexts that the base finds teach (bootstrapped contextual extraction).

Seeds are the spans of the base rules.  The words before them induce lexical patterns; over the whole corpus a
pattern-instance graph is built (which identifier-like strings follow a pattern, and how often anything else
does), and patterns and instances score each other for a few rounds in Spark.  Patterns that end with a high
score then discover identifiers of the same kind that the base rules miss: numbers written in another way,
addresses that are spelled out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, ready, stash, texts

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many distinct seeds and this score after these rounds; a word in it counts by its last code
#: points, so many.
MIN_INSTANCES, MIN_SCORE, ROUNDS, MAX_CONTEXT = 3, 0.75, 3, 64
#: So many candidate patterns are sent to the workers; where there are more, what the texts hold is joined with them,
#: after a bitmap of so many bits has dropped most of what is no pattern.
MOST_SENT, FILTER_BITS = 20_000, 1 << 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no later start in a run of digits can match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
#: What an identifier of a kind may look like beyond the base rules.  Rare marks are sought first, and what stands
#: around them is matched then.
_AT = re.compile(r"@|\(at\)|\[at\]|\sat\s")
_HOST = re.compile(r"\s?[\w-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[\w-]++)+")
_NUMBERS = {
    "ip": re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9]){11,18}"),
    "phone": re.compile(r"\(?[0-9](?:[ ()./_-]{0,2}[0-9]){6,14}"),
}
_HEX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")


def _loose(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        done = 0
        for m in _AT.finditer(text):
            end = m.start()
            end -= end > done and text[end - 1].isspace()
            low = end
            while low > done and (text[low - 1].isalnum() or text[low - 1] in "_.%+-"):
                low -= 1
            host = _HOST.match(text, m.end()) if low < end else None
            if host:
                done = host.end()
                yield low, done
        return
    for m in _NUMBERS[kind].finditer(text):
        yield m.span()
    if kind == "ip" and text.count(":") > 1:
        for m in _HEX.finditer(text):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a place in ``KINDS``, end) by start, then kind."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        m = _DOMAIN.match(text, at + 1) if low < at else None
        if m:
            found.append((low, 0, m.end()))
            done = m.end()
        else:
            done = max(done, low) if low < at else done
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(word: str) -> str:
    """A word as patterns hold it: its end in small letters, digits read as 9."""
    return re.sub(r"[0-9]+", "9", word[-MAX_CONTEXT:].lower())


class _Before:
    """The words before any place of a text, which is cut into words once."""

    def __init__(self, text: str):
        self.text, self.starts = text, None

    def __call__(self, start: int) -> list[str]:
        """The word before a place (or the part of a word that leads to it), and the two words."""
        if self.starts is None:
            spans = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.ends = [x[0] for x in spans], [x[1] for x in spans]
        i = bisect_left(self.starts, start) - 1
        if i < 0:
            return []
        last = self._word(i, min(self.ends[i], start))
        return [last, f"{self._word(i - 1, self.ends[i - 1])} {last}"] if i else [last]

    def _word(self, i: int, end: int) -> str:
        return _shape(self.text[max(self.starts[i], end - MAX_CONTEXT) : end])


def _flat(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _seed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: Counter = Counter()
        for text in texts(b.column(0)):
            before = _Before(text)
            for s, k, e in base_spans(text):
                for c in before(s):
                    rows[c, KINDS[k], text[s:e]] += 1
        yield pa.RecordBatch.from_pydict({"context": [r[0] for r in rows], "kind": [r[1] for r in rows], "instance": [r[2] for r in rows], "n": list(rows.values())}, schema=pa.schema([("context", pa.string()), ("kind", pa.string()), ("instance", pa.string()), ("n", pa.int64())]))


def _words(text: str) -> list[str]:
    return [_shape(w) for w in text.split()] if len(max(text.split(), key=len, default="")) > MAX_CONTEXT else re.sub(r"[0-9]+", "9", text.lower()).split()


def _edges(patterns: frozenset):
    """Occurrences of each pattern (instance null), and what it is followed by where that looks like its kind."""
    kinds: dict[str, list[str]] = {}
    for c, k in patterns:
        kinds.setdefault(c, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: Counter = Counter()
            for text in texts(b.column(0)):
                words = _words(text)
                seen = Counter(words)
                for w in seen.keys() & kinds.keys():
                    for k in kinds[w]:
                        rows[w, k, None] += seen[w]
                pairs = Counter(zip(words, words[1:], strict=False)) if any(" " in c for c in kinds) else {}
                for (x, y), n in pairs.items():
                    if (w := f"{x} {y}") in kinds:
                        for k in kinds[w]:
                            rows[w, k, None] += n
                before = _Before(text)
                for s, k, e in discoveries(text, patterns, base_spans(text), known=True):
                    for c in before(s):
                        if (c, KINDS[k]) in patterns:
                            rows[c, KINDS[k], text[s:e]] += 1
            yield pa.RecordBatch.from_pydict({"context": [r[0] for r in rows], "kind": [r[1] for r in rows], "instance": [r[2] for r in rows], "n": list(rows.values())}, schema=pa.schema([("context", pa.string()), ("kind", pa.string()), ("instance", pa.string()), ("n", pa.int64())]))

    return run


def discoveries(text: str, patterns: frozenset, base: list[tuple[int, int, int]], known: bool = False) -> list[tuple[int, int, int]]:
    """Spans that follow a pattern, look like its kind and touch no base span; with ``known`` base spans too."""
    found = [x for x in base] if known else []
    if not patterns:
        return found
    before = _Before(text)
    starts, ends = [b[0] for b in base], [0]
    for b in base:
        ends.append(max(ends[-1], b[2]))
    free = lambda s, e: ends[bisect_left(starts, e)] <= s  # noqa: E731  every base span that starts before e ends by s
    for k, kind in enumerate(KINDS):
        if not any(p[1] == kind for p in patterns):
            continue
        for s, e in _loose(kind, text):
            if (s and text[s - 1].isalnum()) or text[e : e + 1].isalnum() or not free(s, e):
                continue
            if any((c, kind) in patterns for c in before(s)):
                found.append((s, k, e))
                starts, ends = _add(starts, ends, s, e)
    return found


_MET = pa.schema([("doc", pa.int64()), ("k", pa.int32()), ("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("instance", pa.string()), ("n", pa.int64())])


def _may_edges(bits: np.ndarray):
    """As :func:`_edges`, for contexts that the bitmap holds: how often each is met (k: -1), and what each is followed
    by, by document and in the order in which :func:`discoveries` looks; spans that touch a base span are left out."""

    def may(context: str) -> bool:
        at = zlib.crc32(context.encode()) % FILTER_BITS
        return bool(int(bits[at >> 5]) >> (at & 31) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 40
        for b in batches:
            seen: Counter = Counter()
            rows = []
            for text in texts(b.column(0)):
                doc += 1
                words = _words(text)
                seen.update(words)
                seen.update(f"{x} {y}" for x, y in zip(words, words[1:], strict=False))
                base, before = base_spans(text), _Before(text)
                starts, ends = [x[0] for x in base], [0]
                for x in base:
                    ends.append(max(ends[-1], x[2]))
                for k, kind in enumerate(KINDS):
                    for place, (s, e) in enumerate(_loose(kind, text)):
                        if (s and text[s - 1].isalnum()) or text[e : e + 1].isalnum() or ends[bisect_left(starts, e)] > s:
                            continue
                        rows += [(doc, k, place, s, e, c, text[s:e], 1) for c in before(s) if may(c)]
            rows += [(0, -1, 0, 0, 0, c, None, n) for c, n in seen.items() if may(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MET)], schema=_MET)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that follow a pattern, in order of document, kind and place: those that touch no span found before."""
    key, span, kept = None, None, False
    starts, ends = [], [0]
    for b in batches:
        rows = []
        for doc, k, place, s, e, c, instance, n in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if doc != key:
                key, span, starts, ends = doc, None, [], [0]
            if (k, place) != span:  # a span has a row for each of its patterns
                span, kept = (k, place), ends[bisect_left(starts, e)] <= s
                if kept:
                    starts, ends = _add(starts, ends, s, e)
            if kept:
                rows.append((c, KINDS[k], instance, n))
        yield pa.RecordBatch.from_pydict({f: [r[i] for r in rows] for i, f in enumerate(("context", "kind", "instance", "n"))}, schema=pa.schema([("context", pa.string()), ("kind", pa.string()), ("instance", pa.string()), ("n", pa.int64())]))


def _joined(rows: DataFrame, wide: DataFrame, seeds: DataFrame, shape: str) -> DataFrame:
    """What :func:`_edges` gives for the patterns ``wide``, by joins: they stay on the cluster, whatever their number."""
    at = F.crc32(F.col("context").cast("binary")) % FILTER_BITS
    held = wide.select(F.shiftright(at, 5).alias("w"), (at % 32).cast("int").alias("b")).distinct()
    bits = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in held.groupBy("w").agg(F.sum(F.expr("shiftleft(1L, b)")).alias("bits")).collect():  # at most FILTER_BITS / 32 rows
        bits[r["w"]] = r["bits"]
    may = stash(rows.mapInArrow(_may_edges(bits), "doc long, k int, place int, start int, end int, context string, instance string, n long"))
    met = may.filter("k < 0").groupBy("context").agg(F.sum("n").alias("n")).join(wide, "context").select("context", "kind", F.lit(None).cast("string").alias("instance"), "n")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("k") + 1)
    follow = may.filter("k >= 0").withColumn("kind", kind).join(wide, ["context", "kind"], "left_semi").select(*_MET.names)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = follow.repartition(parts, "doc").sortWithinPartitions("doc", "k", "place").mapInArrow(_settle, shape)
    known = seeds.join(wide, ["context", "kind"], "left_semi").select("context", "kind", "instance", "n")
    return met.unionByName(found).unionByName(known)


def _add(starts: list[int], ends: list[int], s: int, e: int) -> tuple[list[int], list[int]]:
    both = sorted([*zip(starts, ends[1:], strict=True), (s, e)])
    out = [0]
    for _, x in both:
        out.append(max(out[-1], x))
    return [x for x, _ in both], out


def learn_patterns(docs: DataFrame, text_col: str = "text", *, min_instances: int = MIN_INSTANCES, min_score: float = MIN_SCORE, rounds: int = ROUNDS, most_sent: int = MOST_SENT) -> frozenset[tuple[str, str]]:
    """(context, kind) patterns of high confidence over all of ``docs``; of over ``most_sent`` candidates only
    those of high confidence leave the cluster."""
    need(docs, text_col)
    ready(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"))
    shape = "context string, kind string, instance string, n long"
    seeds = stash(rows.mapInArrow(_seed_contexts, shape).groupBy("context", "kind", "instance").agg(F.sum("n").alias("n")))
    wide = stash(seeds.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= min_instances).select("context", "kind"))
    some = wide.limit(most_sent + 1).collect()
    if not some:
        return frozenset()
    if len(some) > most_sent:
        every = _joined(rows, wide, seeds, shape)
    else:
        every = rows.mapInArrow(_edges(frozenset((r["context"], r["kind"]) for r in some)), shape)
    graph = stash(every.groupBy("context", "kind", "instance").agg(F.sum("n").alias("n")))
    met = graph.filter("instance is null").select("context", "kind", F.col("n").alias("met"))
    edges = graph.filter("instance is not null")
    known = seeds.select("kind", "instance").distinct().withColumn("seed", F.lit(True))
    edges = stash(edges.join(known, ["kind", "instance"], "left").join(met, ["context", "kind"], "left").withColumn("score", F.coalesce(F.col("seed"), F.lit(False)).cast("double")))
    for last in [False] * rounds + [True]:
        weight = F.sum(F.col("n") * F.col("score")) / F.greatest(F.coalesce(F.max("met"), F.lit(0)), F.sum("n"))
        patterns = edges.groupBy("context", "kind").agg(weight.alias("trust"), F.count_if(F.col("score") >= 0.5).alias("instances"))
        if last:
            break
        # an instance is as good as its patterns make it; the noisy-or of their trust
        trusted = edges.join(patterns.select("context", "kind", "trust"), ["context", "kind"])
        again = trusted.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-12)))))).alias("now"))
        edges = stash(edges.join(again, ["kind", "instance"]).select("context", "kind", "instance", "n", "seed", "met", F.when(F.col("seed"), 1.0).otherwise(F.col("now")).alias("score")))
    good = patterns.filter((F.col("trust") >= min_score) & (F.col("instances") >= min_instances)).select("context", "kind").collect()
    return frozenset((r["context"], r["kind"]) for r in good)


def find_pii(docs: DataFrame, text_col: str = "text", *, patterns: frozenset | None = None, masked_col: str | None = None) -> DataFrame:
    """``docs`` without the text, with n_email, n_ip, n_card, n_phone (base rules), base_spans, spans and n_added;
    with ``masked_col`` also the text in which each span is replaced by its kind in brackets.

    A null text is the empty text.  Spans count code points, end exclusive.  Patterns are learned from ``docs``
    unless given.  Columns of these names are replaced; others stay.  Repeated rows repeat their result.  An empty
    table gives no rows.
    """
    need(docs, text_col)
    if patterns is None:
        patterns = learn_patterns(docs, text_col)
    ready(docs.sparkSession)
    long = [T.StructField(n, T.LongType()) for n in (*(f"n_{k}" for k in KINDS), "n_added")]
    more = [*long, *(T.StructField(n, T.StringType()) for n in ("base_spans", "spans", *([masked_col] if masked_col else [])))]
    gone = {f.name for f in more} | {text_col}
    out = T.StructType([f for f in docs.schema.fields if f.name not in gone] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, list] = {f.name: [] for f in more}
            for text in texts(b.column(b.schema.get_field_index(text_col))):
                base = base_spans(text)
                added = discoveries(text, patterns, base)
                count = Counter(k for _, k, _ in base)
                for k, kind in enumerate(KINDS):
                    made[f"n_{kind}"].append(count[k])
                made["n_added"].append(len(added))
                every = sorted(base + added)
                made["base_spans"].append(_flat(base))
                made["spans"].append(_flat(every))
                if masked_col:
                    made[masked_col].append(mask(text, every))
            kinds = {f.name: pa.int64() if f in long else pa.string() for f in more}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], kinds[f.name]) if f.name in made else b.column(b.schema.get_field_index(f.name)) for f in out.fields], names=out.names)

    return docs.mapInArrow(run, out)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap are one, named by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
