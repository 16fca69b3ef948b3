"""A small strict SQL: rows or aggregates of one table, columns by name or by position.

    query  := SELECT item {',' item} FROM target [WHERE any] [GROUP BY col {',' col}]
              [ORDER BY col [ASC|DESC] {',' ...}] [LIMIT int] [OFFSET int] [';']
    item   := '*' | col | COUNT '(' ('*' | col) ')' | (SUM | MIN | MAX | AVG) '(' col ')'
    any    := all {OR all}        all := one {AND one}        one := NOT one | '(' any ')' | pred
    pred   := col op value | col BETWEEN value AND value | col CONTAINS string | col [NOT] IN '(' value {',' value} ')'
              | col [NOT] LIKE string | col IS [NOT] NULL                          op: > >= < <= = <>
    value  := int | decimal | string        col := ordinal | identifier
    target := quoted path of a part | identifier of a view
    string := "'" {char | "''"} "'"

Nothing is dropped in silence: an unknown column, a wrong type, an open quote or a word too many is an error.  Numbers
compare with numbers, texts with texts.  The text becomes a frozen plan, and the plan becomes DataFrame operations that
Catalyst optimises.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import count_rows, max_or_zero, mean, min_or_zero, sum_or_zero
from ..operators.predicates import contains, in_range
from ..schema import QueryError, column_name, ordered_column, text_column
from ..sources.parts import read_part

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?)(?![\w.])|(?P<word>[A-Za-z_]\w*)|(?P<sign>>=|<=|<>|[(),*;<>=]))")
_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}
_WORDS = frozenset("select from where and or not between contains in like is null count sum min max avg group order by asc desc limit offset".split())
_AGGREGATES = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Aggregate:
    kind: str  # count, sum, min, max, avg, column, or all (columns)
    column: str | int | None


@dataclass(frozen=True)
class Predicate:
    column: str | int
    op: str  # a comparison, between, contains, in, like, null
    low: int | Decimal | str | tuple | None = None
    high: int | Decimal | str | None = None


@dataclass(frozen=True)
class Logic:
    kind: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class LitePlan:
    table: str
    is_path: bool
    aggregates: tuple[Aggregate, ...]
    where: Predicate | Logic | None = None
    groups: tuple[str | int, ...] = ()
    order: tuple[tuple[str | int, bool], ...] = ()
    limit: int | None = None
    offset: int = 0


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read: {text[at:].strip()[:30]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")

    def take(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def is_word(self, word: str) -> bool:
        kind, value = self.peek()
        return kind == "word" and value.lower() == word

    def skip(self, value: str) -> bool:
        if self.peek()[1].lower() == value and self.peek()[0] != "string":
            self.at += 1
            return True
        return False

    def want(self, value: str) -> None:
        if not self.skip(value):
            raise QueryError(f"expected {value.upper()}, found {self.peek()[1]}")

    def number(self) -> int:
        kind, value = self.take()
        if kind != "number" or "." in value:
            raise QueryError(f"expected a whole number, found {value}")
        return int(value)

    def value(self) -> int | Decimal | str:
        kind, value = self.take()
        if kind == "number":
            return Decimal(value) if "." in value else int(value)
        if kind == "string":
            return value[1:-1].replace("''", "'")
        raise QueryError(f"expected a number or a quoted text, found {value}")

    def text(self) -> str:
        kind, value = self.take()
        if kind != "string":
            raise QueryError(f"expected a quoted text, found {value}")
        return value[1:-1].replace("''", "'")

    def column(self) -> str | int:
        kind, value = self.take()
        if kind == "number" and value.isdigit():
            return int(value)
        if kind == "word" and value.lower() not in _WORDS:
            return value
        raise QueryError(f"expected a column, found {value}")

    def several(self, one) -> tuple:
        found = [one()]
        while self.skip(","):
            found.append(one())
        return tuple(found)


def parse(text: str) -> LitePlan:
    r = _Reader(text)

    def item() -> Aggregate:
        if r.skip("*"):
            return Aggregate("all", None)
        for kind in _AGGREGATES:
            if r.is_word(kind):
                r.take()
                r.want("(")
                column = None if kind == "count" and r.skip("*") else r.column()
                r.want(")")
                return Aggregate(kind, column)
        return Aggregate("column", r.column())

    def chain(word: str, one):
        found = [one()]
        while r.skip(word):
            found.append(one())
        return found[0] if len(found) == 1 else Logic(word, tuple(found))

    def either():
        return chain("or", lambda: chain("and", single))

    def single():
        if r.skip("not"):
            return Logic("not", (single(),))
        if r.skip("("):
            found = either()
            r.want(")")
            return found
        return predicate()

    def predicate():
        column = r.column()
        if r.skip("between"):
            low = r.value()
            r.want("and")
            return Predicate(column, "between", low, r.value())
        if r.skip("contains"):
            pattern = r.text()
            if not pattern:
                raise QueryError("the pattern is empty")
            return Predicate(column, "contains", pattern)
        if r.skip("is"):
            no = r.skip("not")
            r.want("null")
            found = Predicate(column, "null")
            return Logic("not", (found,)) if no else found
        no = r.skip("not")
        if r.skip("in"):
            r.want("(")
            found = Predicate(column, "in", r.several(r.value))
            r.want(")")
        elif r.skip("like"):
            found = Predicate(column, "like", r.text())
        elif no:
            raise QueryError(f"expected IN or LIKE, found {r.peek()[1]}")
        else:
            kind, op = r.take()
            if op not in _COMPARE or kind != "sign":
                raise QueryError(f"expected a comparison, found {op}")
            return Predicate(column, op, r.value())
        return Logic("not", (found,)) if no else found

    def ordering() -> tuple[str | int, bool]:
        kind = next((k for k in _AGGREGATES if r.is_word(k)), None)
        column = r.take()[1].lower() if kind and r.tokens[r.at + 1 : r.at + 2] != [("sign", "(")] else r.column()
        descending = r.skip("desc")
        return column, descending or (r.skip("asc") and False)

    r.want("select")
    aggregates = r.several(item)
    r.want("from")
    kind, table = r.take()
    if kind not in ("string", "word") or (kind == "word" and table.lower() in _WORDS):
        raise QueryError(f"expected a table, found {table}")
    where = either() if r.skip("where") else None
    groups: tuple = ()
    if r.skip("group"):
        r.want("by")
        groups = r.several(r.column)
    order: tuple = ()
    if r.skip("order"):
        r.want("by")
        order = r.several(ordering)
    limit = r.number() if r.skip("limit") else None
    offset = r.number() if r.skip("offset") else 0
    r.skip(";")
    if r.peek()[0] != "end":
        raise QueryError(f"nothing can follow here: {r.peek()[1]}")
    plain = [a for a in aggregates if a.kind in ("column", "all")]
    if plain and not groups and len(plain) < len(aggregates):
        raise QueryError("a plain column beside an aggregate needs GROUP BY")
    if groups and any(a.kind == "all" for a in aggregates):
        raise QueryError("* cannot be grouped")
    if min(limit or 0, offset) < 0:
        raise QueryError("LIMIT and OFFSET count rows")
    return LitePlan(table[1:-1].replace("''", "'") if kind == "string" else table, kind == "string", aggregates, where, groups, order, limit, offset)


def _typed(df: DataFrame, column: str | int, *values) -> str:
    """The column's name, if it can be compared with the values: all numbers, or all texts."""
    texts = [isinstance(v, str) for v in values]
    if all(texts):
        return text_column(df, column)
    if any(texts):
        raise QueryError("numbers and texts are mixed")
    return ordered_column(df, column)


def _condition(df: DataFrame, p: Predicate | Logic) -> Column:
    if isinstance(p, Logic):
        parts = [_condition(df, x) for x in p.parts]
        return ~parts[0] if p.kind == "not" else reduce(operator.and_ if p.kind == "and" else operator.or_, parts)
    if p.op == "contains":
        return contains(df, p.column, p.low)
    if p.op == "between" and not isinstance(p.low, str) and not isinstance(p.high, str):
        return in_range(df, p.column, p.low, p.high)
    if p.op == "between":
        return F.col(_typed(df, p.column, p.low, p.high)).between(p.low, p.high)
    if p.op == "in":
        return F.col(_typed(df, p.column, *p.low)).isin(*p.low)
    if p.op == "like":
        return F.col(text_column(df, p.column)).like(p.low)
    if p.op == "null":
        return F.col(column_name(df, p.column)).isNull()
    return _COMPARE[p.op](F.col(_typed(df, p.column, p.low)), F.lit(p.low))


def _projected(rows: DataFrame, plan: LitePlan) -> DataFrame:
    names = [n for a in plan.aggregates for n in (rows.columns if a.kind == "all" else [column_name(rows, a.column)])]
    if plan.order:
        rows = rows.orderBy(*[F.col(column_name(rows, c)).desc() if down else F.col(column_name(rows, c)).asc() for c, down in plan.order])
    return _cut(rows.select(*names), plan)


def _cut(out: DataFrame, plan: LitePlan) -> DataFrame:
    out = out.offset(plan.offset) if plan.offset else out
    return out.limit(plan.limit) if plan.limit is not None else out


def compile_plan(df: DataFrame, plan: LitePlan) -> DataFrame:
    """Rows that pass; or count, sum_<col>, min_<col>, max_<col>, avg_<col> of them (and the groups' columns)."""
    groups = [column_name(df, g) for g in plan.groups]
    rows = df.filter(_condition(df, plan.where)) if plan.where else df
    if not groups and all(a.kind in ("column", "all") for a in plan.aggregates):
        return _projected(rows, plan)
    made: dict[str, Column] = {}
    for a in plan.aggregates:
        if a.kind == "column":
            if column_name(df, a.column) not in groups:
                raise QueryError(f"column {a.column!r} is not grouped")
        elif a.kind == "count":
            if a.column is not None:
                column_name(df, a.column)
            made["count"] = count_rows()
        else:
            made[f"{a.kind}_{column_name(df, a.column)}"] = {"sum": sum_or_zero, "min": min_or_zero, "max": max_or_zero, "avg": mean}[a.kind](df, a.column)
    if not made:
        raise QueryError("there is nothing to compute")
    out = rows.groupBy(*groups).agg(*[c.alias(n) for n, c in made.items()])
    if plan.order:
        keys = []
        for column, descending in plan.order:
            name = column if column in out.columns else column_name(df, column)
            if name not in out.columns:
                raise QueryError(f"cannot order by {column!r}")
            keys.append(F.col(name).desc() if descending else F.col(name).asc())
        out = out.orderBy(*keys)
    return _cut(out, plan)


def lite_sql(spark: SparkSession, text: str) -> DataFrame:
    plan = parse(text)
    return compile_plan(read_part(spark, plan.table) if plan.is_path else spark.table(plan.table), plan)
