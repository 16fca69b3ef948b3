"""``python -m tallyforge.cli COMMAND``: help, status, query, gen, merge, scan."""

from __future__ import annotations

import sys

from .plans.lite_sql import lite_sql
from .schema import QueryError
from .operators.scanning import scan_files
from .session import session
from .sources.logs import INDICATORS, made_records
from .sources.parts import merge_parts, status, write_part

USAGE = """help                     this text
status PART              what a part holds
query SQL                SELECT COUNT(*)|SUM(col)|MAX(col) FROM 'part' [WHERE ...]
gen PART ROWS            write made-up records
merge OUT PART...        compact parts into a new one
scan FILE...             count the indicators in raw logs"""


def run(spark, args: list[str]) -> str:
    command, rest = (args[0].lower(), args[1:]) if args else ("help", [])
    show = lambda df: "\n".join(str(r.asDict()) for r in df.toLocalIterator())
    if command == "status" and len(rest) == 1:
        return show(status(spark, rest[0]))
    if command == "query" and rest:
        return show(lite_sql(spark, " ".join(rest)))
    if command == "gen" and len(rest) == 2:
        write_part(made_records(spark, int(rest[1])), rest[0], mode="overwrite")
        return f"wrote {rest[1]} rows to {rest[0]}"
    if command == "merge" and len(rest) >= 2:
        return f"merged {merge_parts(spark, rest[1:], rest[0]).count()} rows"
    if command == "scan" and rest:
        return show(scan_files(spark, rest, INDICATORS))
    if command == "help":
        return USAGE
    raise QueryError(f"cannot do: {' '.join(args)}\n{USAGE}")


if __name__ == "__main__":
    try:
        print(run(session(), sys.argv[1:]))
    except QueryError as e:
        sys.exit(str(e))
