"""Small CSV files with the quirks of the feed, written byte by byte."""

from __future__ import annotations

from pathlib import Path

from caselight import fixed_values as fv
from caselight.sources.feed import TABLE_COLUMNS

ID_HEADER = "REPORT_ID"  # any name: the first column is the case id


def record(table: str, order: str | None = None, **values: str) -> list[str]:
    fields = [values.get(c, "") for c in TABLE_COLUMNS[table]]
    return fields if order is None else [*fields, order]


def quoted(value: str) -> str:
    if any(c in value for c in ',"\r\n'):
        return '"' + value.replace('"', '""') + '"'
    return value


def write_feed(path: Path, table: str, rows: list, order_column: bool = False, eol: str = "\r\n") -> str:
    header = [ID_HEADER, *TABLE_COLUMNS[table][1:], *([fv.ORDER_COLUMN] if order_column else [])]
    lines = [",".join(header)]
    for row in rows:
        lines.append(row if isinstance(row, str) else ",".join(quoted(v) for v in row))
    text = eol.join(lines) + eol
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))
    return str(path)
