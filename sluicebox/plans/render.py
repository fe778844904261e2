"""Results as text: aligned tables, JSON rows and lists. Results are small; rows come to the driver one by one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def cell(v) -> str:
    """Null is empty, whole floats have no fraction, others their shortest form."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)
    return str(v)


def rows_of(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    return df.columns, [[cell(v) for v in r] for r in df.toLocalIterator()]


def text_table(columns: list[str], rows: list[list[str]]) -> str:
    """Columns padded to their longest cell in bytes, two spaces apart; the last is not padded."""
    if not columns:
        return "(no columns)\n"
    size = lambda x: len(x.encode())
    widths = [max([size(c), *(size(r[i]) for r in rows)]) for i, c in enumerate(columns)]
    line = lambda cells: "".join(c + " " * (widths[i] - size(c) + 2) if i + 1 < len(cells) else c for i, c in enumerate(cells)) + "\n"
    out = line(columns) + line(["-" * w for w in widths]) + "".join(map(line, rows))
    return out if rows else out + "(no rows)\n"


def json_rows(columns: list[str], rows: list[list[str]]) -> str:
    """An array of objects whose values are all strings, in the order of the columns; <, > and & are escaped."""
    text = lambda x: json.dumps(x, ensure_ascii=False).translate({ord(c): f"\\u{ord(c):04x}" for c in "<>&  "})
    return "[" + ",".join("{" + ",".join(f"{text(c)}:{text(v)}" for c, v in zip(columns, r, strict=True)) + "}" for r in rows) + "]"


def indented(text: str) -> str:
    """JSON text over several lines, two spaces a level; <, > and & are escaped."""
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False).translate({ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}) + "\n"


def numbered(items: list[str]) -> str:
    """Items with their numbers, a blank line between them."""
    return "\n\n".join(f"{i}. {x}" for i, x in enumerate(items, 1))
