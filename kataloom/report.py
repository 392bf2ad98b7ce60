"""Small results as text, CSV and JSON on the driver; large ones go through DataFrame writers."""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame


def number(value: Any) -> str:
    """Whole numbers with '.' between thousands, floats with four places, null as '-'."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}".replace(",", ".")
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def shortened(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(0, width - 1)] + "…"


def table(headers: Sequence[str], rows: Sequence[Sequence[Any]], width: int = 60) -> str:
    cells = [[shortened(number(x), width) for x in r] for r in rows]
    wide = [max(len(h), *(len(r[i]) for r in cells)) if cells else len(h) for i, h in enumerate(headers)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip()
    return "\n".join([line(headers), line(["-" * w for w in wide]), *map(line, cells)])


def key_values(values: Mapping[str, Any], title: str = "") -> str:
    wide = max(map(len, values), default=0)
    return "\n".join([*([title, "=" * len(title)] if title else []), *(f"{k.ljust(wide)}  {number(v)}" for k, v in values.items())])


def bar(value: float, most: float, width: int = 30) -> str:
    return "#" * round(width * value / most) if most > 0 else ""


def rows_of(df: DataFrame, limit: int = 1000) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def export_csv(path: str, headers: Sequence[str], rows: Sequence[Sequence[Any]]) -> None:
    """UTF-8 with a byte order mark."""
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        csv.writer(file).writerows([headers, *rows])


def export_json(path: str, data: Any) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(data, file, ensure_ascii=False, indent=2, default=str)


def export(df: DataFrame, path: str) -> None:
    """Any size, as a folder: .csv with a header, .jsonl or .parquet."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif path.endswith(".jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)
