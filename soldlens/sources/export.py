"""Exports: CSV with doubled quotes and empty nulls, JSON as one array or as lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.operators.merge import MERGED_FIELDS

EXTRA = ("total_price", "has_real_id", "first_seen_at", "last_seen_at")


def export_columns() -> list[str]:
    """Listing fields, then the extras."""
    return ["item_id", "site", *MERGED_FIELDS, "matches_query", "position", "extraction", "confidence", *EXTRA]


def export_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV parts; `single` makes one part, for results known to be small."""
    out = rows.coalesce(1) if single else rows
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def export_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_json(rows: DataFrame, path: str) -> int:
    """One array with an indent of two, streamed row by row to a local file; returns the rows written."""
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in text.toLocalIterator():
            body = json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            f.write(("," if n else "") + "\n  " + body)
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n
