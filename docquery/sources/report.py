"""Reports as canonical JSON: the same results give the same bytes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.sources.store import replace_file

#: What differs from run to run and is left out.
VOLATILE = frozenset({"duration_ms", "elapsed_ms", "generated_at", "host", "latency_ms", "run_id", "started_at", "timestamp"})


def stable(value: object, volatile: frozenset[str] = VOLATILE) -> object:
    """The value without the volatile keys, at any depth."""
    if isinstance(value, dict):
        return {k: stable(v, volatile) for k, v in value.items() if k not in volatile}
    if isinstance(value, list | tuple):
        return [stable(v, volatile) for v in value]
    return value


def canonical(value: object, volatile: frozenset[str] = VOLATILE) -> str:
    """JSON with sorted keys and a line end; NaN and infinities, which JSON lacks, are errors."""
    return json.dumps(stable(value, volatile), sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False) + "\n"


def rows_as_json(rows: DataFrame, volatile: frozenset[str] = VOLATILE) -> DataFrame:
    """json: one line for each row, its columns by name and without the volatile ones; for reports too large for the driver."""
    columns = sorted(c for c in rows.columns if c not in volatile)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_report(rows: DataFrame, path: str, head: dict | None = None, volatile: frozenset[str] = VOLATILE) -> str:
    """Write the rows of a finished report (metrics, not documents) with what stands over them, in place of an older file.

    Rows are in the order of their JSON, so that partitions and reruns change nothing. The text that was written is returned.
    """
    lines = rows_as_json(rows, volatile).orderBy("json").collect()
    text = canonical({**(head or {}), "rows": [json.loads(r.json) for r in lines]}, volatile)
    replace_file(rows.sparkSession, path, text)
    return text
