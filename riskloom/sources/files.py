"""Reading extracts with lineage, writing fixtures and audit rows, and configuration as a relation."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.registry import FILES, columns, schema


def scan(spark: SparkSession, folder: str, table: str, loaded_at=None) -> DataFrame:
    """One gzip CSV as text, blanks as NULL, a wrong header or column count an error, with the file's name, the
    row's number in it and the load time. A gzip file is one partition, so ids in order are row numbers."""
    path = f"{folder}/{FILES[table][0]}"
    raw = spark.read.csv(path, schema=schema(table), header=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST")
    at = F.lit(loaded_at).cast("timestamp") if loaded_at is not None else F.current_timestamp()
    return raw.select("*", F.lit(FILES[table][0]).alias("source_file"), (F.monotonically_increasing_id() + 1).alias("source_row"), at.alias("loaded_at"))


def write_csv(folder: str, table: str, rows: list[dict]) -> dict:
    """A fixture with the same bytes for the same rows; columns must be the table's. Returns rows and SHA-256."""
    names = columns(table)
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(names)
    for r in rows:
        if set(r) - set(names):
            raise ValueError(f"{table}: columns {sorted(set(r) - set(names))} aren't in the registry")
        out.writerow(["" if r.get(c) is None else r[c] for c in names])
    path = Path(folder) / FILES[table][0]
    path.parent.mkdir(parents=True, exist_ok=True)
    data = io.BytesIO()
    with gzip.GzipFile(fileobj=data, mode="wb", mtime=0, filename="") as z:
        z.write(text.getvalue().encode())
    path.write_bytes(data.getvalue())
    return {"file": FILES[table][0], "rows": len(rows), "sha256": hashlib.sha256(data.getvalue()).hexdigest()}


def append(df: DataFrame, path: str) -> None:
    """Audit rows are added, never changed."""
    df.write.mode("append").parquet(path)


def flatten(config: dict[str, Any], prefix: str = "") -> list[tuple[str, float | None, str | None]]:
    """(dotted name, number, text) of every leaf."""
    out: list[tuple[str, float | None, str | None]] = []
    for k, v in config.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out += flatten(v, f"{name}.")
        elif isinstance(v, int | float) and not isinstance(v, bool):
            out.append((name, float(v), str(v)))
        else:
            out.append((name, None, str(v)))
    return out


def config_relation(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(flatten(config), "name string, num_value double, text_value string")


def plain(df: DataFrame, most: int = 1000) -> list[dict]:
    """A small result for display: lower-case names, decimals as floats, dates as ISO text."""
    def value(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return float(v) if v.__class__.__name__ == "Decimal" else v

    return [{k.lower(): value(v) for k, v in r.asDict().items()} for r in df.limit(most).collect()]
