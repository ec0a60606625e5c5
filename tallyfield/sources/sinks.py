"""Sinks: snapshots with manifests, strict JSON, CSV exports with sidecars, reports."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.ingest import season_stats


def snapshot(plays: DataFrame, path: str) -> dict:
    """Write plays by season over their own partitions; returns the manifest."""
    plays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    rows = season_stats(plays.sparkSession.read.parquet(path)).orderBy("season").collect()
    return {"seasons": [r.asDict() for r in rows]}


def strict_json(value: object) -> str:
    """JSON without NaN or infinities; a number that isn't finite is an error."""

    def check(x: object, at: str = "$") -> None:
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError(f"{at} is {x}")
        if isinstance(x, dict):
            for k, v in x.items():
                check(v, f"{at}.{k}")
        elif isinstance(x, list | tuple):
            for i, v in enumerate(x):
                check(v, f"{at}[{i}]")

    check(value)
    return json.dumps(value, sort_keys=True, allow_nan=False)


def canonical_hash(profile: dict) -> str:
    """Identity of a profile by content: key order doesn't matter."""
    import hashlib

    return hashlib.sha256(strict_json(profile).encode()).hexdigest()


def export_csv(df: DataFrame, path: str, attribution: str) -> dict:
    """CSV whose text cells can't start a formula, and the sidecar that describes it."""
    safe = [F.regexp_replace(c, r"^([=+\-@\t\r])", "'$1").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    out = df.select(*safe)
    out.write.mode("overwrite").option("header", True).csv(path)
    digest = out.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(*))").alias("h")).first()
    return {"columns": [{"name": c, "type": t} for c, t in df.dtypes], "rows": digest.n, "content": f"{(digest.h or 0) & (2**64 - 1):016x}", "attribution": attribution}


def markdown(title: str, rows: list[dict]) -> str:
    """A small result as a table; values that aren't finite are refused."""
    strict_json(rows)
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    head = list(rows[0])
    body = "\n".join("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)
    return f"# {title}\n\n| {' | '.join(head)} |\n|{'---|' * len(head)}\n{body}\n"
