"""Writers: JSON lines, cache versions, append-only draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomroute.operators.caches import merge


def jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines (the commit is atomic) and return the number of rows."""
    df.write.json(path, ignoreNullFields=False)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def merged_cache(base: DataFrame, parts: list[DataFrame], key: str, path: str) -> dict[str, int]:
    """Fold shard caches into a new version of the base, first writer first; never truncates. Returns added and kept."""
    merge([base, *parts], key).write.parquet(path)
    total = base.sparkSession.read.parquet(path).count()
    kept = base.select(key).distinct().count()
    return {"added": total - kept, "kept": kept}


def append_draws(new: DataFrame, covered: DataFrame, key: str, path: str) -> None:
    """Append the rows whose key the read-only base does not cover."""
    new.join(covered.select(key), key, "left_anti").write.mode("append").parquet(path)


def slim(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields that training reads; open-keyed maps and the rest stay behind."""
    return df.select(*[F.col(f) for f in fields if f in df.columns])
