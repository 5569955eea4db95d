"""Sinks: partitioned tables, nested columns as JSON text, and row-count reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialgrid.functions.exprs import numbers_of


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text so that the table fits a CSV file."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            # sorted keys
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    nested_as_json(df).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet; rows are clustered on the partition columns first so that each folder gets few files."""
    if partition_by:
        df = df.repartition(*partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_dataset(tables: dict[str, DataFrame], path: str, keys: dict[str, Sequence[str]], expected: dict[str, int] | None = None) -> dict[str, int]:
    """Write named tables sorted by key and reconcile their row counts with the expectation."""
    counts = {}
    for name, df in tables.items():
        target = f"{path}/{name}"
        write_table(df, target, sort_by=keys.get(name, ()))
        counts[name] = df.sparkSession.read.parquet(target).count()
    for name, n in (expected or {}).items():
        if counts.get(name) != n:
            raise ValueError(f"{name}: expected {n} rows, wrote {counts.get(name)}")
    return counts


def expected_search_rows(rounds: int, budget: int, top_k: int, bucket: int, budgets: int) -> dict[str, int]:
    """Row counts the search outputs must have."""
    return {"rounds": rounds, "top_k": rounds * min(top_k, budget), "buckets": rounds * -(-budget // bucket), "curve": rounds * budgets}


def feature_bundle(df: DataFrame, views: dict[str, Sequence[str]], cells: str = "mask") -> DataFrame:
    """Wide frame: round, six numbers, ``view__feature`` columns and 49 grid cells."""
    cols = [F.get("numbers", i).alias(f"number_{i + 1}") for i in range(6)]
    for view, names in views.items():
        cols += [F.get(view, i).alias(f"{view}__{n}") for i, n in enumerate(names)]
    on = numbers_of(F.col(cells), 49)
    cols += [F.array_contains(on, i + 1).cast("int").alias(f"grid_mask__cell_{i + 1}") for i in range(49)]
    return df.select("round_no", *cols)


def rank_table(df: DataFrame, moduli: Sequence[int]) -> DataFrame:
    """Rank features with one residue column per modulus."""
    return df.select("*", *[(F.col("rank") % m).alias(f"mod_{m}") for m in moduli])
