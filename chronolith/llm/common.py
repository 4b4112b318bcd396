"""Shared pieces of the corpus operators: column picking, batching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.shared import global_rank, materialize, shared_dir

__all__ = ["SLICE_ROWS", "global_rank", "materialize", "pick", "set_aside", "shared_dir", "slices", "table"]

#: Rows that a Python operator turns into Python objects at a time.
SLICE_ROWS = 256


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name first and then by case-insensitive name.

    Goes by position, so further columns whose names differ only by case, or repeat, do no harm.
    """
    found = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name] or [
            i for i, c in enumerate(df.columns) if c.lower() == name.lower()
        ]
        if not at:
            raise ValueError(f"no column {name!r} among {df.columns}")
        found.append(at[0])
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{i}").alias(n) for i, n in zip(found, names, strict=True)])


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with the named columns under these names and all others under names that clash with nothing, and the names.

    With ``select(*the names).toDF(*docs.columns)`` the columns are as they were.
    """
    places = {}
    for name in names:
        at = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name!r} among {docs.columns}")
        places[at[0]] = name
    renamed = [places.get(i, f"__c{i}") for i in range(len(docs.columns))]
    return docs.toDF(*renamed), renamed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a few long texts, not thousands, are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
