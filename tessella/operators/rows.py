"""Shared ways of going through rows: sums over what comes before, and plain functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Stretches of the order that a key's rows are dealt to.
STRETCHES = 32
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that a Python worker never holds many texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def before(df: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """df with, for each value, the sum over the rows of equal keys that come earlier; the first column of the order is a number, the others break its ties.

    A window over a key alone would put a hot key into one task. The order is cut into stretches at quantiles of the whole table, windows go over (key, stretch), and a
    stretch's own offset is a sum over few rows a key. The cuts are numbers in the plan, so the dealing is the same wherever the plan runs."""
    cuts = sorted(set(df.approxQuantile(order[0], [k / STRETCHES for k in range(1, STRETCHES)], 0.01)))
    place = reduce(lambda n, cut: n + (F.col(order[0]) > cut).cast("int"), cuts, F.lit(0))
    dealt = df.withColumn("_stretch", F.coalesce(place, F.lit(0))).withColumns({f"_of_{k}": v for k, v in values.items()})
    sums = dealt.groupBy(*keys, "_stretch").agg(*(F.sum(f"_of_{k}").alias(f"_in_{k}") for k in values))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_stretch").alias("_s"), *(F.coalesce(F.sum(f"_in_{k}").over(earlier), F.lit(0)).alias(f"_at_{k}") for k in values))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys), F.col("_stretch") == F.col("_s"))
    within = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums_within = {k: F.coalesce(F.sum(f"_of_{k}").over(within), F.lit(0)) for k in values}
    return dealt.join(starts, same).withColumns({k: F.col(f"_at_{k}") + v for k, v in sums_within.items()}).select(*df.columns, *values)


def per_row(df: DataFrame, inputs: list[str], output: str, work: Callable[..., Any]) -> DataFrame:
    """df with one more column (`name type`), what a plain function gives for the inputs of each row."""
    name, _, kind = output.partition(" ")
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"{name} {kind}").fields])
    arrow = to_arrow_schema(schema).field(name).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)
