"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: a worker never holds more than one batch of texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, fix how scans are split (else the executors that are alive would have a say in it), and make sure that there is a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share. Only on one machine (tests) a temporary one is made where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        at = context.getCheckpointDir()
        if not at:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: no lineage is left, so a lost executor costs a reread only."""
    out = df.checkpoint(eager=True)
    del df
    gc.collect()  # frames that nobody names any more are let go on the other side, too
    out.sparkSession._jvm.System.gc()  # lets Spark drop the shuffle files that the written rows no longer need
    return out


def map_arrow(df: DataFrame, make: Callable[..., Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, *args: Any) -> DataFrame:
    """mapInArrow with a function that is built once per task: make(*args) returns batch -> batch. The columns travel under plain names, as mapInArrow takes dots for fields."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make(*args)
        for batch in batches:
            if batch.num_rows and (out := step(pa.RecordBatch.from_arrays(batch.columns, names=names))) is not None:
                yield out

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: What a plan may hold for its rows to come in the same partitions and order whenever it runs.
SCANS = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "LogicalRDD"}


def repeatable(df: DataFrame) -> bool:
    """Whether df is no more than a scan of files or of a checkpoint, with deterministic expressions."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name not in SCANS or not node.deterministic() or node.subqueries().size():
            return False
        if name == "LogicalRelation" and node.relation().getClass().getSimpleName() != "HadoopFsRelation" or name == "LogicalRDD" and not node.rdd().isCheckpointed():
            return False
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return True


def keyed(df: DataFrame, *wanted: Column) -> DataFrame:
    """rid, the wanted columns, and the whole row as a struct named `row`, so that no column of df can clash with another.

    rid tells rows apart in place of doc_id, which may be null or repeated. Another scan must give the rows the same ids: what is no plain scan is written to the
    checkpoint folder first."""
    return (df if repeatable(df) else settle(df)).select(F.monotonically_increasing_id().alias("rid"), *wanted, F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"))


def unpacked(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `row` as they were, some of them changed."""
    names = rows.schema["row"].dataType.names
    return rows.select(*((changed[c] if c in changed else F.col(f"row.{quoted(c)}")).alias(c) for c in names))


#: Rows of a few numbers each that may be sent to all tasks.
SMALL = 300_000


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A written table as a side of a join: broadcast if it has `most` rows or fewer; beyond, the join shuffles, and hot keys of the other side are split by the adaptive plan."""
    return F.broadcast(df) if df.count() <= most else df


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About `most` rows of df, never more than a quarter above: all if there are fewer, else those whose keys hash below the share. Unlike a sorted limit, no partition sends more than its part."""
    share = most / max(df.count(), 1)
    if share >= 1:
        return df
    cut = int(share * (1 << 40))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < cut).limit(most + most // 4)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit("")).alias(name)
