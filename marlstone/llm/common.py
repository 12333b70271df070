"""Shared pieces: the shared scratch folder, table reading, and row iteration over Arrow batches.

Intermediate tables are written as Parquet in the folder named by ``spark.checkpoint.dir`` (all executors and
the driver share it), so that a lost executor costs a recomputation of its own tasks only. They stay there while a result
may still be read; a cluster's folder is cleared as its checkpoints are.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from an Arrow batch at a time, so that Python holds few whole texts at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one, deleted at exit, only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Cuts the lineage of df by writing it; empty tables keep their schema."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._marlstone_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() wrote and that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._marlstone_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


#: Rows of a small table that a task writes at least.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, in no more partitions than these rows need; large tables keep theirs."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def unused(name: str, df: DataFrame) -> str:
    """The name, or one like it that no column of df has (Spark tells names apart without their case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def sql_list(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)
