"""Versioned Parquet tables: each write makes a new version, whose file lists the folders it consists of.

Readers keep the version they started with. Upsert is a join against the current version, delete one against the folders
that hold a key; append adds a folder to the version's list without rewriting. Old folders go with compact().
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """current with the rows of the same key replaced and the others added; of rows that share a key any one counts."""
    keys = [key] if isinstance(key, str) else key
    new = rows.dropDuplicates(keys)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def complete_files(files: DataFrame, chunks: DataFrame, expected: str = "n_expected", key: str = "file_path") -> DataFrame:
    """Files all of whose chunks are durable: the only ones that may be recorded as indexed. Files without chunks are."""
    held = chunks.groupBy(key).agg(F.count("*").alias("n_held"))
    return files.join(held, key, "left").where(F.coalesce("n_held", F.lit(0)) == F.col(expected)).drop("n_held")


def chunkless_files(files: DataFrame, chunks: DataFrame, key: str = "file_path") -> DataFrame:
    return files.join(chunks.select(key), key, "left_anti")


class Table:
    """A table under a folder of any file system that Spark writes.

    A version is a list of parts, in a file of its own; the table is at its highest version. A version's file is written
    aside and then renamed, so a run that breaks off leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[str]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith("VERSION-"))

    def _pointer(self) -> dict | None:
        found = self._versions()
        if not found:
            return None
        lines = self.spark.sparkContext.textFile(f"{self.path}/{found[-1]}").collect()
        return json.loads("".join(lines))

    def _point(self, parts: list[str], version: int) -> None:
        before = self._versions()
        fs, tmp = self._fs(f"{self.path}/NEXT-{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(json.dumps({"version": version, "parts": parts}).encode())
        out.close()
        _, to = self._fs(f"{self.path}/VERSION-{version:012d}")
        if fs.exists(to) or not fs.rename(tmp, to):
            raise RuntimeError(f"version {version} of {self.path} was written by another run")
        for name in before[:-1]:  # the version before stays for its readers
            fs.delete(self._fs(f"{self.path}/{name}")[1], False)

    def _write(self, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        (df.write.partitionBy(self.partition) if self.partition else df.write).parquet(f"{self.path}/{part}")
        return part

    @property
    def version(self) -> int:
        return (self._pointer() or {"version": 0})["version"]

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self) -> DataFrame:
        found = self._pointer()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._parts(found["parts"])

    def _parts(self, parts: list[str]) -> DataFrame:
        read = [self.spark.read.parquet(f"{self.path}/{p}") for p in parts]
        return reduce(lambda x, y: x.unionByName(y), read)

    def overwrite(self, df: DataFrame) -> None:
        self._point([self._write(df)], self.version + 1)

    def append(self, df: DataFrame) -> None:
        """Adds rows in one commit; nothing happens for none."""
        found = self._pointer()
        if found is None:
            return self.overwrite(df)
        part = self._write(df)
        if self.spark.read.parquet(f"{self.path}/{part}").isEmpty():
            fs, p = self._fs(f"{self.path}/{part}")
            fs.delete(p, True)
            return None
        return self._point([*found["parts"], part], found["version"] + 1)

    def upsert(self, rows: DataFrame, key: str | list[str]) -> None:
        self.overwrite(upsert(self.read(), rows, key) if self.exists() else rows.dropDuplicates([key] if isinstance(key, str) else key))

    def delete(self, keys: DataFrame, key: str) -> None:
        """Rewrites the parts that hold one of the keys; the others stay."""
        found = self._pointer()
        if found is None:
            return
        kept = []
        for part in found["parts"]:
            rows = self._parts([part])
            if rows.join(keys.select(key), key, "left_semi").isEmpty():
                kept.append(part)
                continue
            kept.append(self._write(delete(rows, keys, key)))
        if kept != found["parts"]:
            self._point(kept, found["version"] + 1)

    def compact(self, n_files: int | None = None) -> None:
        """Rewrites the current version (in n_files files) and deletes all older parts."""
        df = self.read()
        self.overwrite(df.repartition(n_files) if n_files else df)
        keep = {*self._pointer()["parts"], self._versions()[-1]}
        fs, p = self._fs(self.path)
        for status in fs.listStatus(p):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
