"""Shared helpers of the training-data operators.

Scratch data goes to the shared folder named by ``spark.checkpoint.dir``. Where that is
not set, a session in one process uses a temporary folder, and a cluster is an error.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The six ASCII white-space bytes of the word definition ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = b" \t\n\r\x0b\x0c"
WORD_GAP = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1
#: Keys with more than one in so many of all rows are hot; there are fewer of them than this.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster share no other folder")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cuespan-scratch")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def sweep_scratch(spark: SparkSession, hours: float = 24.0) -> int:
    """Remove scratch tables that are older than ``hours`` and say how many they were. They
    outlive their query, whose result is read lazily: to be called when no job needs them."""
    root = scratch_path(spark, "x").rpartition("/")[0]
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = time.time() - hours * 3600
    found = [s.getPath() for s in fs.listStatus(p) if s.getModificationTime() / 1000 < old and re.search(r"-[0-9a-f]{32}$", s.getPath().getName())] if fs.exists(p) else []
    return sum(bool(fs.delete(x, True)) for x in found)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage
    that outlives executors and keeps what comes before from being computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus))


def unit_hash(seed: int, *cols: str) -> Column:
    """A uniform number in [0, 1) from 52 bits of md5, equal in every engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def give_back() -> None:
    """Return a worker's free memory to the system. Workers outlive their task, and an idle
    one takes its memory from the executor's next stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def some_rows(batches: Iterable[pa.RecordBatch], n: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``n`` rows: a worker holds no more texts as Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
        del b
    give_back()


def hot_join(rows: DataFrame, few: DataFrame, keys: list[str], is_hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key; ``how`` is inner or left.

    Rows of hot keys stay where they are, and the hot part of ``few``, which must have a
    bound, goes to them; the others are left to the engine. Null keys meet nothing and
    aren't shuffled either: they would all be dealt to one task."""
    hot = few.filter(is_hot)
    some = rows.dropna(subset=keys)
    cold = some.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(few.filter(~is_hot), keys, how)
    both = some.join(F.broadcast(hot), keys).unionByName(cold)
    if how == "inner":
        return both
    no_key = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return both.unionByName(rows.filter(no_key), allowMissingColumns=True)


def ranged(rows: DataFrame, order: list[Column], tag: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` cut into ranges of ``order`` and written down with the number ``part`` of the
    range, and one row a range: part, its rows ``n``, and the rows of the ranges before it.

    Equal rows lie in one range; the second table has as many rows as there are shuffle
    partitions, at most."""
    cut = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), tag)
    parts = cut.groupBy("part").agg(F.count("*").alias("n"))
    return cut, parts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
