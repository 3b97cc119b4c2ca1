"""Scans and sinks: JSON arrays, JSON lines, caption files, one table per entity."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.parsing import missing_keys


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one array of objects; malformed files become null rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_wrapped_arrays(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Files that hold an array, or an object with the array under ``key``; rows carry
    ``source_file`` and their ``position``."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("_raw"))
    kind = T.ArrayType(T.StructType.fromDDL(schema))
    bare = F.startswith(F.ltrim("_raw"), F.lit("["))
    # null or missing arrays give no rows
    rows = F.when(bare, F.from_json("_raw", kind)).otherwise(F.from_json(F.get_json_object("_raw", f"$.{key}"), kind))
    return text.select("source_file", F.posexplode(rows).alias("position", "_row")).select("source_file", "position", "_row.*")


def read_checkpoint(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """JSON lines with the last row of each key; blank lines are skipped. Lines are ordered
    by file name, then by place in the file (a file is read in order within its splits)."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).filter(F.length(F.trim("value")) > 0)
    placed = lines.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"), F.from_json("value", schema).alias("_r"))
    return last_wins(placed.select("_f", "_b", "_n", "_r.*"), keys, ("_f", "_b", "_n"))


def split_valid(rows: DataFrame, schema: str, required: tuple[str, ...], raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON object has the required keys, with it as ``row``, and the others with
    their ``problem``: nothing is dropped without a trace."""
    lost = missing_keys(F.col(raw), required)
    no_object = F.json_object_keys(F.col(raw)).isNull()
    problem = F.when(no_object, "not an object").when(F.size(lost) > 0, F.concat(F.lit("missing: "), F.array_join(lost, ", ")))
    marked = rows.withColumn("problem", problem)
    return marked.filter("problem is null").drop("problem").withColumn("row", F.from_json(raw, schema)), marked.filter("problem is not null")


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each key: the last in ``order``. An aggregate, so hot keys combine early."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.struct(F.lit(1)), F.struct(*order)).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def prefer_source(preferred: DataFrame, fallback: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of ``preferred``, and those of ``fallback`` for keys that it lacks altogether."""
    missing = fallback.join(preferred.select(key).distinct(), key, "left_anti")
    return preferred.unionByName(missing, allowMissingColumns=True)


def source_state(files: DataFrame) -> DataFrame:
    """Per video, from a listing with ``path``: are there a video file and captions?"""
    name = F.element_at(F.split("path", "/"), -1)
    video = F.regexp_extract(name, r"^([^.]+)", 1)
    return files.select(video.alias("video_id"), name.alias("_n")).groupBy("video_id").agg(
        F.bool_or(F.col("_n").rlike(r"\.(mp4|mkv|webm)$")).alias("has_video"), F.bool_or(F.col("_n").rlike(r"\.vtt$")).alias("has_captions")
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of a folder without the files' contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def missing_policy(keys: DataFrame, rows: DataFrame, key: str, policy: str) -> DataFrame:
    """What to do about keys without rows: ``skip`` them, ``zero`` (count 0) or ``fail``."""
    counts = keys.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    if policy == "skip":
        return counts.filter("n is not null")
    if policy == "zero":
        return counts.select(key, F.coalesce("n", F.lit(0)).alias("n"))
    if policy == "fail":
        return counts.select(key, F.coalesce(F.col("n"), F.raise_error(F.concat(F.lit("no rows for "), F.col(key).cast("string"))).cast("long")).alias("n"))
    raise ValueError(f"unknown policy {policy!r}")


def has_audio_loss(extracted: str = "audio_seconds", whole: str = "duration", least: float = 0.8) -> Column:
    """True where extracted audio is shorter than ``least`` of the video."""
    return F.col(extracted) < least * F.col(whole)


# --- sinks -----------------------------------------------------------------------------


def write_partitioned(rows: DataFrame, path: str, key: str = "video_id", mode: str = "overwrite", fmt: str = "parquet") -> None:
    rows.repartition(key).write.mode(mode).partitionBy(key).format(fmt).save(path)


def append_checkpoint(rows: DataFrame, path: str, batch: str) -> None:
    """Add a batch of JSON lines. A batch is a folder, written as a whole: one that is sent
    again, or again after a failure, replaces itself. Names of batches are in their order."""
    rows.write.mode("overwrite").json(f"{path}/{batch}")


def new_keys(rows: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """Skip-if-present: rows of keys of which nothing is stored yet."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def existing_keys(rows: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """The other half of ``new_keys``: rows of keys of which something is stored."""
    return rows.join(stored.select(key).distinct(), key, "left_semi")


def replace_keys(rows: DataFrame, stored: DataFrame, key: str = "video_id") -> DataFrame:
    """Delete-then-insert: stored rows but for the keys that ``rows`` brings, and ``rows``."""
    return new_keys(stored, rows, key).unionByName(rows)


def overwrite_partitions(rows: DataFrame, path: str, key: str = "video_id") -> None:
    """Replace on disk only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


class VectorStore:
    """Vectors of one collection, partitioned by video."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(schemas.VECTOR).parquet(self.path)
        except Exception as e:  # the store's first use
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schemas.VECTOR)
            raise

    def ingest(self, vectors: DataFrame, rebuild: bool = False) -> None:
        if rebuild:
            overwrite_partitions(vectors, self.path)
        else:
            new_keys(vectors, self.rows()).write.mode("append").partitionBy("video_id").parquet(self.path)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; without it
    a session in one process uses a temporary one, and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster share no other folder")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cuespan-scratch")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def merge_in_place(rows: DataFrame, path: str, key: str = "video_id", skip_existing: bool = False) -> None:
    """Write ``rows`` into a table partitioned by ``key``: keys that are there already are
    left alone, or replaced as a whole."""
    spark = rows.sparkSession
    if not skip_existing:
        overwrite_partitions(rows, path, key)
        return
    try:
        stored = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:  # the table's first use
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = rows.limit(0)
    new_keys(rows, stored, key).write.mode("append").partitionBy(key).parquet(path)


def pair_of_outputs(pairs: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Resume: work that has no result yet."""
    return pairs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def show_table(rows: DataFrame, n: int = 100, tee: str | None = None) -> str:
    """A report table as text; for small results. With ``tee`` it is written there as well."""
    shown = rows.limit(n).toPandas().to_string(index=False)
    if tee is not None:
        rows.sparkSession.createDataFrame([(shown,)], "value string").coalesce(1).write.mode("overwrite").text(tee)
    return shown
