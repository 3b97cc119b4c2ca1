"""Commits on a shared folder: resumable batches, and a versioned store.

Data is written to a folder of its own attempt, which no reader looks at, and counts from the
moment a marker file that names it is renamed into place, without overwriting: of two
attempts at one marker one wins, and a crash before the rename leaves nothing but an attempt
to be swept. Only the session's Hadoop file system is used; the rename is as atomic as that
file system's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import with_every_config

TRIES = 20


class CommitLog:
    """``attempts/attempt=<id>`` has data, ``<kind>/<name>`` the id that counts under a name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, kind: str) -> list[str]:
        p, fs = self._fs(kind)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName()[0] not in "._") if fs.exists(p) else []

    def attempt_of(self, kind: str, name: str) -> str:
        p, fs = self._fs(f"{kind}/{name}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def folder(self, attempt: str) -> str:
        return f"{self.path}/attempts/attempt={attempt}"

    def write(self, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        attempt = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(self.folder(attempt))
        return attempt

    def claim(self, kind: str, name: str, attempt: str) -> bool:
        """Make ``attempt`` what ``kind/name`` stands for; False if that is taken."""
        draft, fs = self._fs(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        to, _ = self._fs(f"{kind}/{name}")
        fs.mkdirs(to.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, to, no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def remove(self, attempt: str) -> None:
        p, fs = self._fs(f"attempts/attempt={attempt}")
        fs.delete(p, True)

    def read(self, attempts: list[str], schema: str) -> DataFrame:
        """Rows of the attempts, with ``attempt``; ``schema`` is that of their columns."""
        if not attempts:
            return self.spark.createDataFrame([], f"{schema}, attempt string")
        return self.spark.read.schema(f"{schema}, attempt string").option("basePath", f"{self.path}/attempts").parquet(*[self.folder(a) for a in attempts])

    def sweep(self, used: set[str]) -> int:
        """Remove the attempts that aren't in ``used``: while no writer is at work."""
        p, fs = self._fs("attempts")
        found = [s.getPath().getName().removeprefix("attempt=") for s in fs.listStatus(p)] if fs.exists(p) else []
        lost = [a for a in found if a not in used]
        for a in lost:
            self.remove(a)
        return len(lost)


# --- an evaluation that survives a crash -------------------------------------------------


def batch_of(key: str, batches: int) -> Column:
    """The batch of a key: 32 bits of its md5, the same in every engine."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % batches).cast("int")


class ResumableEvaluation:
    """Results by (``key``, config) below one folder, made and committed batch by batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "qa_id") -> None:
        self.log, self.schema, self.key = CommitLog(spark, path), schema, key

    def results(self) -> DataFrame:
        """What has been committed: each (key, config) once."""
        return self.log.read([self.log.attempt_of("batches", n) for n in self.log.names("batches")], self.schema).drop("attempt")

    def run(self, pairs: DataFrame, configs: tuple[str, ...], score: Callable[[DataFrame], DataFrame], batches: int, stop_after: int | None = None) -> int:
        """Score what has no result yet, in ``batches`` shares of the keys, and say how many
        batches were committed. A batch that was committed is not looked at again; one that
        failed, or whose driver died, left nothing that counts. Results of an earlier run,
        cut into another number of batches, are found by an anti join. ``score`` gets rows
        of (key, config); batches bound what a crash can cost, and are otherwise one plan.

        ``stop_after`` ends the run early, as a crash would between two batches."""
        names = [f"{batches:06d}-{b:06d}" for b in range(batches)]
        done, made = set(self.log.names("batches")), 0
        every = with_every_config(pairs.select(self.key).distinct(), configs)
        for b, name in enumerate(names):
            if name in done:
                continue
            if made == stop_after:
                break
            todo = every.filter(batch_of(self.key, batches) == b).join(self.results().select(self.key, "config"), [self.key, "config"], "left_anti")
            attempt = self.log.write(score(todo))
            if self.log.claim("batches", name, attempt):
                made += 1
            else:
                self.log.remove(attempt)  # another driver was faster
        return made

    def sweep(self) -> int:
        return self.log.sweep({self.log.attempt_of("batches", n) for n in self.log.names("batches")})


# --- a store with versions ---------------------------------------------------------------


class VersionedStore:
    """Rows by ``key`` (a video) with snapshots: a reader has one version, whole, whatever is
    written meanwhile.

    Version n is a manifest, a table of (key, attempt) that says which attempt holds the rows
    of each key; it is published by the marker ``versions/<n>``. Writers prepare data and a
    manifest against the last version, and try again on the next one if another was faster;
    data is written once, whatever the number of tries."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "video_id") -> None:
        self.spark, self.log, self.schema, self.key = spark, CommitLog(spark, path), schema, key
        self.kind = dict(f.split(maxsplit=1) for f in schema.split(", "))[key]

    def _join(self, a: DataFrame, b: DataFrame, how: str, *more: str) -> DataFrame:
        """Semi or anti join on the key, and on ``more``; a null key is a key."""
        other = b.select(F.col(self.key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in more])
        on = F.col(self.key).eqNullSafe(F.col("_key"))
        for c in more:
            on = on & (F.col(c) == F.col(f"_{c}"))
        return a.join(other, on, how)

    def versions(self) -> list[int]:
        return [int(n) for n in self.log.names("versions")]

    def _manifest(self, version: int | None) -> DataFrame:
        """(key, held): the attempt that holds a key, in a version."""
        schema = f"{self.key} {self.kind}, held string"
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.log.read([self.log.attempt_of("versions", f"{version:012d}")], schema).drop("attempt")

    def _last(self) -> int | None:
        return max(self.versions(), default=None)

    def rows(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default of the last: fixed when this is called."""
        version = self._last() if version is None else version
        manifest = self._manifest(version)
        attempts = [r.held for r in manifest.select("held").distinct().collect()]  # one a commit, at most
        names = [f.split()[0] for f in self.schema.split(", ")]
        found = self.log.read(attempts, self.schema)
        return self._join(found, manifest.withColumnRenamed("held", "attempt"), "left_semi", "attempt").select(*names)

    def write(self, rows: DataFrame, replace: bool = False) -> int | None:
        """Publish a version with ``rows``: only those of keys that aren't there yet, or, with
        ``replace``, in the place of all rows of their keys. Returns its number, or None if
        there was nothing to add."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        last = self._last()
        fresh = rows.select(*names) if replace else self._join(rows.select(*names), self._manifest(last), "left_anti")
        attempt = self.log.write(fresh, (self.key,))
        keys = self.log.read([attempt], self.schema).select(self.key, F.col("attempt").alias("held")).distinct()  # of the folders' names
        if keys.isEmpty():
            self.log.remove(attempt)
            return None
        for _ in range(TRIES):
            last = self._last()
            old = self._manifest(last)
            if replace:
                new = self._join(old, keys, "left_anti").unionByName(keys)
            else:  # of two writers of one key the first stays
                new = old.unionByName(self._join(keys, old, "left_anti"))
            manifest = self.log.write(new.coalesce(8))
            version = 0 if last is None else last + 1
            if self.log.claim("versions", f"{version:012d}", manifest):
                return version
            self.log.remove(manifest)
        raise RuntimeError(f"{TRIES} other writers were faster")

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and remove the attempts that none of them
        needs. While no writer is at work, nor a reader of a version that goes."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {self.log.attempt_of("versions", f"{v:012d}") for v in kept}
        for v in kept:
            used |= {r.held for r in self._manifest(v).select("held").distinct().collect()}
        for v in versions[:-keep]:
            p, fs = self.log._fs(f"versions/{v:012d}")
            fs.delete(p, False)
        return self.log.sweep(used)
