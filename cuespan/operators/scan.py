"""Order-dependent operators for a key of any size: prefix scans over ranges.

A window over a key is one task, however many rows the key has. Here the rows are cut into
ranges of (key, order) and written down once; every range of a key is scanned on its own, and
what a range passes on to the next ones (a running sum or maximum, its last row) is one row a
range and key, scanned in turn and joined back. So a video of 10^9 cues is as many tasks as
there are ranges.

Null keys are one key; rows equal in key and order keep a fixed order, as the cut numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import scratch_folder
from .sequence import LAST_SECONDS

_PART, _ROW = "_part", "_row"


class Ranges:
    """``rows`` in ranges of (key, order), with columns added by scans.

    ``rows`` of a Ranges may be given further columns; they are dropped at the end with
    ``done``. Passes are lazy but for the cut itself."""

    def __init__(self, rows: DataFrame, key: str, order: list[str]) -> None:
        self.key, self.order = key, order
        path = scratch_folder(rows.sparkSession, "ranges")
        columns = [F.col(key), *[F.col(c) for c in order]]
        cut = rows.repartitionByRange(*columns).withColumn(_PART, F.spark_partition_id()).withColumn(_ROW, F.monotonically_increasing_id())
        cut.write.parquet(path)
        self.rows = rows.sparkSession.read.schema(cut.schema).parquet(path)

    def _within(self):
        return W.partitionBy(self.key, _PART).orderBy(*self.order, _ROW)

    def _carry(self, per: DataFrame, mine: str, to: str) -> DataFrame:
        """``rows`` with ``per``'s column ``mine`` of their range as ``to``."""
        held = per.select(F.col(self.key).alias("_k"), F.col(_PART).alias("_p"), F.col(mine).alias(to))
        return self.rows.join(held, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col(_PART) == F.col("_p")), "left").drop("_k", "_p")

    def running(self, how: str, value: Column, to: str, inclusive: bool = False) -> Ranges:
        """Sum or maximum (``how``: sum, max) over all earlier rows of the key; null without any."""
        fold = {"sum": F.sum, "max": F.max}[how]
        rows = self.rows.withColumn("_v", value)
        own = fold("_v").over(self._within().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
        per = rows.groupBy(self.key, _PART).agg(fold("_v").alias("_a"))
        before = W.partitionBy(self.key).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
        per = per.withColumn("_c", fold("_a").over(before))
        self.rows = rows.withColumn("_own", own).drop("_v")
        self.rows = self._carry(per, "_c", "_carried")
        both = F.coalesce(F.col("_own") + F.col("_carried"), F.col("_own"), F.col("_carried")) if how == "sum" else F.greatest("_own", "_carried")
        self.rows = self.rows.withColumn(to, both).drop("_own", "_carried")
        return self

    def numbered(self, to: str) -> Ranges:
        """The place of each row in its key, from 1."""
        return self.running("sum", F.lit(1).cast("long"), to, inclusive=True)

    def neighbour(self, column: str, to: str, offset: int) -> Ranges:
        """The column of the row before (-1) or after (1); null at the end of the key."""
        if offset not in (-1, 1):
            raise ValueError("the row before or the row after")
        place = F.struct(*self.order, _ROW)
        # a struct around the value tells a null that is there from a row that isn't
        box = F.struct(F.col(column).alias("x"))
        edge = (F.max_by if offset < 0 else F.min_by)(box, place)
        per = self.rows.groupBy(self.key, _PART).agg(edge.alias("_e"))
        by = W.partitionBy(self.key).orderBy(_PART)
        per = per.withColumn("_c", (F.lag if offset < 0 else F.lead)("_e").over(by))
        own = (F.lag if offset < 0 else F.lead)(box).over(self._within())
        self.rows = self.rows.withColumn("_own", own)
        self.rows = self._carry(per, "_c", "_carried")
        self.rows = self.rows.withColumn(to, F.coalesce("_own", "_carried")["x"]).drop("_own", "_carried")
        return self

    def done(self) -> DataFrame:
        return self.rows.drop(_PART, _ROW)


def merge_islands(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Coalesce of a key's spans, one row an island: the furthest end so far, and where a span
    begins beyond it, a new island; two scans, and an aggregate that folds early."""
    cut = Ranges(spans.select(key, start, end), key, [start, end]).running("max", F.col(end), "_reach")
    opens = F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)
    marked = cut.running("sum", opens.cast("long"), "_island", inclusive=True).done()
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")


def segments_of(phrases: DataFrame) -> DataFrame:
    """As in ``sequence``: a phrase ends where the next one begins, and repeats are dropped."""
    cut = Ranges(phrases, "video_id", ["seq"]).neighbour("start", "_next", 1).neighbour("text", "_before", -1).done()
    ended = cut.withColumn("end", F.coalesce("_next", F.col("start") + LAST_SECONDS))
    return ended.filter(~F.col("text").eqNullSafe(F.coalesce("_before", F.lit("")))).select("video_id", "seq", "start", "end", "text")


def renumber(rows: DataFrame, key: str, order: str, to: str, kind: str = "q", offset: int = 15) -> DataFrame:
    """As in ``sequence``: ids overwritten by position, from offset + 1."""
    cut = Ranges(rows, key, [order]).numbered("_n").done()
    return cut.withColumn(to, F.format_string(f"%s_{kind}%03d", F.col(key).cast("string"), (F.col("_n") + offset).cast("long"))).drop("_n")
