"""Data behind the result viewer: filters, totals and interval lanes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandforge.lineage import cut
from strandforge.operators.ordered import running


def shown_score():
    """First score that is there; a score of 0 is a score."""
    return F.coalesce("embedding_score", "top_n_mean_similarity", "best_similarity", F.lit(0.0))


def visible(candidates: DataFrame, threshold: float = 0.0, kind: str = "all", limit: int | None = 50, record: str = "record_id") -> DataFrame:
    """A record's candidates from the threshold on, known or novel ones alone where asked, best first, at most ``limit``."""
    own = candidates.withColumn("_score", shown_score()).filter(F.col("_score") >= threshold)
    if kind != "all":
        known = F.coalesce("is_known_precursor", F.lit(False))
        own = own.filter(known if kind == "known" else ~known)
    own = own.withColumn("view_rank", F.row_number().over(Window.partitionBy(record).orderBy(F.desc("_score"), "candidate_id")))
    return (own if limit is None else own.filter(F.col("view_rank") <= limit)).withColumnRenamed("_score", "shown_score")


def totals(segments: DataFrame, candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: records, target records, candidates, visible candidates."""
    a = segments.agg(F.count("*").alias("records"), F.count_if(F.coalesce("is_target", F.lit(False))).alias("target_records"))
    return a.crossJoin(candidates.agg(F.count("*").alias("candidates"))).crossJoin(shown.agg(F.count("*").alias("visible")))  # one row each


def islands(intervals: DataFrame, group: list[str], bucket: int = 1_000_000) -> DataFrame:
    """Adds ``_island``, the first start of the stretch of overlapping intervals that an interval belongs to.

    Between islands no interval is open.  Intervals of a group meet by ``bucket`` of starts, so a long record is many tasks' work.
    ``intervals``: group, candidate_id, start, end; read four times.
    """
    coarse, fine = [F.floor(F.col("start") / bucket)], [F.col("start"), F.col("candidate_id")]
    reached = running(intervals, group, coarse, fine, F.col("end"), "_reached", most=True)
    first = F.when(F.col("_reached").isNull() | (F.col("start") >= F.col("_reached")), F.col("start"))
    begun = running(reached.withColumn("_first", first), group, coarse, fine, F.col("_first"), "_island", most=True)
    return begun.withColumn("_island", F.coalesce("_first", "_island")).drop("_first", "_reached")


def pack_lanes(intervals: DataFrame, group: list[str], most: int | None = None, bucket: int = 1_000_000) -> DataFrame:
    """Greedy first-fit lanes of each group's intervals by start (then id): the first lane that ends by the start.

    All lanes are free where an island of overlapping intervals begins, so islands are packed apart; a task walks its islands in
    order and holds the lanes' ends alone.  ``most`` caps the lane's number, not the packing.
    """
    own = cut(intervals.select(*group, "candidate_id", "start", "end"))
    names, keyed = [*own.columns, "lane"], (*range(len(group)), len(own.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        ends: list[int] = []
        for b in batches:
            lanes = []
            keys = zip(*(b.column(i).to_pylist() for i in keyed), strict=True)
            for key, s, e in zip(keys, b.column(len(group) + 1).to_pylist(), b.column(len(group) + 2).to_pylist(), strict=True):
                if key != at:
                    at, ends = key, []
                k = next((i for i, x in enumerate(ends) if s >= x), len(ends))
                if k == len(ends):
                    ends.append(e)
                else:
                    ends[k] = max(ends[k], e)
                lanes.append(k if most is None else min(k, most))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lanes, pa.int32())], names=names)

    held = islands(own, group, bucket).select(*own.columns, "_island")
    schema = T.StructType([*own.schema.fields, T.StructField("lane", T.IntegerType())])
    return held.repartition(*group, "_island").sortWithinPartitions(*group, "_island", "start", "candidate_id").mapInArrow(run, schema)
