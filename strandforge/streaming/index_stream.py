"""The occurrence index over a stream of segment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandforge.operators.orf import orfs, with_protein

SEGMENTS = "record_id string, sequence string"


def segment_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SEGMENTS).parquet(path)


def pair_counts(segments: DataFrame, **limits) -> DataFrame:
    """(protein, gbk_file, n) of a batch's open frames."""
    found = with_protein(orfs(segments.select(F.col("record_id").alias("gbk_file"), "sequence", F.lit(0).alias("window_start")), **limits))
    return found.groupBy("protein", "gbk_file").agg(F.count("*").alias("n"))


def run_index_stream(segments: DataFrame, out: str, checkpoint: str, **limits) -> StreamingQuery:
    """Append each micro-batch's pair counts under its batch number; a batch that runs again replaces its own folder, so counts stay exact."""

    def write(batch: DataFrame, number: int) -> None:
        pair_counts(batch, **limits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """Counts over all batches: instances are added, genomes counted once each."""
    pairs = spark.read.parquet(out).groupBy("protein", "gbk_file").agg(F.sum("n").alias("n"))
    return pairs.groupBy("protein").agg(F.sum("n").alias("instance_count"), F.count("*").alias("genome_count"))
