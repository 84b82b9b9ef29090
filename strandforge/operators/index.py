"""Peptide occurrence index: counts, genomes, and the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instance_counts(orfs: DataFrame) -> DataFrame:
    return orfs.groupBy("protein").agg(F.count("*").alias("instance_count"))


def genome_counts(orfs: DataFrame) -> DataFrame:
    """Distinct genomes by peptide: pairs are made distinct first, so a frequent peptide never gathers in one task."""
    return orfs.select("protein", "gbk_file").distinct().groupBy("protein").agg(F.count("*").alias("genome_count"))


def peptides(orfs: DataFrame) -> DataFrame:
    return orfs.select("protein").distinct().withColumn("aa_len", F.length("protein"))


def peptide_stats(known: DataFrame, counts: DataFrame, genomes: DataFrame) -> DataFrame:
    """Every known peptide with its counts, 0 where it has none."""
    out = known.join(counts, "protein", "left").join(genomes, "protein", "left")
    return out.select("protein", "aa_len", F.coalesce("instance_count", F.lit(0)).cast("long").alias("instance_count"), F.coalesce("genome_count", F.lit(0)).cast("long").alias("genome_count"))


def build_index(orfs: DataFrame) -> DataFrame:
    """All of it in one aggregation over distinct (peptide, genome) counts."""
    pairs = orfs.groupBy("protein", "gbk_file").agg(F.count("*").alias("n"))
    return pairs.groupBy("protein").agg(F.sum("n").alias("instance_count"), F.count("*").alias("genome_count")).withColumn("aa_len", F.length("protein"))


def lookup_genomes(candidates: DataFrame, index: DataFrame | None) -> DataFrame:
    """Adds genome_count: 0 for an unknown peptide, null without an index."""
    if index is None:
        return candidates.withColumn("genome_count", F.lit(None).cast("long"))
    own = index.select(F.col("protein").alias("_p"), F.col("genome_count"))
    return candidates.join(own, candidates.protein == F.col("_p"), "left").drop("_p").withColumn("genome_count", F.coalesce("genome_count", F.lit(0)).cast("long"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert with addition: counts of both, summed by peptide."""
    return old.unionByName(new).groupBy("protein").agg(F.sum("instance_count").alias("instance_count"))


def merge_genomes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore of (peptide, genome) pairs: running it twice changes nothing."""
    return old.select("protein", "gbk_file").unionByName(new.select("protein", "gbk_file")).distinct()
