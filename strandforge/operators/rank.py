"""Ranking, selection and de-duplication with explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.operators.rules import Rule, best_rule_score


def embedding_score(mode: str) -> Column:
    """The score that ranks; a missing top_n_mean counts as 0, with no fallback to the best similarity."""
    return F.col("best_similarity") if mode == "best_similarity" else F.coalesce("top_n_mean_similarity", F.lit(0.0))


def rank_candidates(scored: DataFrame, record: str = "record_id", mode: str = "top_n_mean", min_rule_score: float = 0.0, rules: dict[str, Rule] | None = None, allow_inverted: bool = False) -> DataFrame:
    """Order by embedding score within a record, after the rule cutoff where one is set.

    ``scored``: candidate_id, protein, best_similarity, top_n_mean_similarity, ord.  Adds embedding_score, rule_score_raw, rule_orientation and rank; ties
    keep the order of best similarity, then ord.
    """
    out = scored.withColumn("embedding_score", embedding_score(mode)).withColumn("combined_score", F.col("embedding_score"))
    if min_rule_score > 0:
        raw = best_rule_score(scored.select(F.col("protein").alias("sequence")), rules, allow_inverted).withColumnRenamed("sequence", "_seq")
        out = out.join(raw, F.upper(F.trim("protein")) == F.col("_seq")).drop("_seq").filter(F.col("rule_score_raw") >= min_rule_score)
    else:
        out = out.withColumn("rule_score_raw", F.lit(None).cast("double")).withColumn("rule_orientation", F.lit(None).cast("string"))
    order = Window.partitionBy(record).orderBy(F.round("embedding_score", 9).desc(), F.round("best_similarity", 9).desc(), "ord")  # what differs by rounding alone ties
    return out.withColumn("rank", F.row_number().over(order))


def top_k(df: DataFrame, by: list[Column], k: int, group: list[str] | None = None, keep: str | None = None) -> DataFrame:
    """The first k rows of a total order, of each group where there is one; ``keep`` names the rank within the group."""
    if not group:
        return df.orderBy(*by).limit(k)
    name = keep or "_rank"
    top = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col(name) <= k)
    return top if keep else top.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def passing_rank(df: DataFrame, group: list[str], order: list[Column], passes: Column, name: str) -> DataFrame:
    """Rank among the rows that pass, null for the others."""
    running = F.sum(passes.cast("int")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.when(passes, running))


def by_z(df: DataFrame, *ties: str) -> DataFrame:
    """Highest z first; missing and NaN ones last; equal ones by ``ties``."""
    return df.orderBy(F.when(F.isnan("z_score"), None).otherwise(F.col("z_score")).desc_nulls_last(), *ties)


def rank_loci(entries: DataFrame, ambiguous_within: int) -> DataFrame:
    """Loci of a case by matches, median distance, span and place; ambiguous where the best one has a near equal.

    ``entries``: case_id, match_count, median_distance (null: no match), locus_span, gbk_path, record_id, start, end.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc("match_count"), F.col("median_distance").asc_nulls_last(), "locus_span", "gbk_path", "record_id", "start", "end")
    ranked = entries.withColumn("locus_rank", F.row_number().over(order)).withColumn("_m", F.first("match_count").over(order)).withColumn("_d", F.first("median_distance").over(order))
    near = (F.col("match_count") == F.col("_m")) & F.coalesce(F.abs(F.col("median_distance") - F.col("_d")) <= ambiguous_within, F.lit(False))
    other = F.max((near & (F.col("locus_rank") > 1)).cast("int")).over(Window.partitionBy("case_id"))
    return ranked.withColumn("ambiguous", near & (other == 1)).drop("_m", "_d")
