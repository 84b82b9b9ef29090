"""Report the best precursor candidates of every record, by origin.

Reads a table of sequences, finds six-frame reading frames, predicts each distinct protein's core once, and keeps every record's best
candidates with how many genomes hold the same peptide.  Two folders are written, both by ``origin``: ``candidates`` and
``summary`` (one row an origin).  A run replaces the partitions of the origins it has read, so it can run again, for all
origins or for some, with the same result.

    python -m jobs.candidate_report --input PATH --out PATH [--only ORIGIN ...] [--config jobs/candidate_report.json]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandforge.lineage import cut
from strandforge.operators import index, orf, rank, rules
from strandforge.plans.progress import observed

CONFIG = Path(__file__).with_suffix(".json")
CANDIDATES = "record_id string, gbk_file string, rank int, strand string, frame int, genomic_start int, genomic_end int, protein string, position int, core string, score double, confidence string, genome_count long, origin string"
SUMMARY = "records long, frames long, candidates long, high long, best_score double, origin string"
log = logging.getLogger("jobs.candidate_report")


def named_origin(origin: str) -> Column:
    """A partition's name: a null and an empty origin are told apart, and none is read back as a number."""
    return F.coalesce(F.concat(F.lit("from-"), F.expr(origin).cast("string")), F.lit("unknown"))


def candidates(table: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(candidates, summary) of a table of sequences.

    Frames are made once and written, in as many tasks as the session shuffles to: a table may be read in few tasks, one for each row
    group, and its sequences are few bytes beside the work on them.  A protein is scored once however many records hold it; candidates of a record are ordered by
    score, length, strand and place, and those whose protein has no allowed cleavage site are left out.
    """
    own = table.select(F.expr(config["record"]).alias("record_id"), F.expr(config["genome"]).alias("gbk_file"), named_origin(config["origin"]).alias("origin"), F.expr(config["sequence"]).alias("sequence"), F.lit(0).alias("window_start"))
    own = rules.dealt(own.filter("sequence is not null"))
    found = cut(orf.with_protein(orf.orfs(own, config["min_aa"], config["max_aa"])).drop("dna", "window_start"))
    best = rules.predict(rules.dealt(found.select(F.col("protein").alias("sequence")).distinct()), "sequence", rules.ruleset(config["preset"]), top_n=1)
    best = best.select(F.col("sequence").alias("protein"), "position", "core", F.round("score", 6).alias("score"), "confidence")
    scored = found.join(best, "protein")
    order = [F.desc("score"), F.desc("aa_len"), "strand", "genomic_start", "genomic_end"]
    top = rank.top_k(scored, [F.col(c) if isinstance(c, str) else c for c in order], config["best"], ["origin", "gbk_file", "record_id"], keep="rank")
    shown = index.lookup_genomes(top, index.build_index(found)).select(*(c.split()[0] for c in CANDIDATES.split(", ")))
    by_origin = found.groupBy("origin").agg(F.count("*").alias("frames"), F.count_distinct("gbk_file", "record_id").alias("records"))
    return shown, by_origin


def run(spark: SparkSession, source: str, out: str, config: dict, only: list[str] | None = None) -> dict[str, int]:
    """Write the report of ``source`` under ``out``; what was read and written."""
    table = spark.read.parquet(source)
    if only is not None:
        table = table.filter(F.expr(config["origin"]).cast("string").isin(only))
    seen = Observation()
    shown, by_origin = candidates(table.observe(seen, F.count(F.lit(1)).alias("rows")), config)
    _put(shown, f"{out}/candidates")
    counts = {"rows": observed(seen, "rows")}
    written = read_candidates(spark, out).groupBy("origin").agg(F.count("*").alias("candidates"), F.count_if(F.col("confidence") == "high").alias("high"), F.max("score").alias("best_score"))
    summary = by_origin.join(written, "origin", "left").select("records", "frames", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("high", F.lit(0)).cast("long").alias("high"), "best_score", "origin")
    _put(summary, f"{out}/summary")
    own = read_summary(spark, out).join(F.broadcast(by_origin.select("origin")), "origin", "left_semi") if only is not None else read_summary(spark, out)
    counts |= own.agg(F.count("*").alias("origins"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "frames", "candidates"))).first().asDict()
    log.info("%s: read %d rows, %d frames of %d records; wrote %d candidates of %d origins to %s", source, counts["rows"], counts["frames"], counts["records"], counts["candidates"], counts["origins"], out)
    return counts


def _put(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "origin").write.partitionBy("origin").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_candidates(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).parquet(f"{out}/candidates")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(f"{out}/summary")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    for name in ("--input", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--only", nargs="+", help="origins to report; all others' partitions stay")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("candidate_report").getOrCreate()
    try:
        run(spark, a.input, a.out, json.loads(Path(a.config).read_text()), a.only)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
