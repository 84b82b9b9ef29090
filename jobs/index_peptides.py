"""Keep the peptide occurrence index of a growing folder of sequence tables.

A file stream takes the files that its checkpoint has not seen, finds their six-frame reading frames, and adds them to the index as
one batch; then it stops.  Run it as often as files arrive.  A run that breaks off is finished by the next one, which
replays its batch over the same partitions.

    python -m jobs.index_peptides --input PATH --out PATH --checkpoint PATH [--config jobs/index_peptides.json]

``--input`` is a folder or a glob (a stream can't name a single file otherwise); ``--out`` receives ``pairs/batch=/bucket=``, ``genomes/batch=`` and ``counts/bucket=``; ``fold_after`` batches the counts are brought up to date,
and until then readers add what came later.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandforge.operators import kept_index, orf
from strandforge.operators.rules import dealt
from strandforge.plans.progress import observed

CONFIG = Path(__file__).with_suffix(".json")
log = logging.getLogger("jobs.index_peptides")


def segments(table: DataFrame, config: dict) -> DataFrame:
    """record_id, gbk_file and sequence by the config's expressions; rows without a sequence have no frames.

    They are dealt out, as a file may be read in few tasks and their frames are the work.
    """
    own = table.select(F.expr(config["record"]).alias("record_id"), F.expr(config["genome"]).alias("gbk_file"), F.expr(config["sequence"]).alias("sequence"), F.lit(0).alias("window_start")).filter("sequence is not null")
    return dealt(own)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> list[dict]:
    """Take all files of ``source`` that ``checkpoint`` has not seen; one dict of counts for each batch."""
    done: list[dict] = []

    def take(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        found = orf.with_protein(orf.orfs(segments(rows, config), config["min_aa"], config["max_aa"]))
        counts = {"batch": number, **kept_index.add_batch(found, out, number, config["buckets"])}
        counts["rows"] = observed(seen, "rows")
        counts["folded"] = kept_index.fold(spark, out, number) if kept_index.fold_due(spark, out, number, config["fold_after"]) else 0
        log.info("batch %(batch)d: read %(rows)d rows, %(frames)d frames; wrote %(pairs)d pairs, %(fresh)d of them new, and the counts of %(folded)d buckets", counts)
        done.append(counts)

    stream = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_at_once"]).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d new batches into %s", source, len(done), out)
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    for name in ("--input", "--out", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("index_peptides").getOrCreate()
    try:
        run(spark, a.input, a.out, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
