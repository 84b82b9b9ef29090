"""The jobs as queries: each runs twice into one new folder of the shared checkpoint folder, and its output is read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import candidate_report, index_peptides
from strandforge import queries
from strandforge.lineage import ensure_checkpoint_dir
from strandforge.operators import kept_index


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def job1_index_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' segments after two runs; the second finds nothing new.  The braces make a glob, so the table may be a file or a folder."""
    at, config = _folder(spark, "job1"), json.loads(index_peptides.CONFIG.read_text())
    for _ in range(2):
        index_peptides.run(spark, f"{sf_dir}/{{documents}}.parquet", f"{at}/index", f"{at}/checkpoint", config)
    return kept_index.read_counts(spark, f"{at}/index").select("protein", "instance_count", "genome_count", F.col("aa_len").cast("long").alias("aa_len"))


def job2_candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all documents' segments after two runs over the same partitions."""
    at, config = _folder(spark, "job2"), json.loads(candidate_report.CONFIG.read_text())
    for _ in range(2):
        candidate_report.run(spark, f"{sf_dir}/documents.parquet", at, config)
    rows = candidate_report.read_candidates(spark, at)
    return rows.join(candidate_report.read_summary(spark, at).withColumnRenamed("candidates", "of_origin").select("origin", "records", "frames", "of_origin", "high", "best_score"), "origin")


QUERIES = {"job1_index_peptides": job1_index_peptides, "job2_candidate_report": job2_candidate_report}
ORACLES = {
    "job1_index_peptides": queries.ORACLES["peptide_index"],
    "job2_candidate_report": f"""{queries._SCORED}, best as (select sequence as protein, position::int as position, core, round(score, 6) as score, case when score >= 8 then 'high' when score >= 5 then 'medium' else 'low' end as confidence
  from (select *, row_number() over (partition by sequence order by round(score, 9) desc, position) as r from scored) where r = 1),
named as (select o.*, coalesce('from-' || d.source, 'unknown') as origin from orfs o join documents d using (doc_id)),
genomes as (select protein, count(distinct gbk_file) as genome_count from orfs group by protein),
ranked as (select n.*, b.position, b.core, b.score, b.confidence, genome_count, (row_number() over (partition by origin, gbk_file, record_id order by score desc, aa_len desc, strand, genomic_start, genomic_end))::int as rank
  from named n join best b using (protein) join genomes using (protein)),
shown as (select * from ranked where rank <= 5),
by_origin as (select origin, count(distinct record_id) as records, count(*) as frames from named group by origin),
summed as (select origin, count(*) as of_origin, sum((confidence = 'high')::int)::bigint as high, max(score) as best_score from shown group by origin)
select origin, record_id, gbk_file, rank, strand, frame, genomic_start, genomic_end, protein, position, core, score, confidence, genome_count, records, frames, of_origin, high, best_score
from shown join by_origin using (origin) join summed using (origin)""",
}
