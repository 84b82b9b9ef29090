"""The jobs over growing and repeated input, and their queries against SQL."""

import json
import logging
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import candidate_report, index_peptides, registered
from strandforge.lineage import cut
from strandforge.operators import index, kept_index, orf


@pytest.fixture()
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()))


def config(job):
    return json.loads(job.CONFIG.read_text())


def files(path, of):
    return {str(p): p.stat().st_mtime_ns for p in path.joinpath(of).rglob("*.parquet")}


def test_the_index_takes_only_what_is_new(spark, docs, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    c = {**config(index_peptides), "buckets": 8}
    at = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    docs.filter("doc_id % 3 = 0").coalesce(1).write.parquet(at[0])
    first = index_peptides.run(spark, *at, c)
    assert [d["rows"] for d in first] == [docs.filter("doc_id % 3 = 0").count()]
    before = files(tmp_path, "out")
    assert index_peptides.run(spark, *at, c) == []
    assert files(tmp_path, "out") == before
    docs.filter("doc_id % 3 = 1").coalesce(1).write.mode("append").parquet(at[0])
    second = index_peptides.run(spark, *at, c)
    assert [(d["batch"], d["rows"]) for d in second] == [(1, docs.filter("doc_id % 3 = 1").count())]
    assert {k: v for k, v in files(tmp_path, "out").items() if "batch=0" in k} == {k: v for k, v in before.items() if "batch=0" in k}
    whole = index.build_index(orf.with_protein(orf.orfs(index_peptides.segments(docs.filter("doc_id % 3 < 2"), c), c["min_aa"], c["max_aa"])))
    assert rows(kept_index.read_counts(spark, at[1]).select("protein", "instance_count", "genome_count")) == rows(whole.select("protein", "instance_count", "genome_count"))
    assert f"read {second[0]['rows']} rows" in caplog.text
    assert second[0]["frames"] == kept_index.read_pairs(spark, at[1]).filter("batch = 1").agg(F.sum("n")).first()[0]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    at = str(tmp_path / "index")
    frames = spark.createDataFrame([("MAA", "g1"), ("MAA", "g1"), ("MAA", "g2"), ("MCC", "g1")], "protein string, gbk_file string")
    counts = lambda: rows(kept_index.read_counts(spark, at).select("protein", "instance_count", "genome_count"))
    assert kept_index.add_batch(frames, at, 0, 4) == {"frames": 4, "pairs": 3, "fresh": 3}
    more = spark.createDataFrame([("MAA", "g2"), ("MAA", "g3")], "protein string, gbk_file string")
    want = [("MAA", 5, 3), ("MCC", 1, 1)]
    for _ in range(2):
        assert kept_index.add_batch(more, at, 1, 4) == {"frames": 2, "pairs": 2, "fresh": 1}
        assert counts() == want
    assert kept_index.add_batch(more.limit(0), at, 2, 4) == {"frames": 0, "pairs": 0, "fresh": 0}
    assert counts() == want
    assert kept_index.fold_due(spark, at, 1, 2) and not kept_index.fold_due(spark, at, 1, 3)
    assert kept_index.fold(spark, at, 1) == kept_index.fold(spark, at, 1) <= 2
    assert counts() == want and not kept_index.fold_due(spark, at, 2, 2)
    kept_index.add_batch(more, at, 1, 4)  # again, though it is folded
    assert counts() == want
    kept_index.add_batch(more, at, 3, 4)
    assert counts() == [("MAA", 7, 3), ("MCC", 1, 1)]
    kept_index.fold(spark, at, 3)
    assert counts() == [("MAA", 7, 3), ("MCC", 1, 1)]


def test_an_upsert_writes_its_own_partitions_alone(spark, tmp_path):
    """What is there stays; a batch of a few peptides writes a few files, and one of new genomes reads no older pairs."""
    at = tmp_path / "index"
    frames = spark.range(5000).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("protein"), F.lit("g").alias("gbk_file"))
    kept_index.add_batch(frames, str(at), 0, 64)
    kept_index.fold(spark, str(at), 0)
    before = files(at, "")
    assert kept_index.add_batch(frames.limit(3), str(at), 1, 64) == {"frames": 3, "pairs": 3, "fresh": 0}
    after = files(at, "")
    assert {k: v for k, v in after.items() if k in before} == before
    assert 2 <= len(after) - len(before) <= 4
    assert kept_index.add_batch(frames.limit(3).withColumn("gbk_file", F.lit("h")), str(at), 2, 64)["fresh"] == 3
    got = kept_index.read_counts(spark, str(at)).filter("genome_count = 2").count()
    assert got == 3 and kept_index.read_counts(spark, str(at)).count() == 5000
    # a fold that broke off: half of the buckets are of batch 2, the others of batch 0
    half = kept_index._summed(kept_index._parts(spark, str(at)), "bucket", "protein").filter("bucket % 2 = 0").withColumn("upto", F.lit(2).cast("long"))
    kept_index._put(cut(half), f"{at}/counts", ["bucket"])
    assert kept_index.read_counts(spark, str(at)).filter("genome_count = 2").count() == 3
    assert kept_index.read_counts(spark, str(at)).agg(F.sum("instance_count")).first()[0] == 5006


def test_lookup_reads_the_index_without_a_shuffle(spark, tmp_path):
    at = str(tmp_path / "index")
    frames = spark.range(3000).select(F.concat(F.lit("M"), (F.col("id") % 900).cast("string")).alias("protein"), (F.col("id") % 7).cast("string").alias("gbk_file"))
    kept_index.add_batch(frames, at, 0, 16)
    asked = spark.createDataFrame([("M5", 1), ("M5", 2), ("Mx", 3), (None, 4), ("M899", 5)], "protein string, k int")
    want = [(1, 4, 4), (2, 4, 4), (3, 0, 0), (4, 0, 0), (5, 3, 3)]
    kept_index.fold(spark, at, 0)
    kept_index.add_batch(frames.filter("protein = 'M5'").withColumn("gbk_file", F.lit("new")).limit(1), at, 1, 16)
    want = [(1, 5, 5), (2, 5, 5), *want[2:]]
    for most in (1000, 1):
        assert rows(kept_index.lookup(asked, at, 16, most).select("k", "instance_count", "genome_count")) == want
    plan = kept_index.lookup(asked, at, 16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(protein" not in plan and "SortMergeJoin" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", kept_index.lookup(asked.filter("k = 1"), at, 16)._jdf.queryExecution().executedPlan().toString())


def test_the_report_runs_again_for_some_origins(spark, docs, tmp_path):
    c = config(candidate_report)
    docs.write.parquet(str(tmp_path / "in"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = candidate_report.run(spark, source, out, c)
    assert counts["rows"] == docs.count()
    first, summary = rows(candidate_report.read_candidates(spark, out)), rows(candidate_report.read_summary(spark, out))
    assert len(first) == counts["candidates"] > 0
    origin = docs.select("source").filter("source is not null").first()[0]
    before = files(tmp_path, "out/candidates")
    again = candidate_report.run(spark, source, out, c, [origin])
    assert again["origins"] == 1
    after = files(tmp_path, "out/candidates")
    assert {k for k in before if f"origin=from-{origin}/" not in k} == {k for k, v in after.items() if before.get(k) == v}
    # counts of genomes are those of the input that was read, so only they may differ in a part's report
    assert len(rows(candidate_report.read_candidates(spark, out))) == len(first)
    candidate_report.run(spark, source, out, c)
    assert rows(candidate_report.read_candidates(spark, out)) == first
    assert rows(candidate_report.read_summary(spark, out)) == summary


def test_the_report_takes_odd_rows(spark, tmp_path):
    table = spark.createDataFrame([(1, None, None, None), (2, "", "", "en"), (3, "text", None, "de"), (3, "text", None, "de")], "doc_id long, text string, source string, lang string")
    c = config(candidate_report)
    table.write.parquet(str(tmp_path / "in"))
    candidate_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), c)
    assert candidate_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), c, ["no such origin"])["records"] == 0
    assert {r.origin for r in candidate_report.read_summary(spark, str(tmp_path / "out")).collect()} <= {"unknown", "from-"}


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = registered.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(con.sql(registered.ORACLES[name]).columns) == cols
    want = con.sql(f"select {', '.join(cols)} from ({registered.ORACLES[name]})").fetchall()
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(show, r)) for r in want)
    assert want


def test_a_run_that_breaks_off_is_finished_by_the_next(spark, docs, tmp_path, monkeypatch):
    """The pairs are written and the counts aren't: the next run replays the batch over the same partitions."""
    c = {**config(index_peptides), "buckets": 4}
    at = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    docs.filter("doc_id < 100").coalesce(1).write.parquet(at[0])
    index_peptides.run(spark, *at, c)
    docs.filter("doc_id >= 100").coalesce(1).write.mode("append").parquet(at[0])

    def breaks(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(kept_index, "fold_due", breaks)
        with pytest.raises(Exception, match="lost"):
            index_peptides.run(spark, *at, c)
    assert kept_index.read_pairs(spark, at[1]).filter("batch = 1").count() > 0
    done = index_peptides.run(spark, *at, c)
    assert [d["batch"] for d in done] == [1]
    whole = index.build_index(orf.with_protein(orf.orfs(index_peptides.segments(docs, c), c["min_aa"], c["max_aa"])))
    assert rows(kept_index.read_counts(spark, at[1]).select("protein", "instance_count", "genome_count")) == rows(whole.select("protein", "instance_count", "genome_count"))


def test_many_files_come_in_batches(spark, docs, tmp_path):
    """``files_at_once`` cuts a backlog into batches; the index is that of one batch."""
    c = {**config(index_peptides), "buckets": 4, "files_at_once": 2, "fold_after": 2}
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    done = index_peptides.run(spark, *(str(tmp_path / x) for x in ("in", "out", "checkpoint")), c)
    assert [(d["batch"], d["folded"]) for d in done] == [(0, 0), (1, 4), (2, 0)] and sum(d["rows"] for d in done) == docs.count()
    whole = index.build_index(orf.with_protein(orf.orfs(index_peptides.segments(docs, c), c["min_aa"], c["max_aa"])))
    assert rows(kept_index.read_counts(spark, str(tmp_path / "out")).select("protein", "instance_count", "genome_count")) == rows(whole.select("protein", "instance_count", "genome_count"))


def test_settings_are_left_as_they_were(spark, docs, tmp_path):
    before = dict(spark.conf.getAll)
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    index_peptides.run(spark, *(str(tmp_path / x) for x in ("in", "out", "checkpoint")), config(index_peptides))
    candidate_report.run(spark, str(tmp_path / "in"), str(tmp_path / "report"), config(candidate_report))
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("job", [index_peptides, candidate_report])
def test_command_line(sf, tmp_path, job):
    """Each command makes and stops a session of its own, logs, and can be run again."""
    name = job.__name__
    small = {**config(job), **({"buckets": 2} if job is index_peptides else {"best": 1})}
    (tmp_path / "c.json").write_text(json.dumps(small))
    paths = ["--input", f"{sf}/{{documents}}.parquet", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")] + (["--checkpoint", str(tmp_path / "cp")] if job is index_peptides else [])
    command = [sys.executable, "-m", name, *paths]
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    logs = [subprocess.run(command, cwd=Path(job.__file__).parents[1], env=env, capture_output=True, text=True, timeout=300) for _ in range(2)]
    assert [x.returncode for x in logs] == [0, 0], logs[0].stderr[-2000:]
    assert f"INFO:{name}" in logs[0].stderr and "read" in logs[0].stderr
    if job is index_peptides:
        assert "0 new batches" in logs[1].stderr


def test_frames_of_a_table_in_one_row_group_are_found_by_many_tasks(spark, docs, tmp_path, monkeypatch):
    """the table is read in one task, its frames are found in as many as the session shuffles to."""
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    kept = []
    monkeypatch.setattr(candidate_report, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    candidate_report.candidates(table, config(candidate_report))
    own = kept[0].groupBy(F.spark_partition_id()).count().collect()
    assert table.rdd.getNumPartitions() == 1 and len(own) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in own) < 0.5 * kept[0].count()
