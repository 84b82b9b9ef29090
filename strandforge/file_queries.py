"""Registered queries of readers and writers: what Spark derives from the tables is written to a new shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge import queries as q
from strandforge.functions.register import register
from strandforge.lineage import cut, ensure_checkpoint_dir
from strandforge.operators import conservation, kept_index, rank, rules
from strandforge.sources import fasta, genbank, tables
from strandforge.streaming import index_stream


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@q.query(f"with {q._SEG} select record_id as id, dna as sequence from seg")
def fasta_round_trip(spark, sf_dir):
    at = folder(spark)
    fasta.write_fasta(q.segments(spark, sf_dir).withColumnRenamed("record_id", "id"), at, 80)
    return fasta.read_fasta(spark, at)


_HEADED = f"with {q._SEG} select record_id || ' ' || gbk_file || ' core=' || translate(left(md5(record_id), 9), '{q._HEX}', '{q._RESIDUES}') as id, case when doc_id % 10 = 0 then '' when doc_id % 2 = 0 then lower(dna) else dna end as sequence from seg"


@q.query(f"{_HEADED}".replace(" as sequence from seg", f" as sequence, translate(left(md5(record_id), 9), '{q._HEX}', '{q._RESIDUES}') as core from seg"))
def fasta_full_headers(spark, sf_dir):
    """Headers with descriptions, lower case and empty sequences, read as they are; the core that a description names."""
    at = folder(spark)
    core = F.translate(F.left(F.md5("record_id"), F.lit(9)), q._HEX, q._RESIDUES)
    own = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 2 == 0, F.lower("sequence")).otherwise(F.col("sequence"))
    s = q.segments(spark, sf_dir).select(F.col("record_id").alias("id"), F.concat("gbk_file", F.lit(" core="), core).alias("description"), own.alias("sequence"))
    fasta.write_fasta(s, at, 60, "description")
    return fasta.read_fasta(spark, at, upper=False, keep_empty=True, full_header=True).withColumn("core", tables.core_of_description(F.col("id")))


def _genbank(spark, sf_dir) -> str:
    """A folder for each source, its records in one file by number: a gene on either strand, and a region whose product some name a knot."""
    s = q.segments(spark, sf_dir).withColumn("source", F.substring_index("gbk_file", "/", 1))
    even = F.col("doc_id") % 2 == 0
    lines = lambda *x: F.concat_ws("\n", *x)
    bases = F.transform(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / 60)), lambda k: F.concat(F.lpad((k * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.lower(F.substr("sequence", (k * 60 + 1).cast("int"), F.lit(60)))))
    tag = lambda name, value: F.concat(F.lit(f'                     /{name}="'), value, F.lit('"'))
    place = F.when(even, "33..224").otherwise("complement(33..224)")
    text = lines(
        F.concat(F.lit("LOCUS       "), "record_id", F.lit(" 256 bp DNA")), F.concat(F.lit("VERSION     "), "record_id", F.lit(".1")), F.lit("FEATURES             Location/Qualifiers"),
        F.concat(F.lit("     CDS             "), place), tag("gene", F.concat(F.lit("g"), (F.col("doc_id") % 12).cast("string"))), F.lit("     region          1..120"), tag("product", F.when(F.col("doc_id") % 3 == 0, "Knot peptide").otherwise("other")),
        F.lit("ORIGIN"), F.array_join(bases, "\n"), F.lit("//"),
    )
    at = folder(spark)
    s.select("source", "doc_id", text.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(at)
    return at


def _records(spark, at: str, limit: int | None = None) -> DataFrame:
    r = genbank.read_genbank(spark, at, limit, recursive=True, pattern="part-*")
    c, s = genbank.cds_features(r), genbank.segments(r, "knot")
    return s.join(c.select("gbk_file", "record_id", F.col("start").alias("cds_start"), F.col("end").alias("cds_end"), F.col("strand").alias("cds_strand"), "gene"), ["gbk_file", "record_id"])


_GENBANK = "record_id || '.1' as record_id, dna as sequence, 32 as cds_start, 224 as cds_end, case when doc_id % 2 = 0 then '+' else '-' end as cds_strand, 'g' || doc_id % 12 as gene, doc_id % 3 = 0 as is_target"


@q.query(f"with {q._SEG}, n as (select *, row_number() over (partition by split_part(gbk_file, '/', 1) order by doc_id)::int as \"index\" from seg) select \"index\", {_GENBANK} from n")
def genbank_records(spark, sf_dir):
    """All records of a folder tree, with their place in their file."""
    return _records(spark, _genbank(spark, sf_dir)).select("index", "record_id", "sequence", "cds_start", "cds_end", "cds_strand", "gene", "is_target")


@q.query(f"with {q._SEG}, n as (select *, row_number() over (partition by split_part(gbk_file, '/', 1) order by doc_id) as n from seg) select {_GENBANK} from n where n = 1")
def genbank_first_records(spark, sf_dir):
    return _records(spark, _genbank(spark, sf_dir), 1).select("record_id", "sequence", "cds_start", "cds_end", "cds_strand", "gene", "is_target")


def _dataset(spark, sf_dir) -> DataFrame:
    s, d = q.segments(spark, sf_dir), F.col("sequence")
    return s.select(F.col("record_id").alias("name"), F.left(d, F.lit(60)).alias("sequence"), F.left(d, F.lit(90)).alias("full_precursor"), F.left(d, F.lit(30)).alias("leader"), F.substr(d, F.lit(31), F.lit(30)).alias("core"), F.col("gbk_file").alias("source"), F.lit("a, \"b\"").alias("validation_status"))


_DATASET = "select record_id as name, left(dna, 60) as sequence, left(dna, 90) as full_precursor, left(dna, 30) as leader, substr(dna, 31, 30) as core, gbk_file as source, 'a, \"b\"' as validation_status from seg"


@q.query(f"with {q._SEG}, d as ({_DATASET}) select d.*, f as format from d, (values ('csv'), ('tsv'), ('json')) x(f)")
def dataset_round_trip(spark, sf_dir):
    at, out = folder(spark), None
    for suffix in ("csv", "tsv", "json"):
        tables.write_dataset(_dataset(spark, sf_dir), f"{at}/set.{suffix}")
        own = tables.read_dataset(spark, f"{at}/set.{suffix}").withColumn("format", F.lit(suffix))
        out = own if out is None else out.unionByName(own)
    return out


@q.query(f"with {q._SEG}, d as ({_DATASET}) select 'faa' as kind, name, sequence, null::varchar as core from d union all select 'tsv', name, sequence, core from d")
def dataset_imports(spark, sf_dir):
    """Entries imported from FASTA and from a table."""
    at, d = folder(spark), _dataset(spark, sf_dir)
    fasta.write_fasta(d.withColumnRenamed("name", "id"), f"{at}/x.faa")
    tables.write_dataset(d, f"{at}/x.tsv")
    a, b = tables.import_entries(spark, f"{at}/x.faa"), tables.import_entries(spark, f"{at}/x.tsv")
    return a.select(F.lit("faa").alias("kind"), "name", "sequence", F.lit(None).cast("string").alias("core")).unionByName(b.select(F.lit("tsv").alias("kind"), "name", "sequence", "core"))


@q.query(f"with {q._SEG} select record_id as peptide, gbk_file as refs, left(dna, 12) as core from seg")
def semicolon_table(spark, sf_dir):
    """A table whose every file begins with a byte-order mark."""
    at = folder(spark)
    q.segments(spark, sf_dir).select(F.col("record_id").alias("﻿peptide"), F.col("gbk_file").alias("refs"), F.left("sequence", F.lit(12)).alias("core")).write.csv(at, sep=";", header=True)
    return tables.read_semicolon_table(spark, at)


@q.query(f"with {q._SEG} select record_id as name, left(dna, 40) as precursor, case when doc_id % 4 > 0 then substr(dna, 11, 30) end as core from seg")
def labelled_blocks(spark, sf_dir):
    at = folder(spark)
    core = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("\nCore: "), F.lower(F.substr("sequence", F.lit(11), F.lit(30))))).otherwise("")
    q.segments(spark, sf_dir).select(F.concat(F.lit(">"), "record_id", F.lit("\nPrecursor: "), F.left("sequence", F.lit(20)), F.lit("-"), F.substr("sequence", F.lit(21), F.lit(20)), core)).toDF("value").write.text(at)
    return tables.read_blocks(spark, at, core_required=False)


@q.query(q.ORACLES["altframe_loci"])
def hits_scan(spark, sf_dir):
    """Hits written as a table of text and counted by locus from there."""
    at = folder(spark)
    q._hits(spark, sf_dir).write.csv(at, sep="\t", header=True)
    return conservation.locus_keys(conservation.clean_hits(spark.read.csv(at, sep="\t", header=True)))


@q.query(f"with {q._HITS} select gene_name, match_type, orf_strand, orf_frame, bin_first, bin_last, case when hit_genomes > 1 then hit_events::double / hit_genomes end as z_score from loci")
def loci_scan(spark, sf_dir):
    at = folder(spark)
    keys = conservation.locus_keys(q._hits(spark, sf_dir)).withColumn("z_score", F.when(F.col("hit_genomes") > 1, F.col("hit_events") / F.col("hit_genomes")))
    keys.withColumnsRenamed({"bin_first": "bin_start", "bin_last": "bin_end"}).write.csv(at, sep="\t", header=True)
    return tables.read_loci(spark, at)


@q.query("""select doc_id as page, 'A' as ambler_class, 'P ' || doc_id || ' & ' || source as protein_name, 'AAA' || doc_id as genpept_id, 'http://x/' || doc_id as genpept_link, lang as subfamily from documents where doc_id % 3 = 0""")
def class_table(spark, sf_dir):
    """Class A rows of pages made from the documents: a heading, a row of class A or B, and a short row of class A."""
    d = q.read(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    cells = F.concat(F.lit("<td>P <b>"), n, F.lit("</b> &amp; "), "source", F.lit("</td><td>alt</td><td>"), "lang", F.lit("</td><td><a href='http://x/"), n, F.lit("'>AAA"), n, F.lit("</a></td>"), F.lit("<td>x</td>" * 4))
    html = F.concat(F.lit("<table><tr><th>Class</th></tr><tr><td>"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("B"), F.lit("</td>"), cells, F.lit("</tr><tr><td>A</td><td>short</td></tr></table>"))
    rows = tables.class_table(d.select(html.alias("html")))
    return rows.select(F.regexp_extract("genpept_link", r"(\d+)$", 1).cast("long").alias("page"), "ambler_class", "protein_name", "genpept_id", "genpept_link", "subfamily")


@q.query("""with r as (select *, case when doc_id % 4 > 0 then 'NC_' || doc_id end as a, case when doc_id % 5 > 0 then 'BGC' || doc_id end as b from documents)
select coalesce(a, '') as assembly_id, source as acc, 1 as record_number, (doc_id % 7)::int as region_number, coalesce(case when a is not null then 'http://h/output/' || a || '/index.html#r1c' || doc_id % 7 end, '') as cluster_url, coalesce('http://h/output/' || a || '/' || a || '.gbk', '') as gbk_url,
coalesce(b, '') as best_mibig_hit_acc, coalesce((case when b is not null then doc_id % 100 end)::varchar, '') as best_mibig_hit_similarity, coalesce('http://m/go/' || b, '') as mibig_url from r""")
def region_search_rows(spark, sf_dir):
    """Search hits kept as JSON, read back and shown as rows."""
    at, k = folder(spark), F.col("doc_id")
    hits = q.read(spark, sf_dir, "documents").select(
        F.when(k % 4 > 0, F.concat(F.lit("NC_"), k.cast("string"))).alias("assembly_id"), F.col("source").alias("acc"), F.lit(1).alias("record_number"), (k % 7).cast("int").alias("region_number"), F.lit(5).alias("start_pos"), F.lit(9).alias("end_pos"), F.lit(None).cast("string").alias("description"),
        F.when(k % 5 > 0, F.concat(F.lit("BGC"), k.cast("string"))).alias("best_mibig_hit_acc"), F.when(k % 5 > 0, (k % 100).cast("int")).alias("best_mibig_hit_similarity"),
    )
    hits.write.json(at)
    own = tables.region_rows(spark.read.schema(hits.schema).json(at), "http://h", "http://m")
    return own.select("assembly_id", "acc", "record_number", "region_number", "cluster_url", "gbk_url", "best_mibig_hit_acc", "best_mibig_hit_similarity", "mibig_url")


@q.query(q.ORACLES["orf_top_longest"])
def selection_export(spark, sf_dir):
    """Each record's longest frames as a selection, written as JSON lines and read back."""
    at = folder(spark)
    top = rank.top_k(q.found_orfs(spark, sf_dir), [F.desc("aa_len"), F.col("strand"), F.col("genomic_start")], 3, ["record_id"]).select("record_id", "strand", "genomic_start", "aa_len", "protein")
    tables.write_selection(top, at)
    return spark.read.schema(top.schema).json(at)


@q.query(q.ORACLES["orf_top_longest"])
def selection_fasta(spark, sf_dir):
    """The same selection as FASTA, its fields in the headers."""
    at = folder(spark)
    top = rank.top_k(q.found_orfs(spark, sf_dir), [F.desc("aa_len"), F.col("strand"), F.col("genomic_start")], 3, ["record_id"])
    fasta.write_fasta(top.select(F.concat_ws("|", "record_id", "strand", F.col("genomic_start").cast("string"), F.col("aa_len").cast("string")).alias("id"), F.col("protein").alias("sequence")), at)
    part = F.split("id", r"\|")
    return fasta.read_fasta(spark, at).select(part[0].alias("record_id"), part[1].alias("strand"), part[2].cast("int").alias("genomic_start"), part[3].cast("int").alias("aa_len"), F.col("sequence").alias("protein"))


@q.query(f"with {q._orf_sql()} select protein, count(*) as instance_count, count(distinct record_id) as genome_count from orfs group by protein")
def index_stream_counts(spark, sf_dir):
    """The occurrence index of a stream of segment files, each record a genome."""
    at = folder(spark)
    q.segments(spark, sf_dir).select("record_id", "sequence").write.parquet(f"{at}/in")
    index_stream.run_index_stream(index_stream.segment_stream(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return index_stream.read_index(spark, f"{at}/out")


def _edited() -> dict:
    """The default rules with two of them changed."""
    own = rules.update_rule(rules.ruleset(), "core_length", weight=2.0, parameters={"optimal_min": 12, "optimal_max": 30})
    return rules.update_rule(own, "charge_transition", weight=0.9, parameters={"min_difference": 0.5})


@q.query(f"with {q._SITES}, {q._site_sql('sites', _edited())} select sequence, round(max(score), 6) as rule_score_raw from scored group by sequence")
def edited_rules(spark, sf_dir):
    """Rules that were changed, saved to the shared folder, loaded again and applied; a path without any gives the fallback."""
    at = folder(spark)
    rules.save_rules(_edited(), at, spark)
    loaded = rules.load_rules(f"{at}/none", rules.load_rules(at, spark=spark), spark)
    return rules.best_rule_score(q.proteins(spark, sf_dir), loaded).select("sequence", F.round("rule_score_raw", 6).alias("rule_score_raw"))


def _kept(spark, sf_dir) -> tuple[str, DataFrame]:
    """An index of two batches, the second of which came twice."""
    at, o = f"{folder(spark)}/index", cut(q.found_orfs(spark, sf_dir).select("doc_id", "protein", "gbk_file"))  # read by every batch
    for batch, part in ((0, 0), (1, 1), (1, 1)):
        kept_index.add_batch(o.filter(F.col("doc_id") % 2 == part), at, batch, 8)
    return at, o


@q.query(q.ORACLES["peptide_index"])
def kept_index_counts(spark, sf_dir):
    at, _ = _kept(spark, sf_dir)
    return kept_index.read_counts(spark, at).select("protein", "instance_count", "genome_count", F.col("aa_len").cast("long").alias("aa_len"))


@q.query(f"with {q._orf_sql()}, {q._KNOWN}, ix as (select protein, count(*) n, count(distinct gbk_file) g from orfs group by 1) select o.protein, coalesce(n, 0) as instance_count, coalesce(g, 0) as genome_count from known o left join ix using (protein)")
def kept_index_lookup(spark, sf_dir):
    at, o = _kept(spark, sf_dir)
    return kept_index.lookup(q._known(o).distinct(), at, 8).select("protein", "instance_count", "genome_count")


@q.query(f"with {q._SEG} select record_id, reverse(translate(dna, 'ACGT', 'TGCA')) as reversed, regexp_replace({q._protein('dna')}, '[*]$', '') as protein, 'core_' || left(sha1(translate(left(dna, 20), 'I', 'L')), 10) as core from seg")
def session_functions(spark, sf_dir):
    """The sequence functions by name in SQL over a table given as a parameter."""
    register(spark)
    return spark.sql("select record_id, reverse_complement(sequence) as reversed, translate_bacterial(sequence) as protein, core_group(left(sequence, 20)) as core from {t}", t=q.segments(spark, sf_dir))
